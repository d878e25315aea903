"""Secret scans with multipart credential linking, in DataFrame operations alone.

Base spans (assign, access, hex) always count. Weak candidates (weak_id, weak_secret, endpoint) are
reported only where complementary parts co-occur: identifiers, secrets and endpoints of one document are
joined as intervals, by the scopes (buckets of SCOPE code points) that they touch, and two parts link
when they share no text and at most SCOPE code points lie between them. An identifier needs a secret, a secret
an identifier or an endpoint, an endpoint both, which must not share text either. Text inside an endpoint or a
weak identifier is no weak secret; an endpoint with user information begins after its @.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

SCOPE = 200
#: Matches whose places are added up together.
PART = 128
#: The base patterns; the last group of assign is the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
WEAK_ID = r"""(?i:access_?key(?:_?id)?|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
#: Not the name before an assignment's =; closing = belong to it.
WEAK_SECRET = r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}+(?!={1,2}["']?[A-Za-z0-9+/_-]|\x20+=)={0,2}"""
_SCHEME = r"(?:https?|ftp|s3|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://"
ENDPOINT = rf"""{_SCHEME}(?![^\s"'<>/@]{{1,200}}@)[^\s"'<>]{{4,}}|(?<=@)(?<={_SCHEME}[^\s"'<>/@]{{1,200}}@)[^\s"'<>]+"""
#: In the order that settles equal starts.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}


def spans_of(text: Column, kind: str, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """array<struct<start, kind_no, stop>> of a pattern's matches, in code points, leftmost and not overlapping.

    The text between matches (split by the pattern) and the matches themselves give the positions.
    """
    kind_no = KINDS.index(kind)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    lengths = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("m"), value.alias("v")), lambda x: F.struct(F.char_length(x["b"]).alias("b"), F.char_length(x["m"]).alias("m"), F.char_length(x["v"]).alias("v")))
    nothing = F.array().cast("array<struct<start:int,kind_no:int,stop:int,value:int>>")

    def walked_from(part: Column, at: Column) -> Column:
        span = lambda acc, x: F.struct((acc["at"] + x["b"]).alias("start"), F.lit(kind_no).alias("kind_no"), (acc["at"] + x["b"] + x["m"]).alias("stop"), x["v"].alias("value"))
        step = lambda acc, x: F.struct((acc["at"] + x["b"] + x["m"]).alias("at"), F.concat(acc["spans"], F.array(span(acc, x))).alias("spans"))
        return F.aggregate(part, F.struct(at.alias("at"), nothing.alias("spans")), step, lambda acc: acc["spans"])

    def walked_parts(parts: Column) -> Column:
        """Each part from the place where those before it end: arrays grow by a part, not by a match of a long text."""
        length = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["b"] + x["m"])
        places = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, p: F.struct((acc["at"] + length(p)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
        return F.flatten(F.zip_with(parts, places, walked_from))

    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  so that it is evaluated once
    parts_of = lambda found: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PART).cast("int")), lambda k: F.slice(found, k * PART + 1, F.lit(PART)))
    walked = once(lengths, lambda found: once(parts_of(found), walked_parts))
    kept = F.transform(F.filter(walked, lambda s: s["value"] >= least), lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["stop"].alias("stop")))
    none = F.array().cast("array<struct<start:int,kind_no:int,stop:int>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), kept).otherwise(none)


def as_text(spans: Column) -> Column:
    """kind:start:stop of each span, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"], s["stop"])), ",")


def clear_of(spans: str, *others: str) -> Column:
    """The spans of a column that share no text with those of the others."""
    meets = lambda w, o: F.exists(o, lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"]))
    return F.filter(spans, lambda w: ~F.exists(F.array(*[meets(w, o) for o in others]), lambda m: m))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """key, spans: the weak parts of each key that have their complement in scope.

    parts: key, part (struct start, kind_no, stop); repeated parts don't matter.
    """
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    flat = parts.select("key", "part.start", "part.kind_no", "part.stop").distinct().withColumn("role", roles[F.col("kind_no")])
    scopes = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / scope), F.floor(hi / scope)))
    weak = flat.filter(F.col("kind_no") >= 3).withColumn("bucket", scopes(F.col("start") - scope, F.col("stop") + scope))
    other = flat.select("key", F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("role").alias("o_role")).withColumn("bucket", scopes(F.col("o_start"), F.col("o_stop")))
    met = weak.join(other, ["key", "bucket"]).filter("role <> o_role AND (o_stop <= start OR o_start >= stop) AND o_start <= stop + {0} AND start <= o_stop + {0}".format(scope))
    edge = lambda of, side, r: of(F.when(F.col("o_role") == r, F.col(side)))
    apart = lambda a, b: edge(F.max, "o_start", a) >= edge(F.min, "o_stop", b)
    flags = met.groupBy("key", "start", "kind_no", "stop", "role").agg(*[F.bool_or(F.col("o_role") == r).alias(f"has_{r}") for r in ("id", "secret", "endpoint")], (apart("id", "secret") | apart("secret", "id")).alias("has_pair"))
    ok = flags.filter("(role = 'id' AND has_secret) OR (role = 'secret' AND (has_id OR has_endpoint)) OR (role = 'endpoint' AND has_pair)")
    return ok.groupBy("key").agg(F.collect_list(F.struct("start", "kind_no", "stop")).alias("linked"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each document: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Null and empty texts have no spans. Rows are told apart by id and text, so null ids and repeated
    rows each get their own result. A weak part that overlaps a base span is dropped, but such an endpoint
    still serves as a partner. Other columns are not read; an empty table gives an empty result. Positions are code points of the whole text;
    a very long text is one row, its spans one array.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select(
        "id",
        F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.sha2("text", 256)), 256).alias("key"),
        spans_of(F.col("text"), "assign", ASSIGN, 1, LEAST_VALUE).alias("assign"),
        spans_of(F.col("text"), "access", ACCESS).alias("access"),
        spans_of(F.col("text"), "hex", HEX).alias("hex"),
        *[spans_of(F.col("text"), kind, pattern).alias(kind) for kind, pattern in (("weak_id", WEAK_ID), ("weak_secret", WEAK_SECRET), ("endpoint", ENDPOINT))],
    )
    rows = cut(rows, "secret-spans").withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("weak", F.concat(clear_of("weak_id", "base"), clear_of("weak_secret", "base", "weak_id", "endpoint"), "endpoint"))
    links = linked(rows.filter("size(weak) > 0 AND size(weak) + size(base) > 1").select("key", F.explode(F.concat("base", "weak")).alias("part")), scope)
    none = F.array().cast("array<struct<start:int,kind_no:int,stop:int>>")
    out = rows.join(links, "key", "left").withColumn("linked", F.coalesce("linked", none))
    extra = clear_of("linked", "base")
    return out.select(
        F.col("id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.concat(F.col("base"), extra)).alias("spans"),
        F.size(extra).cast("long").alias("n_linked"),
    )
