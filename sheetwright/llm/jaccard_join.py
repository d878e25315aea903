"""N-gram Jaccard join by prefix filters under several global token orders.

A token is a hashed shingle of five words; a document is the set of its tokens, a node one set. Linked sets
of n and m tokens (Jaccard similarity 0.8 or more) share at least `overlap(n, m)` of them.

1. Discarding. A third of the tokens is counted over all documents. A set with more tokens of its own alone among
   these than a link leaves over can link with nothing; most documents end here. Of what is left, one document a
   set is read again and all its tokens are counted among these sets: what is then still too unlike the rest goes too.
2. The first order puts rarer tokens first. Each set posts its prefix, and with each token the largest size that
   a partner may have when this is the first token in common, so that a pair meets only where both allow it. A token
   whose sets all have the same token before it is left out, as its pairs meet there.
3. Rounds: each token's list links its sets to a hub of its own. A pair must also share enough of the prefixes under
   two further orders, and only what passes all filters is compared token by token. Lists within one component
   are done, as further pairs could not change the components. What is left after ROUNDS meets pair by pair, but for pairs
   within a component and within a list's largest part. No list is cut short and no link between components is lost.

Tokens that a block of documents holds more than once are counted there, so a passage of a third of all documents
costs one number a block; lists of frequent tokens are salted, and each comparison task holds a hub and one other set at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .components import connected
from .words import KEEP_WORDS, kept

WORDS, NUM, DEN = 5, 80, 100
ROUNDS, CHUNK = 3, 64
#: One token in SAMPLED is counted over all documents.
SAMPLED = 3
#: Documents and tokens a block (a row of 3 MB, which a task and its worker hold several times), tokens a counting task, and members of a list beyond which it is salted.
BLOCK_DOCS, BLOCK_TOKENS, BUCKET_TOKENS, SALT_ROWS = 1500, 400_000, 500_000, 4_000
#: The bitmap of rows to read again, in bits (32 MB at most), and its bits a row; rows too many for it are joined by their names instead.
LEAST_BITS, MOST_BITS, ROW_BITS = 1 << 20, 1 << 28, 16
#: Pairs up to which their members (40 bytes each, twice at most) are broadcast to the sets.
BROADCAST_PAIRS = 250_000
#: Factors of the hashes; each also makes a global order.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SHARED_BY_MANY = 0xFFFF
_ROW = np.dtype([("id", "<i8"), ("has_id", "?"), ("n", "<i4"), ("sampled", "<i4"), ("shared", "<i4"), ("row", "<i8"), ("set", "V16")])
_POST = np.dtype([("token", "<i8"), ("before", "<i8"), ("most", "<i4"), ("df", "<i4")])


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def least_size(n, num: int = NUM, den: int = DEN):
    """The fewest tokens that a set linked with one of n tokens shares with it."""
    return -(-num * n // den)


def overlap(n, m, num: int = NUM, den: int = DEN):
    """The fewest tokens that linked sets of n and m tokens share."""
    return -(-num * (n + m) // (num + den))


class WordHashes(dict):
    """64-bit hashes of words, each made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    fresh = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    return values[fresh]


class Shingler:
    """Sets of hashed shingles; each distinct word of a worker is hashed once."""

    def __init__(self, words: int = WORDS):
        self.words, self.seen = words, WordHashes()
        self.factors = mixed(np.arange(1, words + 1, dtype=np.uint64), ORDERS[0]) | np.uint64(1)

    def tokens(self, text: str | None) -> np.ndarray:
        """The sorted distinct tokens of a text: A-Z in lower case, words between ASCII white space."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.seen) > KEEP_WORDS:
            self.seen.clear()
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        if len(h) < self.words:  # the whole sequence, told apart by its length
            total = np.array([np.multiply(h, self.factors[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], dtype=np.uint64)
            return mixed(total, ORDERS[2])
        n = len(h) - self.words + 1
        total = h[:n] * self.factors[0]
        for k in range(1, self.words):
            total += h[k : k + n] * self.factors[k]
        return distinct(mixed(total, ORDERS[1]))


def shingler(words: int) -> Shingler:
    return kept(f"shingler{words}", lambda: Shingler(words))


def set_key(tokens: np.ndarray) -> bytes:
    """Names a set: 128 bits of a hash of its tokens."""
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def row_key(ident: int | None, text: str | None) -> int:
    """Names a row by its id and text: Spark's xxhash64(text, id), if the text is not null."""
    import xxhash

    h = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)
    h = h if ident is None else xxhash.xxh64_intdigest(ident.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def block_key(rows: list[int], turn: int) -> int:
    """Names a block by its place and rows: a task that runs again over the same rows gives the same names."""
    import xxhash

    return xxhash.xxh3_64_intdigest(np.array([TaskContext.get().partitionId(), turn, *rows], np.int64).tobytes()) - (1 << 63)


def at_docs(kind: np.ndarray) -> int:
    """Where a block's own documents are among what has come back to it."""
    if kind.min() != 0:
        raise ValueError("a block came back without its documents: the rows of a task changed while it ran again")
    return int(np.argmin(kind))


def by_bucket(tokens: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket the positions of its tokens."""
    bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    at = np.argsort(bucket, kind="stable")
    ends = np.bincount(bucket, minlength=buckets).cumsum()
    for b in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(b), at[(ends[b - 1] if b else 0) : ends[b]]


def tallied(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different tokens in order, how often each occurs, and where it first does."""
    found, first, n = np.unique(tokens, return_index=True, return_counts=True)
    return found, n, first


def _records(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_DOCS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _joined(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=kind) for x in column]


def counted_rows(texts: DataFrame, buckets: int, words: int, num: int, den: int) -> DataFrame:
    """id, n_shingles, set, row_key, alive of every row of texts(id, text); alive if the sampled tokens don't rule out a link.

    A block's sampled tokens go to the buckets, each with the document that holds it, or without if the block has more
    of it; what a bucket knows to be shared comes back to the block. Copies count as others here.
    """
    names, kinds = ["bucket", "kind", "block", "packed", "holders"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shingler(words)
        for turn, batch in enumerate(_slices(batches)):
            docs, sampled = np.zeros(batch.num_rows, dtype=_ROW), []
            for k, (ident, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                own = of.tokens(text)
                some = own[own % np.uint64(SAMPLED) == 0]
                docs[k] = (ident or 0, ident is not None, len(own), len(some), 0, row_key(ident, text), set_key(own) if len(own) else b"")
                sampled.append(some)
            tokens, holder = np.concatenate([*sampled, np.empty(0, np.uint64)]), np.repeat(np.arange(len(docs)), docs["sampled"])
            found, n, first = tallied(tokens)
            repeated = n[np.searchsorted(found, tokens)] > 1
            docs["shared"] = np.bincount(holder[repeated], minlength=len(docs))
            holders = np.where(n > 1, SHARED_BY_MANY, holder[first] if len(first) else first).astype("<u2")
            block = block_key(docs["row"].tolist(), turn)
            rows = [(b, 1, block, (found[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), holders[at].tobytes()) for b, at in by_bucket(found, buckets)]
            yield _records([*rows, (block % buckets, 0, block, docs.tobytes(), b"")], names, kinds)

    def shared(table: pa.Table) -> pa.Table:
        piece = table["kind"].to_numpy() == 1
        pieces, docs = table.filter(pa.array(piece)), table.filter(pa.array(~piece))
        packed, holders = _joined(pieces["packed"], "<u4"), _joined(pieces["holders"], "<u2")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed))
        tokens = np.concatenate([*packed, np.empty(0, "<u4")]).astype(np.uint64)
        ordered = np.sort((tokens << np.uint64(32)) | np.arange(len(tokens), dtype=np.uint64))
        same = (ordered[1:] >> np.uint64(32)) == (ordered[:-1] >> np.uint64(32))
        flags = np.zeros(len(tokens), dtype=bool)
        at = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)
        flags[at[1:][same]] = flags[at[:-1][same]] = True
        holder = np.concatenate([*holders, np.empty(0, "<u2")])
        flags &= holder != SHARED_BY_MANY
        ends = sizes.cumsum()
        told = [holder[lo:hi][flags[lo:hi]].tobytes() for lo, hi in zip(ends - sizes, ends, strict=True)]
        return pa.table({"block": pa.concat_arrays([*pieces["block"].chunks, *docs["block"].chunks, pa.array([], pa.int64())]), "kind": pa.array([1] * len(told) + [0] * docs.num_rows, pa.int32()), "packed": pa.array(told + docs["packed"].to_pylist(), pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        docs = np.frombuffer(table["packed"][at_docs(kind)].as_buffer(), dtype=_ROW)
        told = np.concatenate([*_joined(table.filter(pa.array(kind == 1))["packed"], "<u2"), np.empty(0, "<u2")])
        met = docs["shared"] + np.bincount(told, minlength=len(docs))
        own_alone, n = docs["sampled"] - met, docs["n"].astype(np.int64)
        none = n == 0
        return pa.table({
            "id": pa.array(docs["id"], pa.int64(), mask=~docs["has_id"]),
            "n_shingles": pa.array(n),
            "set": pa.array([None if e else bytes(s) for s, e in zip(docs["set"], none, strict=True)], pa.binary()),
            "row_key": pa.array(docs["row"]),
            "alive": pa.array(~none & (own_alone <= n - least_size(n, num, den))),
        })

    dealt = texts.select("id", "text").mapInArrow(deal, "bucket int, kind int, block long, packed binary, holders binary")
    told = dealt.groupBy("bucket").applyInArrow(shared, "block long, kind int, packed binary").filter("kind = 0 OR octet_length(packed) > 0")
    return cut(told.groupBy("block").applyInArrow(settle, "id long, n_shingles long, set binary, row_key long, alive boolean"), "jaccard-rows")


def bitmap_of(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the bits of places(p), modulo its size; at most MOST_BITS come to the driver."""
    at = F.col("p").bitwiseAND(F.lit(bits - 1)) + 1
    maps = places.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        lo = (row["k"] - 1) * len(part)
        out[lo : lo + len(part)] = part[: len(out) - lo]
    return out


def first_tokens(tokens: np.ndarray, df: np.ndarray, alone: int, keep: int, order: int) -> np.ndarray:
    """The shared tokens within the first `keep` of a set, under an order that puts the `alone` unshared ones first and hashes the rest."""
    left = keep - alone
    if left <= 0:
        return tokens[:0]
    return tokens if left >= len(tokens) else np.sort(tokens[np.argpartition(mixed(tokens, ORDERS[order]), left - 1)[:left]])


def posted(tokens: np.ndarray, df: np.ndarray, n: int, name: bytes, num: int, den: int) -> np.ndarray:
    """The postings of a set of n tokens, of which `tokens` are shared: its prefix under the first order."""
    alone, keep = n - len(tokens), n - least_size(n, num, den) + 1
    left = max(0, min(len(tokens), keep - alone))
    at = np.lexsort((mixed(tokens, ORDERS[0]), df))[:left]
    out = np.empty(left, dtype=_POST)
    if left:
        out["token"] = tokens[at].view(np.int64)
        out["before"][0] = int.from_bytes(name[:8], "little", signed=True)  # of its own alone
        out["before"][1:] = out["token"][:-1]
        out["most"] = (num + den) * (n - alone - np.arange(left)) // num - n
        out["df"] = np.minimum(df[at], 2**31 - 1)
    return out


def shared_sets(texts: DataFrame, needed: DataFrame, words: int, num: int, den: int, most_bits: int = MOST_BITS) -> DataFrame:
    """set, n, tokens (those that other such sets have too), posts (the first order's prefix), second and third (the others').

    needed: row_key, n_shingles of a row of each set. A bitmap of at most most_bits picks these rows (and a few others) in the scan
    itself, so no text is shuffled. Where it would fill, the texts meet the names of these rows in a join instead, which keeps no
    others. A set that comes twice does no harm.
    """
    bits = LEAST_BITS
    total = needed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("tokens")).first()
    while bits < ROW_BITS * total["rows"]:
        bits *= 2
    buckets = int(max(8, total["tokens"] // BUCKET_TOKENS))
    if bits > most_bits:
        texts = texts.filter("text <> ''").withColumn("row_key", F.xxhash64("text", "id")).join(needed.select("row_key").distinct(), "row_key", "left_semi")
        bits, every = 8, np.full(1, 0xFF, dtype=np.uint8)
    else:
        every = bitmap_of(needed.select(F.shiftright("row_key", 12).alias("p")), bits)
    wanted = texts.sparkSession.sparkContext.broadcast(every)
    names, kinds = ["bucket", "kind", "block", "packed", "numbers"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known, met = shingler(words), wanted.value, set()
        keys: list[int] = []
        sets: list[np.ndarray] = []
        turn = held = 0

        def block() -> pa.RecordBatch:
            name, tokens = block_key(keys, turn), np.concatenate(sets)
            found, n, _ = tallied(tokens)
            rows = [(b, 1, name, found[at].tobytes(), n[at].astype("<u4").tobytes()) for b, at in by_bucket(found, buckets)]
            return _records([*rows, (name % buckets, 0, name, tokens.tobytes(), np.array([len(s) for s in sets], "<u4").tobytes())], names, kinds)

        for batch in _slices(batches):
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key = row_key(ident, text)
                at = (key >> 12) & (len(known) * 8 - 1)
                if not text or key in met or not known[at >> 3] >> (at & 7) & 1:
                    continue
                own = of.tokens(text)
                if len(own):
                    met.add(key)
                    keys.append(key)
                    sets.append(own)
                    held += len(own)
                if len(keys) >= BLOCK_DOCS or held >= BLOCK_TOKENS:
                    yield block()
                    keys.clear()
                    sets.clear()
                    turn, held = turn + 1, 0
        if keys:
            yield block()

    def tally(table: pa.Table) -> pa.Table:
        piece = table["kind"].to_numpy() == 1
        pieces, docs = table.filter(pa.array(piece)), table.filter(pa.array(~piece))
        packed = _joined(pieces["packed"], "<u8")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed))
        tokens, n = np.concatenate([*packed, np.empty(0, "<u8")]), np.concatenate([*_joined(pieces["numbers"], "<u4"), np.empty(0, "<u4")])
        found, back = np.unique(tokens, return_inverse=True)
        df = np.minimum(np.bincount(back, weights=n, minlength=len(found)), 2**32 - 1).astype("<u4")[back]
        ends, many = sizes.cumsum(), df > 1
        spans = list(zip(ends - sizes, ends, strict=True))
        return pa.table({
            "block": pa.concat_arrays([*pieces["block"].chunks, *docs["block"].chunks, pa.array([], pa.int64())]),
            "kind": pa.array([1] * len(spans) + [0] * docs.num_rows, pa.int32()),
            "packed": pa.array([tokens[lo:hi][many[lo:hi]].tobytes() for lo, hi in spans] + docs["packed"].to_pylist(), pa.binary()),
            "numbers": pa.array([df[lo:hi][many[lo:hi]].tobytes() for lo, hi in spans] + docs["numbers"].to_pylist(), pa.binary()),
        })

    def settle(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        at = at_docs(kind)
        tokens, sizes = (np.frombuffer(table[c][at].as_buffer(), dtype=t) for c, t in (("packed", "<u8"), ("numbers", "<u4")))
        told = table.filter(pa.array(kind == 1))
        known, df = (np.concatenate([*_joined(told[c], t), np.empty(0, t)]) for c, t in (("packed", "<u8"), ("numbers", "<u4")))
        order = np.argsort(known, kind="stable")
        known, df = known[order], df[order]
        out, ends = [], sizes.astype(np.int64).cumsum()
        for lo, hi in zip(ends - sizes, ends, strict=True):
            own = tokens[lo:hi]
            where = np.searchsorted(known, own)
            where[where == len(known)] = 0
            has = known[where] == own if len(known) else np.zeros(len(own), dtype=bool)
            n, shared = len(own), own[has]
            if len(shared) >= least_size(n, num, den):
                name, own_df = set_key(own), df[where[has]]
                keep = n - least_size(n, num, den) + 1
                more = [first_tokens(shared, own_df, n - len(shared), keep, k).tobytes() for k in (1, 2)]
                out.append((name, n, shared.tobytes(), posted(shared, own_df, n, name, num, den).tobytes(), *more))
        return pa.Table.from_batches([_records(out, ["set", "n", "tokens", "posts", "second", "third"], [pa.binary(), pa.int32(), *[pa.binary()] * 4])])

    dealt = texts.select("id", "text").mapInArrow(deal, "bucket int, kind int, block long, packed binary, numbers binary")
    told = dealt.groupBy("bucket").applyInArrow(tally, "block long, kind int, packed binary, numbers binary").filter("kind = 0 OR octet_length(packed) > 0")
    return cut(told.groupBy("block").applyInArrow(settle, "set binary, n int, tokens binary, posts binary, second binary, third binary"), "jaccard-sets")


def salt_of(df: Column, salt_rows: int) -> Column:
    return F.ceil(df / salt_rows).cast("int")


def beside_lists(members: DataFrame, lists: DataFrame, salt_rows: int) -> DataFrame:
    """members joined with lists(list, df, ...) on list; a list of many members is spread over several tasks."""
    left = members.withColumn("salt", F.pmod(F.xxhash64("set"), salt_of(F.col("df"), salt_rows)).cast("int"))
    right = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), salt_of(F.col("df"), salt_rows) - 1))).drop("df")
    return left.join(right, ["list", "salt"]).drop("salt")


def candidate_lists(packed: DataFrame, salt_rows: int) -> DataFrame:
    """list, set, n, most, df: the members of each prefix token that brings pairs of its own."""

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                posts = [np.frombuffer(x.as_buffer(), dtype=_POST) for x in part.column("posts")]
                sizes = np.fromiter(map(len, posts), np.int64, len(posts))
                flat, owner = np.concatenate([*posts, np.empty(0, _POST)]), pa.array(np.repeat(np.arange(len(posts)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(flat["token"]), pa.array(flat["before"]), pa.array(flat["most"]), pa.array(flat["df"]), part.column("n").take(owner), part.column("set").take(owner)], ["list", "before", "most", "df", "n", "set"])

    posts = cut(packed.select("set", "n", "posts").mapInArrow(unroll, "list long, before long, most int, df int, n int, set binary"), "jaccard-posts")
    lists = posts.groupBy("list").agg(F.min("set").alias("lo"), F.max("set").alias("hi"), F.min("before").alias("b_lo"), F.max("before").alias("b_hi"), F.max("df").alias("df"))
    lists = lists.filter("lo <> hi AND b_lo <> b_hi").select("list", "df")
    return cut(beside_lists(posts, lists, salt_rows).select("list", "set", "n", "most", "df"), "jaccard-members")


def beside_hub(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """hub, turn, and packed's columns: each hub (turn 0) before its others in one task; hubs with many others in chunks of about CHUNK."""
    degree = pairs.groupBy("hub").agg(F.count("*").alias("n_others"))
    dealt = pairs.join(degree, "hub").select("hub", "other", F.pmod(F.xxhash64("other"), F.ceil(F.col("n_others") / CHUNK)).alias("chunk"))
    hubs = dealt.select("hub", "chunk", F.lit(0).alias("turn"), F.col("hub").alias("set")).distinct()
    members = hubs.unionByName(dealt.select("hub", "chunk", F.lit(1).alias("turn"), F.col("other").alias("set")))
    few = pairs.count() <= BROADCAST_PAIRS
    rows = packed.join(F.broadcast(members) if few else members, "set")
    return rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "turn").drop("chunk")


def common(ordered: np.ndarray, other: np.ndarray) -> int:
    """How many of other are in ordered; both have no repeats."""
    if not len(ordered):
        return 0
    at = np.searchsorted(ordered, other)
    at[at == len(ordered)] = 0
    return int(np.count_nonzero(ordered[at] == other))


def least_common(n: int, m: int, num: int, den: int) -> int:
    """How many tokens linked sets of these sizes share in their prefixes of one order: what the rest of the larger cannot hold."""
    return max(1, overlap(n, m, num, den) - (least_size(max(n, m), num, den) - 1))


def verified(pairs: DataFrame, packed: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs(hub, other) whose sets link, as a, b: those that pass the length filter and share enough of the prefixes
    of both further orders are compared token by token."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, own = None, 0, []
        for batch in _slices(batches, 200):
            linked: list[tuple] = []
            for h, turn, name, n, *data in zip(*[batch.column(c).to_pylist() for c in ("hub", "turn", "set", "n", "second", "third", "tokens")], strict=True):
                others = [np.frombuffer(d, dtype=np.uint64) for d in data]
                if turn == 0:
                    hub, size, own = h, n, others
                    continue
                if h != hub:
                    raise ValueError("a hub did not come before its others")
                if den * min(size, n) < num * max(size, n) or any(common(a, b) < least_common(size, n, num, den) for a, b in zip(own[:2], others[:2], strict=True)):
                    continue
                both = common(own[2], others[2])
                if den * both >= num * (size + n - both):
                    linked.append((hub, name))
            yield _records(linked, ["a", "b"], [pa.binary(), pa.binary()])

    rows = beside_hub(pairs, packed.select("set", "n", "second", "third", "tokens"))
    return cut(rows.select("hub", "turn", "set", "n", "second", "third", "tokens").mapInArrow(compare, "a binary, b binary"), "jaccard-links")


def star_pairs(members: DataFrame, turn: int, salt_rows: int) -> DataFrame:
    """hub, other: each list's sets beside a hub of another component, where both allow the other's size."""
    # first the set in most lists, the likeliest origin of a group of copies; then any
    rank = -F.col("weight") if turn == 0 else F.xxhash64("set", F.lit(turn))
    best = F.min(F.struct(rank.alias("rank"), F.col("set").alias("hub"), F.col("n").alias("hub_n"), F.col("most").alias("hub_most"), F.col("component").alias("hub_component")))
    hubs = members.groupBy("list").agg(best.alias("x"), F.max("df").alias("df")).select("list", "df", "x.hub", "x.hub_n", "x.hub_most", "x.hub_component")
    return beside_lists(members, hubs, salt_rows).filter("component <> hub_component AND n <= hub_most AND hub_n <= most").select("hub", F.col("set").alias("other"))


def left_pairs(members: DataFrame, salt_rows: int) -> DataFrame:
    """hub, other: all pairs of a list whose components differ and whose sizes both allow; sets outside the list's largest part are the hubs."""
    parts = members.groupBy("list", "component").agg(F.count("*").alias("held"), F.max("df").alias("df"))
    main = parts.groupBy("list").agg(F.max(F.struct("held", "component")).alias("x"), F.max("df").alias("df")).select("list", "df", F.col("x.component").alias("main"))
    marked = beside_lists(members, main, salt_rows).withColumn("outside", F.col("component") != F.col("main"))
    hubs = marked.filter("outside").select(F.col("list").alias("hub_list"), "df", F.col("set").alias("hub"), F.col("n").alias("hub_n"), F.col("most").alias("hub_most"), F.col("component").alias("hub_component"))
    left = marked.withColumn("salt", F.pmod(F.xxhash64("set"), salt_of(F.col("df"), salt_rows)).cast("int")).drop("df")
    right = hubs.withColumn("hub_salt", F.explode(F.sequence(F.lit(0), salt_of(F.col("df"), salt_rows) - 1))).drop("df")
    on = "list = hub_list AND salt = hub_salt AND component <> hub_component AND n <= hub_most AND hub_n <= most AND (NOT outside OR hub < set)"
    return left.join(right, F.expr(on)).select("hub", F.col("set").alias("other"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN, rounds: int = ROUNDS, salt_rows: int = SALT_ROWS, detail: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """id, n_shingles, component_id of every row, for links of Jaccard similarity num / den or more.

    Null, empty and blank texts have no shingles and are linked with nothing: their component is their own id. With
    fewer words than a shingle the whole sequence is the one shingle. Null ids take part, but name no component:
    a component without any id has a null one. Repeated rows have equal sets and share a component.
    Other columns are not read; an empty table gives an empty result. Shingles are hashed to 64 bits, sets to 128.
    With detail also row_key and group, which names the component whatever its ids; null without shingles.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6  # about the number of tokens
    rows = counted_rows(texts, int(max(8, size // (2 * SAMPLED * BUCKET_TOKENS))), words, num, den)
    needed = cut(rows.filter("alive").groupBy("set").agg(F.min("row_key").alias("row_key"), F.min("n_shingles").alias("n_shingles")), "jaccard-needed")
    packed = shared_sets(texts, needed, words, num, den, most_bits)
    members = candidate_lists(packed, salt_rows)
    weights = members.groupBy("set").agg(F.count("*").alias("weight"))
    members, tried, parts = members.join(weights, "set").withColumn("component", F.col("set")), None, None
    for turn in range(rounds + 1):
        live = members.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("df").alias("df")).filter("lo < hi").select("list", "df")
        members = cut(beside_lists(members, live, salt_rows), "jaccard-live")
        if members.isEmpty():
            break
        met = star_pairs(members, turn, salt_rows) if turn < rounds else left_pairs(members, salt_rows)
        pairs = met.distinct()
        if tried is not None:
            seen = tried.unionByName(tried.select(F.col("other").alias("hub"), F.col("hub").alias("other")))
            pairs = pairs.join(seen, ["hub", "other"], "left_anti")
        pairs = cut(pairs, "jaccard-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = verified(pairs, packed, num, den)
        # of earlier links each node's to its component is as good as all
        parts = connected(new if parts is None else new.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        if turn < rounds:
            members = members.drop("component").join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    named = rows.groupBy("set").agg(F.min("id").alias("least")).filter("set IS NOT NULL")
    if parts is not None:
        named = named.join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        whole = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(whole, "component")
    else:
        named = named.withColumns({"component_id": F.col("least"), "component": F.col("set")})
    out = rows.join(named.select("set", "component_id", "component"), "set", "left")
    more = [F.col("row_key"), F.col("component").alias("group")] if detail else []
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *more)
