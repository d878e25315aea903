"""Questions about a collection: rules its fields obey, fields that versions lack, names for labels, flat results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.coerce import DECIMAL
from ..functions.text import MINED, fuzzy_share

#: Columns of a wide table at most, if they come from the data.
MOST_COLUMNS = 2_000


def mine_rules(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, required, min, max, pattern for each group of values(keys, text): bounds if all are numbers, else the first pattern that all match.

    Aggregates that combine within tasks, so a field of the whole collection is one group without skew.
    """
    text = F.trim("text")
    rows = values.filter(text != "").withColumn("t", text).withColumn("n", F.when(F.col("t").rlike(DECIMAL), F.col("t").try_cast("double")))
    rules = rows.groupBy(*keys).agg(F.bool_and(F.col("n").isNotNull()).alias("numeric"), F.min("n").alias("lo"), F.max("n").alias("hi"), *[F.bool_and(F.col("t").rlike(look)).alias(f"p{k}") for k, (look, _) in enumerate(MINED)])
    pattern = F.coalesce(*[F.when(F.col(f"p{k}"), rule) for k, (_, rule) in enumerate(MINED)])
    return rules.select(*keys, F.lit(True).alias("required"), F.when(F.col("numeric"), F.col("lo")).alias("min"), F.when(F.col("numeric"), F.col("hi")).alias("max"), F.when(~F.col("numeric"), pattern).alias("pattern"))


def missing_fields(fields: DataFrame) -> DataFrame:
    """schema, version, field, found_in (versions that have it), turn: fields of other versions that a version lacks.

    turn orders them by sheet, computed ones last, then by name, without case.
    """
    have = fields.groupBy("schema", "field").agg(F.array_distinct(F.array_sort(F.collect_list("version"))).alias("found_in"), F.min(F.lower(F.coalesce("f_sheet", F.lit("")))).alias("sheet"), F.bool_and(F.col("ref_kind") == "computed").alias("computed"))
    versions = fields.select("schema", "version").distinct()
    lacking = versions.join(have, "schema").join(fields.select("schema", "version", "field"), ["schema", "version", "field"], "left_anti")
    turn = F.row_number().over(W.partitionBy("schema", "version").orderBy("computed", "sheet", F.lower("field"), "field"))
    return lacking.withColumn("turn", turn).select("schema", "version", "field", "found_in", "turn")


def fuzzy_names(labels: DataFrame, names: DataFrame) -> DataFrame:
    """slug, name, share: for each label slug the known field name that shares most of its words, half at least; equal ones go by name.

    Words agree only if they begin alike, so labels and names meet by the first letters of their words.
    """
    firsts = lambda c: F.explode(F.array_distinct(F.transform(F.split(c, "_"), lambda w: F.substr(w, F.lit(1), F.lit(1))))).alias("first")
    one, other = labels.select("slug").distinct(), names.select("name").distinct()
    pairs = one.select("slug", firsts(F.col("slug"))).join(other.select("name", firsts(F.col("name"))), "first").select("slug", "name").distinct()
    met = pairs.withColumn("share", fuzzy_share(F.col("slug"), F.col("name"))).filter("share >= 0.5")
    best = met.groupBy("slug").agg(F.max("share").alias("share"), F.min_by("name", F.struct(-F.col("share"), F.col("name"))).alias("name"))
    return best.select("slug", "name", "share")


def rendered(value: Column, kind: str) -> Column:
    """A value as shown: booleans in capitals, nested values as JSON, null as empty text."""
    shown = F.upper(value.cast("string")) if kind == "boolean" else F.to_json(value) if kind.startswith(("array", "map", "struct")) else value.cast("string")
    return F.coalesce(shown, F.lit(""))


def render(records: DataFrame) -> DataFrame:
    """The records with every column but doc_id as shown text."""
    return records.select(*[F.col(f.name) if f.name == "doc_id" else rendered(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in records.schema.fields])


def flatten(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, path, value of every leaf of the records: dotted paths with positions from 0; an empty list or map is one empty value."""
    leaf = lambda p, v: F.struct(p.alias("path"), v.cast("string").alias("value"))
    parts = []
    for f in records.schema.fields:
        if f.name == key:
            continue
        kind, c = f.dataType.simpleString(), F.col(f.name)
        dot = F.lit(f"{f.name}.")
        if kind.startswith("array<map"):
            nested = F.flatten(F.transform(c, lambda m, i: F.when(F.size(m) > 0, F.transform(F.map_entries(m), lambda e, i=i: leaf(F.concat(dot, i.cast("string"), F.lit("."), e["key"]), e["value"]))).otherwise(F.array(leaf(F.concat(dot, i.cast("string")), F.lit(""))))))
            parts.append(F.when(F.size(c) > 0, nested).otherwise(F.array(leaf(F.lit(f.name), F.lit("")))))
        elif kind.startswith("array"):
            parts.append(F.when(F.size(c) > 0, F.transform(c, lambda v, i: leaf(F.concat(dot, i.cast("string")), v))).otherwise(F.array(leaf(F.lit(f.name), F.lit("")))))
        elif kind.startswith("map"):
            parts.append(F.when(F.size(c) > 0, F.transform(F.map_entries(c), lambda e: leaf(F.concat(dot, e["key"]), e["value"]))).otherwise(F.array(leaf(F.lit(f.name), F.lit("")))))
        else:
            parts.append(F.array(leaf(F.lit(f.name), c)))
    return records.select(key, F.explode(F.concat(*parts)).alias("leaf")).select(key, "leaf.path", "leaf.value")


def union_columns(flat: DataFrame) -> DataFrame:
    """All paths of a batch's flat results: its columns."""
    return flat.select("path").distinct()


def wide(flat: DataFrame, paths: list[str], key: str = "doc_id") -> DataFrame:
    """One row a document with a column for each of the given paths."""
    return flat.filter(F.col("path").isin(paths)).groupBy(key).pivot("path", paths).agg(F.first("value"))


def found_paths(flat: DataFrame, most: int = MOST_COLUMNS) -> list[str] | None:
    """The paths of a batch's flat results in order, numbers in them by value; None if there are more than `most`."""
    paths = [r.path for r in union_columns(flat).limit(most + 1).collect()]
    return None if len(paths) > most else sorted(paths, key=lambda p: [(not part.isdigit(), int(part) if part.isdigit() else 0, part) for part in p.split(".")])


def wide_or_long(flat: DataFrame, key: str = "doc_id", most: int = MOST_COLUMNS) -> tuple[DataFrame, bool]:
    """One row a document with a column for each path that the batch has, and True; the flat results as they are, and False, where that were more than `most` columns.

    A pass over the paths alone comes first; what the driver holds of it is bounded by `most`.
    """
    paths = found_paths(flat, most)
    return (flat, False) if paths is None else (wide(flat, paths, key), True)
