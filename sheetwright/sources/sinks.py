"""Where results go."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import rendered, wide
from .layout import whole


def with_provenance(records: DataFrame, resolved: DataFrame, docs: DataFrame) -> DataFrame:
    """Records with _source_file, _source_path and _discriminator_cell (<inferred> where the layout decided)."""
    source = docs.join(whole(resolved.select("doc_id", "matched_cell")), "doc_id").select(
        "doc_id", F.regexp_extract("path", "[^/]+$", 0).alias("_source_file"), F.col("path").alias("_source_path"), F.coalesce("matched_cell", F.lit("<inferred>")).alias("_discriminator_cell")
    )
    return source.join(whole(records), "doc_id")


def json_lines(records: DataFrame, failures: DataFrame, docs: DataFrame) -> DataFrame:
    """value: one JSON object a document, {file, data} or {file, error}."""
    data = F.struct(*[c for c in records.columns if c != "doc_id"])
    good = docs.join(whole(records), "doc_id").select("path", F.to_json(F.struct(F.col("path").alias("file"), data.alias("data"))).alias("value"))
    bad = docs.join(whole(failures), "doc_id").select("path", F.to_json(F.struct(F.col("path").alias("file"), F.col("message").alias("error"))).alias("value"))
    return good.unionByName(bad)


def write_json(records: DataFrame, failures: DataFrame, docs: DataFrame, path: str, ordered: bool = False) -> None:
    """JSON lines; ordered sorts all of them by path, only here at the sink."""
    lines = json_lines(records, failures, docs)
    (lines.orderBy("path") if ordered else lines).select("value").write.text(path)


def table_path(path: str, schema: str, version: str) -> str:
    """Where a version's records go: a folder each, as versions have columns of their own."""
    safe = lambda name: re.sub(r"[^A-Za-z0-9_.-]", lambda m: f"%{ord(m[0]):02X}", name)
    return f"{path}/schema={safe(schema)}/version={safe(version)}"


def write_records(records: DataFrame, schema: str, version: str, path: str) -> None:
    """Appends a version's records to its own table. Columns may come and go from one batch to the next."""
    records.write.mode("append").parquet(table_path(path, schema, version))


def read_records(spark: SparkSession, schema: str, version: str, path: str) -> DataFrame:
    """A version's records with the columns of all its batches, typed; null where a batch lacked one."""
    return spark.read.option("mergeSchema", "true").parquet(table_path(path, schema, version))


def read_all_records(spark: SparkSession, versions: list[tuple[str, str]], path: str) -> DataFrame:
    """schema, version and the columns of all these versions; where two of them differ in a column's type, it is text."""
    tables = [(s, v, read_records(spark, s, v, path)) for s, v in versions]
    kinds: dict[str, set[str]] = {}
    for _, _, t in tables:
        for f in t.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    out = None
    for s, v, t in tables:
        shown = t.withColumns({f.name: rendered(F.col(f.name), f.dataType.simpleString()) for f in t.schema.fields if len(kinds[f.name]) > 1})
        one = shown.select(F.lit(s).alias("schema"), F.lit(v).alias("version"), *t.columns)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_csv(flat: DataFrame, paths: list[str], path: str, resolved: DataFrame | None = None, docs: DataFrame | None = None) -> None:
    """Flat results as CSV: a column a path, all quoted, nulls empty; with resolved and docs the columns of with_provenance come first."""
    rows = wide(flat, paths)
    if resolved is not None and docs is not None:
        rows = with_provenance(rows, resolved, docs).drop("doc_id")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
