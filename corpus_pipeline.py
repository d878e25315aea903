"""The corpus pipeline: documents in, encoded training documents out.

Every stage takes any table of documents: null and empty texts, null ids and repeated rows each have a defined result
below, an empty table gives an empty one, and other columns come through as they are, whatever their names; only names
that begin with two underscores are the stages' own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm import byte_bpe, exact_dedup, jaccard_join, mixing, toxicity
from sheetwright.sources.melt import read as table
from sheetwright.sources.shared import cut

TOXIC = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC, repeated rows each; null and empty texts stay if the empty text does. Labels of ids that
    documents lack are not read; without enough labels nothing is learned, and nothing rejected unless most labels are toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, name="__toxicity", keep=True).filter(F.col("__toxicity") < TOXIC).drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space; null, empty and blank texts are one group."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts, the one with the smallest id (null ids last), then hash of id and text; all without shingles stay."""
    groups = jaccard_join.components(docs, detail=True).filter("group IS NOT NULL")
    rows = groups.groupBy("group", "doc_id", "row_key").agg(F.count("*").alias("n"))
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("__id"), F.col("row_key").alias("__kept"), "n")).alias("b"))
    kept = cut(best.select("b.__id", "b.__kept", "b.n"), "near-kept")
    keyed = docs.withColumn("__key", F.xxhash64("text", F.col("doc_id").cast("long")))
    same = (F.col("__key") == F.col("__kept")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    blank = docs.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    out = blank.unionByName(keyed.join(kept.filter("n = 1"), same, "left_semi").drop("__key"))
    repeated = kept.filter("n > 1")  # rows equal in id and text
    return out if repeated.isEmpty() else out.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["__key", "doc_id"]).drop("__key"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it (half of its words at least), in its shard's shuffled order.

    Texts without words are never drawn. Rows equal in id and text are drawn as often as one of them is; null ids are told apart by their texts.
    """
    mixed = mixing.mix(docs, carry=("text",), shards=mixing.shards_for(docs.count()))
    draws = mixed.dropDuplicates(["doc_id", "carried_text"]).select(F.col("doc_id").alias("__id"), F.col("carried_text").alias("__text"), F.explode(F.filter("draws", lambda d: d["words"] * 2 >= F.col("size"))).alias("__draw"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text"))
    out = docs.join(draws, same).repartition("__draw.shard").sortWithinPartitions("__draw.shard", "__draw.position", "doc_id")
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every document; null and empty texts have none."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The mix draws by seeded hashes and numpy's generators, which SQL cannot repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
