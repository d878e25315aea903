"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a hash. A source's target says how often its blocks are
drawn: as many full passes as fit, then blocks in permuted order until the rest of the target, the last of
them in part. The tree splits the draws of all sources among the output shards, halving the shards at each
node and splitting the counts there by one multivariate-hypergeometric draw, so every shard gets its exact
share and no two shards get the same draw. Within a shard the documents are in hash order.

The tree on the driver has at most BINS counts (sources hashed into bins) and `shards` leaves; each bin
then splits its counts among its own sources in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut

#: Fixed values of the mix: the weights repeat over the sources in code-point order.
WEIGHTS, CAP = (5, 2, 1), 3
BLOCK_DOCS, SHARDS, BINS, SEED = 512, 32, 256, 7
#: A source's blocks are put in turn by ranges of so many leading bits of a hash.
TURN_BITS = 10
#: Documents a shard where the number of shards follows the table, and the most shards.
SHARD_DOCS, MOST_SHARDS = 100_000, 4096


def shards_for(documents: int) -> int:
    return min(MOST_SHARDS, max(SHARDS, -(-documents // SHARD_DOCS)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target from source, source_size: shares by weight, none above cap times its size.

    Sources sorted by size over weight fill up in that order; the first that its share does not fill sets
    the level for all that follow. One row a source goes through these windows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    everything, fill = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumns({"at": F.row_number().over(fill), "total": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything)})
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"full": F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)), "left": F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    rows = rows.withColumn("holds", (F.col("total") - F.col("full")) * F.col("weight") <= cap * F.col("source_size") * F.col("left"))
    rows = rows.withColumn("first", F.min(F.when(F.col("holds"), F.col("at"))).over(everything))
    rows = rows.withColumns({k: F.max(F.when(F.col("at") == F.col("first"), F.col(k))).over(everything) for k in ("full", "left")})
    share = (F.col("total") - F.col("full")).cast("double") * F.col("weight") / F.col("left")
    return rows.select("source", "source_size", "weight", F.when(F.col("at") < F.col("first"), (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def splitting_tree(counts: np.ndarray, quotas: np.ndarray, seed: int) -> np.ndarray:
    """How many of each count each leaf gets: a matrix of leaves by counts whose rows sum to quotas, columns to counts."""
    out = np.zeros((len(quotas), len(counts)), dtype=np.int64)
    todo = [(0, len(quotas), counts.astype(np.int64), 1)]
    while todo:
        lo, hi, here, node = todo.pop()
        if hi - lo == 1:
            out[lo] = here
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, node & 0xFFFFFFFF, node >> 32])
        left = rng.multivariate_hypergeometric(here, int(quotas[lo:mid].sum()), method="marginals") if here.sum() else here
        todo += [(lo, mid, left, 2 * node), (mid, hi, here - left, 2 * node + 1)]
    return out


def shard_plan(draws: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """source, bounds: for each source the running number of its draws that go to the shards 0, 1, ... up to each.

    draws: source, draws (long).
    """
    binned = draws.withColumn("bin", F.pmod(F.xxhash64("source"), F.lit(BINS)).cast("int"))
    totals = {r["bin"]: int(r["n"]) for r in binned.groupBy("bin").agg(F.sum("draws").alias("n")).collect()}  # at most BINS rows
    counts = np.array([totals.get(b, 0) for b in range(BINS)], dtype=np.int64)
    quotas = np.full(shards, counts.sum() // shards, dtype=np.int64)
    quotas[: counts.sum() % shards] += 1
    of_bin = splitting_tree(counts, quotas, seed)  # shards x BINS numbers

    def split(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        got = splitting_tree(pdf["draws"].to_numpy(np.int64), of_bin[:, key[0]], seed + 1 + key[0])
        return pd.DataFrame({"source": pdf["source"].to_numpy(object), "bounds": list(got.cumsum(axis=0).T)})

    return binned.groupBy("bin").applyInPandas(split, "source string, bounds array<long>")


def blocks_in_turn(blocks: DataFrame, seed: int) -> DataFrame:
    """Blocks (source, block, words) in permuted order, with before (words of those before), turn (from 0) and n, the source's blocks.

    Sums go over the blocks of a range of hashes, 2**TURN_BITS a source, and then over the ranges, so that no task gets all blocks of a source.
    """
    rows = blocks.withColumn("h", F.xxhash64("source", "block", F.lit(seed + 1))).withColumn("range", F.shiftright("h", 64 - TURN_BITS).cast("int"))
    ranges = rows.groupBy("source", "range").agg(F.sum("words").alias("r_words"), F.count("*").alias("r_n"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # at most 2**TURN_BITS rows a source
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), none(F.sum("r_words").over(earlier)).alias("r_words"), none(F.sum("r_n").over(earlier)).alias("r_turn"), F.sum("r_n").over(W.partitionBy("source")).alias("n"))
    inside = W.partitionBy("source", "range").orderBy("h", "block")
    rows = rows.withColumns({"w_words": F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"), "w_turn": F.row_number().over(inside) - 1})
    met = rows.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    return met.withColumns({"before": F.col("r_words") + F.col("w_words"), "turn": F.col("r_turn") + F.col("w_turn")}).drop("h", "range", "r_source", "r_range", "r_words", "r_turn", "w_words", "w_turn")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_docs: int = BLOCK_DOCS, shards: int = SHARDS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: id, size, source_size, target, taken, draws array<struct<pass, shard, position, words>>.

    Words are runs without ASCII white space; null and empty texts have size 0 and are never taken. A null
    source is a source of its own, last in order. Each source's taken words are its target, rounded; only
    the document at the end of a source's last drawn block may be taken in part. Documents with equal id, source and size
    are interchangeable, so repeated rows and null ids don't matter and reruns agree. Very long texts count like others, by
    their words. Columns in carry go along, hashed; others are not read. An empty table gives an empty result. The tree's draws are blocks, below 10**9
    of them: block_docs times as many documents.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), *[F.xxhash64(F.col(c)).alias(f"carried_{c}") for c in carry]), "mix-sizes")
    blocks = max(1, -(-rows.count() // block_docs))
    rows = rows.withColumn("order_key", F.xxhash64("id", "source", "size", F.lit(seed)))
    rows = rows.withColumn("block", F.pmod("order_key", F.lit(blocks)))
    held = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    aim = cut(targets(held.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap), "mix-targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = aim.withColumn("passes", whole.cast("long")).withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    plan = held.join(goal, same(held, goal)).drop(goal["source"]).filter("words > 0")
    plan = blocks_in_turn(plan, seed)
    plan = plan.withColumn("part", F.least("words", F.greatest(F.col("rest") - F.col("before"), F.lit(0))))
    drawn = plan.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).withColumn("quota", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("part"))).filter("quota > 0")
    drawn = cut(drawn.select("source", "block", "pass", "quota", (F.col("pass") * F.col("n") + F.col("turn")).alias("seq")), "mix-draws")
    bounds = shard_plan(drawn.groupBy("source").agg(F.count("*").alias("draws")), shards, seed)
    placed = drawn.join(bounds, same(drawn, bounds), "left").drop(bounds["source"])
    placed = placed.withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("seq"))))
    by_block = placed.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "quota"))).alias("turns"))

    inside = W.partitionBy("source", "block").orderBy("order_key", "id", "size")
    rows = rows.withColumn("before", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(by_block, same(rows, by_block) & (rows["block"] == by_block["block"]), "left").drop(by_block["source"], by_block["block"])
    took = F.transform("turns", lambda t: F.struct(t["pass"].alias("pass"), t["shard"].alias("shard"), F.xxhash64(F.col("order_key"), t["pass"]).alias("position"), F.least(F.col("size"), F.greatest(t["quota"] - F.col("before"), F.lit(0))).alias("words")))
    rows = rows.withColumn("draws", F.coalesce(F.filter(took, lambda t: t["words"] > 0), F.array().cast("array<struct<pass:bigint,shard:int,position:bigint,words:bigint>>")))
    rows = rows.join(aim, same(rows, aim), "left").drop(aim["source"])
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, t: a + t["words"])
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "draws", *[f"carried_{c}" for c in carry])


def shard_rows(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """shard, position, id, pass, words: the output shards, each in its shuffled order."""
    flat = mixed.select(id_col, F.explode("draws").alias("d")).select("d.shard", "d.position", id_col, "d.pass", "d.words")
    return flat.repartition("shard").sortWithinPartitions("shard", "position", id_col)
