"""Exact top-k inner products by MaxScore, over packed shards of integer vectors.

A vector's dimensions are its terms. In a shard a term's bound for a query is the most that it can add
to a score. Terms whose bounds together cannot lift any vector over the query's current k-th score are
non-essential: the essential terms are multiplied out for the whole shard, and only vectors still
competitive with the bounds of the rest are probed on it. The terms are split apart for each few like queries (LIKE).

Queries and vectors meet on a grid of about equal sides in bytes: every part of the queries visits every group of shards, carries its
k-th scores through the group, and the groups' results merge. Vectors travel as the narrowest integers that hold them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut

#: Rows a shard, queries a part and shards a group at most, queries whose terms are split together, terms probed at a time, and tasks a core.
SHARD_ROWS, QUERY_ROWS, GROUP_SHARDS, LIKE, PROBED, TASKS = 4096, 32_768, 64, 16, 8, 3
#: Integers up to these are exact in 32-bit and 64-bit floats.
EXACT_SINGLE, EXACT = float(1 << 24), float(1 << 53)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id, vec array<long>: floor(scale * x); null ids, null vectors and those with null or non-finite parts go."""
    part = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", part))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("vec"))


def pack(rows: DataFrame, block_rows: int, name: str) -> tuple[DataFrame, int]:
    """block, width, kind, ids, vecs: each block's rows by id, as the bytes of the narrowest integers; and the number of blocks."""

    def packed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        width = int(pdf["vec"].map(len).max())
        vecs = np.zeros((len(pdf), width), dtype=np.int64)
        for k, v in enumerate(pdf["vec"]):
            vecs[k, : len(v)] = v
        kind = next(t for t in ("<i2", "<i4", "<i8") if not vecs.size or np.iinfo(t).min <= vecs.min() and vecs.max() <= np.iinfo(t).max)
        return pd.DataFrame({"block": [key[0]], "width": [width], "kind": [kind], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vecs": [vecs.astype(kind).tobytes()]})

    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)))
    return cut(dealt.groupBy("block").applyInPandas(packed, "block long, width int, kind string, ids binary, vecs binary"), name), blocks


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype=np.int64)
    return ids, np.frombuffer(row.vecs, dtype=row.kind).reshape(len(ids), row.width)


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Best:
    """The k best vectors so far of each query, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.theta = np.full(n, -np.inf)

    def take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        got_ids, got = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores.astype(np.int64)])
        best = np.lexsort((got_ids, -got))[: self.k]
        self.ids[i], self.scores[i] = got_ids[best], got[best]
        if len(best) == self.k:
            self.theta[i] = float(self.scores[i][-1])


def like_queries(q: np.ndarray) -> list[np.ndarray]:
    """The queries in runs of LIKE whose heaviest terms, and their signs, agree as far as may be."""
    heavy = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :3] if q.shape[1] else np.zeros((len(q), 0), np.int64)
    signed = 2 * heavy + (np.take_along_axis(q, heavy, axis=1) < 0)
    order = np.lexsort(tuple(signed[:, j] for j in reversed(range(signed.shape[1])))) if signed.shape[1] else np.arange(len(q))
    return [order[k : k + LIKE] for k in range(0, len(order), LIKE)]


def max_score(q_ids: np.ndarray, q: np.ndarray, shards: Iterable[tuple[np.ndarray, np.ndarray]], k: int, skipped: list[int] | None = None) -> Best:
    """For each query the ids and scores of its k best vectors over the shards; its own id is no candidate.

    skipped, if given, gets the number of non-essential terms of each visit.
    """
    best, runs = Best(len(q), k), like_queries(q)
    for x_ids, x in shards:
        width = max(q.shape[1], x.shape[1])
        a, b = _widened(q, width), _widened(x, width).T
        low, high = b.min(axis=1).astype(float), b.max(axis=1).astype(float)
        most = float((np.abs(a.astype(float)) * np.maximum(np.abs(low), np.abs(high))).sum(axis=1).max(initial=0))
        kind = np.float32 if most < EXACT_SINGLE else np.float64 if most < EXACT else object  # beyond 2**53 as Python's integers
        b = np.ascontiguousarray(b.astype(kind))
        for run in runs:
            visit(best, run, q_ids, a[run].astype(kind), x_ids, b, low, high, kind, skipped)
    return best


def visit(best: Best, run: np.ndarray, q_ids: np.ndarray, a: np.ndarray, x_ids: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, kind, skipped: list[int] | None) -> None:
    """One run of like queries over one shard; b holds a row for each term."""
    wide, theta = a.astype(float), best.theta[run]
    bound, least = np.maximum(wide * low, wide * high), np.minimum(wide * low, wide * high)
    slack = 1e-9 * np.abs(wide).max(initial=0) * np.maximum(np.abs(low), np.abs(high)).sum() if kind is object else 0.0  # floats only bound such products
    by_bound = np.argsort((bound - least).sum(axis=0), kind="stable")
    # the score of a vector that only the first terms lift: all others at their least
    lifted = least.sum(axis=1)[:, None] + (bound - least)[:, by_bound].cumsum(axis=1)
    can_skip = (lifted + slack < theta[:, None]).all(axis=0)
    rest_n = int(can_skip.argmin()) if not can_skip.all() else len(b)
    if skipped is not None:
        skipped.append(rest_n)
    if rest_n == len(b) and len(b):
        return  # no vector of this shard reaches any of these queries' k-th score
    rest, essential = by_bound[:rest_n][::-1], by_bound[rest_n:]
    part, cols, left = a[:, essential] @ b[essential], np.arange(len(x_ids)), bound[:, rest].sum(axis=1) + slack
    for k in range(0, rest_n + 1, PROBED):  # while any of these queries may take a vector it is probed on the next terms
        open_ = (part.astype(float) + left[:, None] >= theta[:, None]).any(axis=0)
        if open_.sum() < 0.8 * len(cols):
            cols, part = cols[open_], part[:, open_]
        probe = rest[k : k + PROBED]
        if len(probe):
            part = part + a[:, probe] @ (b[probe] if len(cols) == len(x_ids) else b[np.ix_(probe, cols)])
            left = left - bound[:, probe].sum(axis=1)
    found_ids = x_ids[cols]
    for i, of in enumerate(run):
        at = np.flatnonzero((part[i] >= theta[i]) & (found_ids != q_ids[of])) if theta[i] > -np.inf else np.flatnonzero(found_ids != q_ids[of])
        full = part[i, at]
        if len(at) > 4 * best.k and kind is not object:
            at, full = _upper(at, full, best.k)
        if len(at):
            best.take(of, found_ids[at], full)


def _upper(at: np.ndarray, full: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All entries at or above the k-th largest, ties included."""
    keep = full >= np.partition(full, len(full) - k)[len(full) - k]
    return at[keep], full[keep]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k best others.

    Vectors that are null, or hold null or non-finite parts, and null ids take no part. Shorter vectors count as
    filled with zeros. Repeated rows (equal id and vector) are one; a row with the query's id is never a
    candidate of it. Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = cut(integer_vectors(vectors, id_col, vector_col, scale).distinct(), "topk-vectors")
    n_rows, n_asked = rows.count(), rows.filter(F.col("vec_id") % every == 0).count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a grid of parts by groups with enough tasks; each row of queries and each shard travels as often as the other side is long
    tasks = TASKS * spark.sparkContext.defaultParallelism
    parts = max(-(-n_asked // query_rows), min(n_asked, round((tasks * n_asked / n_rows) ** 0.5), tasks))
    shards, n_shards = pack(rows, shard_rows, "topk-shards")
    asked, n_parts = pack(rows.filter(F.col("vec_id") % every == 0), -(-n_asked // max(1, parts)), "topk-queries")
    n_groups = min(n_shards, max(-(-n_shards // group_shards), -(-tasks // n_parts)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    visited = shards.withColumn("group", F.pmod("block", F.lit(n_groups))).withColumn("asked", each(n_parts))
    visiting = asked.withColumnRenamed("block", "asked").withColumn("group", each(n_groups))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q_ids, q = _unpack(next(left.to_pandas().itertuples()))
            best = max_score(q_ids, q, (_unpack(r) for r in right.sort_by("block").to_pandas().itertuples()), k)
            out = {"query_id": [np.repeat(q_ids, [len(x) for x in best.ids])], "vec_id": best.ids, "score": best.scores}
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.int64()) for n, v in out.items()})

    found = visiting.groupBy("asked", "group").cogroup(visited.groupBy("asked", "group")).applyInArrow(meet, "query_id long, vec_id long, score long")
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", turn.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
