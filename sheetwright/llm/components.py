"""Connected components of a table of links, by trees within tasks and alternating large-star and small-star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut, drop

#: Links that a task joins to trees (some 40 MB of Python objects).
TREE_LINKS = 100_000
_PLAIN = (T.BinaryType, T.StringType, T.IntegralType)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _trees(links: DataFrame, tasks: int) -> DataFrame:
    """a, b: each task's links as the smallest node b that each of their nodes a reaches by them, itself included."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        kind = pa.binary()

        def root(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                above.setdefault(a, a)
                above.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([root(x) for x in above], kind)], ["a", "b"])

    return links.coalesce(tasks).mapInArrow(joined, T.StructType([T.StructField(f.name, f.dataType) for f in links.schema.fields]))


def connected(links: DataFrame, tree_links: int = TREE_LINKS) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(a, b), of any one type that has an order.

    A task first joins up to tree_links links to trees, so that at most an edge a node of them goes on, and links that fit one task are done. Else
    each step sends all neighbours of a node to its smallest one, with aggregates and joins alone, so a
    hub with very many links is never held in one place; steps stop when the edges no longer change.
    """
    edges, trees = links.filter("a <> b").select("a", "b"), None
    if isinstance(links.schema["a"].dataType, _PLAIN):
        tasks = -(-edges.count() // tree_links) or 1
        trees = cut(_trees(edges, tasks), "trees")
        if tasks == 1:
            return trees.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = trees.filter("a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if trees is not None:
        drop(trees)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        old, edges = edges, cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
        before, mark = mark, _mark(edges)
        drop(old)
        if mark == before:
            break
    pointed = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return pointed.unionByName(pointed.select(F.col("component").alias("node"), "component").distinct())
