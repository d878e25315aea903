"""Registries of templates as tables: inheritance resolved by joins, for collections of more versions than a driver should hold.

A registry is two tables: versions (schema, version, extends; null extends nothing) and own fields (schema, version, field, field_ord
and whatever describes a field).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut, drop

VERSION = ["schema", "version"]
#: More doublings than any chain needs: 2 to this many ancestors.
MOST_ROUNDS = 40


def ancestors(versions: DataFrame) -> DataFrame:
    """schema, version, ancestor, depth: every version with itself (depth 0) and all that it extends, nearest first; those of a cycle too, each once.

    By pointer doubling: each round joins what is known of a version with what is known of its farthest ancestor, so that a chain of n
    versions takes log2(n) rounds. A chain that comes back to a version it has met ends there.
    """
    spark = versions.sparkSession
    up = versions.filter("extends IS NOT NULL").select(*VERSION, F.col("extends").alias("ancestor"))
    known = cut(versions.select(*VERSION, F.col("version").alias("ancestor"), F.lit(0).cast("long").alias("depth")).unionByName(up.select(*VERSION, "ancestor", F.lit(1).cast("long").alias("depth"))).groupBy(*VERSION, "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
    n = known.count()
    for _ in range(MOST_ROUNDS):
        farthest = known.groupBy(*VERSION).agg(F.max_by(F.struct("ancestor", "depth"), F.struct("depth", "ancestor")).alias("far"))
        on = farthest.select("schema", "version", F.col("far.ancestor").alias("via"), F.col("far.depth").alias("d"))
        beyond = known.select("schema", F.col("version").alias("via"), "ancestor", F.col("depth").alias("e"))
        more = on.join(beyond, ["schema", "via"]).select(*VERSION, "ancestor", (F.col("d") + F.col("e")).alias("depth"))
        longer = cut(known.unionByName(more).groupBy(*VERSION, "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
        drop(known)
        known, before, n = longer, n, longer.count()
        if n == before:
            return known
    raise ValueError(f"chains of more than 2 to the {MOST_ROUNDS} versions")


def inheritance_errors(versions: DataFrame, chain: DataFrame) -> DataFrame:
    """schema, version, error: `cycle` for versions whose chain comes back, `unknown parent` for those whose chain leaves the registry."""
    size = chain.groupBy(*VERSION).agg(F.count("*").alias("n"))
    up = versions.select("schema", F.col("version").alias("ancestor"), "extends")
    ends = chain.join(up, ["schema", "ancestor"], "left").groupBy(*VERSION).agg(
        F.bool_or(F.col("extends").isNull()).alias("ends"), F.max_by("ancestor", "depth").alias("last")
    )
    there = versions.select("schema", F.col("version").alias("last"), F.lit(True).alias("known"))
    found = ends.join(size, VERSION).join(there, ["schema", "last"], "left")
    error = F.when(F.col("known").isNull(), "unknown parent").when(~F.col("ends"), "cycle")
    return found.withColumn("error", error).filter("error IS NOT NULL").select(*VERSION, "error")


def resolve(versions: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fields of every sound version, its own and inherited ones, with place (from 0) and origin; and the errors of the others.

    Of equal names the nearest version's counts, in the place where the farthest one has it: parents' fields come first.
    """
    chain = ancestors(versions)
    wrong = cut(inheritance_errors(versions, chain), "registry-errors")
    sound = chain.join(wrong.select(*VERSION), VERSION, "left_anti")
    own = fields.withColumnRenamed("version", "origin")
    every = sound.withColumnRenamed("ancestor", "origin").join(own, ["schema", "origin"])
    name = W.partitionBy(*VERSION, "field")
    every = every.withColumns({"turn": F.row_number().over(name.orderBy("depth")), "first": F.max(F.struct("depth", -F.col("field_ord"))).over(name)}).filter("turn = 1")
    place = F.row_number().over(W.partitionBy(*VERSION).orderBy(F.desc("first.depth"), F.desc("first.col2"))) - 1
    return every.withColumn("place", place).drop("turn", "first", "depth", "field_ord"), wrong
