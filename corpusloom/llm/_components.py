"""Connected components by alternating large-star and small-star steps, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

PARTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the m of u. A node with many edges is dealt out over PARTS parts, as any node may be one."""
    parted = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(parted, ["u", "part"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _with_least(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)


def components(scratch: Scratch, edges: DataFrame, u: str, v: str) -> DataFrame:
    """(id, label) of every id that has an edge to another one; label is the least id of its component.

    Each step moves edges towards the least neighbour, and no step gathers the neighbours of an id in one row. It ends when
    a step changes nothing, after about log of the longest path steps.
    """
    now = scratch.keep(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        after = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if after == before or not after[0]:
            break
        new = scratch.keep(_small_star(_large_star(now)).where("u <> v").distinct())
        scratch.drop(now)
        now, before = new, after
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
