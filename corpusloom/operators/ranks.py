"""Ranks inside groups of any size, without a task that sees a whole group.

Rows are counted by group and block of their order; a running sum over these counts gives what comes before each block, and rows are
numbered within blocks. Blocks of a digest are even by nature; blocks of an integer are as even as the integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numeric import radix, seeded

DIGITS = 4  # hex digits of a digest that make a block


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which nulls are equal; keys are taken from a."""
    renamed = b.withColumnsRenamed({k: f"_{k}_" for k in keys})
    condition = None
    for k in keys:
        one = a[k].eqNullSafe(renamed[f"_{k}_"])
        condition = one if condition is None else condition & one
    return a.join(renamed, condition).drop(*[f"_{k}_" for k in keys])


def ranked(df: DataFrame, groups: list[str], block: Column, order: list[Column | str], name: str = "rank", total: str | None = None) -> DataFrame:
    """df with the rank from 1 of each row in its group, by order, and with ``total`` the rows of the group. block: a column
    that ascends with the first column of order. Nulls of groups are a group."""
    df = df.withColumn("_block", block)
    counts = df.groupBy(*groups, "_block").agg(F.count("*").alias("_k"))
    group = W.partitionBy(*groups)
    before = counts.withColumn("_before", F.sum("_k").over(group.orderBy("_block")) - F.col("_k"))
    before = before.withColumn(total, F.sum("_k").over(group)) if total else before
    inner = df.withColumn("_inner", F.row_number().over(W.partitionBy(*groups, "_block").orderBy(*order)))
    return _null_safe(inner, before.drop("_k"), [*groups, "_block"]).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_block", "_before", "_inner")


def seeded_ranks(df: DataFrame, groups: list[str], key: str, seed: int, name: str = "rank", total: str | None = None, digits: int = DIGITS) -> DataFrame:
    """The same in the seeded order of a key: that of digests of seed and key, then of the key."""
    digest = seeded(seed, F.col(key))
    return ranked(df, groups, F.left(digest, F.lit(digits)), [digest, F.col(key)], name, total)


def class_variants(df: DataFrame, class_: str, key: str, seed: int, sizes: list[int]) -> DataFrame:
    """df with variant (position inside its class, from 0, in seeded order) and part_0, part_1, ...: the variant's digits in
    the mixed radix of sizes, least first."""
    df = seeded_ranks(df, [class_], key, seed, "variant").withColumn("variant", F.col("variant") - 1)
    return df.withColumns({f"part_{i}": p for i, p in enumerate(radix(F.col("variant"), sizes))})
