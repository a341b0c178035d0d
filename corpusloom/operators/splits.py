"""Splits, leakage, manifests and their digests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numeric import seeded
from .ranks import _null_safe, seeded_ranks


def _share(n: str) -> Column:
    """15 percent, rounded half to even."""
    return F.expr(f"{n} * 15 div 100 + if({n} * 15 % 100 > 50 or ({n} * 15 % 100 = 50 and {n} * 15 div 100 % 2 = 1), 1, 0)")


def _split_of(rank: Column, share: Column) -> Column:
    return F.when(rank <= share, "test").when(rank <= 2 * share, "dev").otherwise("train")


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """df with split: of each stratum, in seeded order, 15 percent test, 15 percent dev (rounded half to even), the rest train.
    Rows without a stratum are a stratum. No task sees a whole stratum."""
    rows = seeded_ranks(df, [stratum], key, seed, "_r", "_n")
    return rows.withColumn("split", _split_of(F.col("_r"), _share("_n"))).drop("_r", "_n")


def split_positions(df: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """df with split and pos: the position from 1 in its split, by stratum (nulls first) and then in seeded order. A row's
    position is its rank in its stratum, less those of other splits, and the sizes of the strata before."""
    rows = seeded_ranks(df, [stratum], key, seed, "_r", "_n").withColumn("split", _split_of(F.col("_r"), _share("_n")))
    share = _share("_n")
    inside = F.when(F.col("split") == "test", F.col("_r")).when(F.col("split") == "dev", F.col("_r") - share).otherwise(F.col("_r") - 2 * share)
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    parts = sizes.withColumn("_p", F.explode(F.array(F.struct(F.lit("test").alias("split"), share.alias("n")), F.struct(F.lit("dev").alias("split"), share.alias("n")), F.struct(F.lit("train").alias("split"), (F.col("_n") - 2 * share).alias("n")))))
    # a row for each stratum and split
    before = parts.select(stratum, "_p.split", (F.sum("_p.n").over(W.partitionBy("_p.split").orderBy(stratum)) - F.col("_p.n")).alias("_before"))
    return _null_safe(rows, before, [stratum, "split"]).withColumn("pos", (F.col("_before") + inside).cast("long")).drop("_r", "_n", "_before")


def contiguous_split(rank: Column, n: Column) -> Column:
    """80 / 10 / 10 by rank from 1 in the order of ids, bounds rounded down."""
    return F.when(rank <= F.floor(n * 8 / 10), "train").when(rank <= F.floor(n * 9 / 10), "dev").otherwise("test")


def hash_split(seed: int, key: Column) -> Column:
    """80 / 10 / 10 by the seeded digest alone: no order, no shuffle."""
    bucket = F.conv(F.left(seeded(seed, key), F.lit(8)), 16, 10).cast("long") % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "dev").otherwise("test")


def class_plan(total: int, classes: list[str]) -> list[tuple[str, int]]:
    """Equal counts, the remainder to the first classes."""
    return [(c, total // len(classes) + (i < total % len(classes))) for i, c in enumerate(classes)]


def class_counts(classes: DataFrame, name: str, total: Column) -> DataFrame:
    """name, i (its place by name, from 0), n: equal counts of a total, the remainder to the first classes. classes: a row
    for each class, and the total with it."""
    w = W.orderBy(name)  # a row for each class
    rows = classes.select(name, (F.row_number().over(w) - 1).cast("long").alias("i"), total.alias("_t"), F.count("*").over(W.partitionBy()).alias("_k"))
    return rows.select(name, "i", (F.floor(F.col("_t") / F.col("_k")) + (F.col("i") < F.col("_t") % F.col("_k")).cast("long")).alias("n"))


def held_out_tail(rank: Column, n: Column) -> Column:
    return rank > n - F.greatest(F.lit(1), F.floor(n * 5 / 100))


def leaks(df: DataFrame, signature: str, split: str = "split") -> DataFrame:
    """Signatures that are in two splits or more."""
    return df.groupBy(signature).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


def manifest(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return df.select(key, F.sha2(text, 256).alias("sha256"), *more)


def _stream(df: DataFrame, part: Column, order: str, name: str) -> DataFrame:
    """The digest of all parts joined in order. It is sequential by its definition: one task takes the sorted parts as a stream
    of batches and keeps only the digest's state, so a manifest of any length fits. A Merkle tree of digests has no such task."""

    def run(batches):
        digest = hashlib.sha256()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                digest.update((x or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], [name])

    parts = df.select(F.col(order).alias("_k"), part.alias("_v")).repartition(1).sortWithinPartitions("_k", "_v")
    return parts.select("_v").mapInArrow(run, f"{name} string")


def digest_contents(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of the concatenated digests."""
    return _stream(entries, F.col("sha256"), key, "digest")


def digest_sources(entries: DataFrame, source: str, key: str = "doc_id") -> DataFrame:
    """Of digest NUL source NUL for each entry."""
    return _stream(entries, F.concat("sha256", F.char(F.lit(0)), source, F.char(F.lit(0))), key, "digest")


def digest_ids(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of the ids only, each with a line end."""
    return _stream(entries, F.concat(F.col(key).cast("string"), F.lit("\n")), key, "digest")


def counts_with_zeros(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Counts for every row of keys, 0 where df has none. keys: a short list of wanted values."""
    return keys.join(df.groupBy(*on).agg(F.count("*").alias("n")), on, "left").select(*on, F.coalesce("n", F.lit(0)).alias("n"))
