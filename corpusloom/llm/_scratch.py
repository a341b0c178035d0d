"""Cutting lineage where every executor can read it, filters by key, and joins that spread hot keys.

Tables are written under ``spark.checkpoint.dir``. Only in a local session that has none (as in tests) a temporary folder is
set; on a cluster that is an error, as an executor's own folder cannot be read by the others. So a lost executor costs a
re-read and nothing else.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP = 32_768  # bits in one row of Spark's bitmap functions
MOST_ROWS = 8192  # of a filter that is broadcast: 32 MB
SALTS = 64
HOT = 1000  # a key is hot if it has more than one in so many rows, so no more keys than that are


def folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs run inside, where the session has Spark's default; set back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if before == "10000":
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def carried(docs: DataFrame) -> str:
    """A name for one column that holds all of the caller's, so that none of these clashes with those made here."""
    name = "_carried"
    while name in docs.columns:
        name += "_"
    return name


class Scratch:
    """Tables of one operator call. ``keep`` writes a frame and returns its re-read; ``drop`` removes it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{folder(spark)}/corpusloom/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def flag_keys(df: DataFrame, key: str, keys: DataFrame, other: str, flag: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """df with a flag: may its key be among keys? Keys are counted first, so give a written table or a small plan.

    Up to some thirty million keys: a filter with eight bits for each key, of MOST_ROWS rows of 4 kB at most, which is
    broadcast; df is not shuffled. It lets about one key in nine through that is not among them, so what follows has to join
    on the key itself. Beyond that: a join on the key's hash, exact but for collisions.
    """
    n = keys.select(other).where(F.col(other).isNotNull()).count()
    rows = max(1, -(-8 * n // BITMAP))
    if rows > most_rows:
        known = keys.select(F.xxhash64(other).alias("_hash")).distinct().withColumn("_in", F.lit(True))
        out = df.withColumn("_hash", F.xxhash64(key)).join(known, "_hash", "left")
        return out.withColumn(flag, F.coalesce("_in", F.lit(False))).drop("_hash", "_in")

    def spot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BITMAP * rows))

    bits = (
        keys.select(spot(F.col(other)).alias("s"))
        .groupBy((F.col("s") / BITMAP).cast("int").alias("_filter"))
        .agg(F.bitmap_construct_agg(F.pmod(F.col("s"), F.lit(BITMAP))).alias("_filter_bits"))
    )
    at = F.pmod(spot(F.col(key)), F.lit(BITMAP)).cast("int")
    octet = F.conv(F.hex(F.substring("_filter_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("_filter", (spot(F.col(key)) / BITMAP).cast("int"))
        .join(F.broadcast(bits), "_filter", "left")
        .withColumn(flag, F.coalesce(F.getbit(octet, F.pmod(at, F.lit(8))) == 1, F.lit(False)))
        .drop("_filter", "_filter_bits")
    )


def only_keys(df: DataFrame, key: str, keys: DataFrame, other: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of df whose key may be among keys."""
    return flag_keys(df, key, keys, other, "_may", most_rows).where("_may").drop("_may")


def hot_values(df: DataFrame, key: str, share: int = HOT) -> list:
    """The values of a key that more than one in ``share`` rows have: fewer than ``share`` values, whatever the input."""
    return hot_counts(df.groupBy(key).agg(F.count("*").alias("n")), key, "n", share)


def hot_counts(counts: DataFrame, key: str, n: str, share: int = HOT) -> list:
    """The same from a table with a count for each key. Up to a hundred rows a key is never hot."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) * share > max(total, 100 * share)).where(F.col(key).isNotNull()).select(key).collect()]


def spread_join(many: DataFrame, one: DataFrame, on: list[str], key: str, hot: list, by: Column, how: str = "inner") -> DataFrame:
    """many join one on ``on``, in which ``one`` has a row for each key. Rows of hot values of ``key`` are dealt out over
    SALTS parts by ``by``, and the one row that they meet is there in each."""
    if not hot:
        return many.join(one, on, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    many = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))))
    return many.join(one, [*on, "_salt"], how).drop("_salt")
