"""A store of samples in buckets of JSON lines, brought up to date by buckets, and its manifest, which is rebuilt from what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import shared_folder

BUCKETS = 64
_LINES = StructType([StructField("value", StringType()), StructField("split", StringType()), StructField("bucket", StringType())])


def stored(spark: SparkSession, path: str) -> DataFrame:
    """split, bucket, id, body, sha256 of each line that is there; id is null where a line is no JSON or has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raw = spark.createDataFrame([], _LINES)
    else:
        raw = spark.read.schema(_LINES).option("basePath", path).text(path)
    id_ = F.try_variant_get(F.try_parse_json("value"), "$.id", "string")
    return raw.select("split", F.col("bucket").cast("int").alias("bucket"), id_.alias("id"), F.col("value").alias("body"), F.sha2("value", 256).alias("sha256"))


def bring_up_to_date(samples: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes samples (split, id, body: JSON on one line) that are not in the store yet; gives split, id, status of each:
    skipped (is there, and stays as it is), written, or repaired (was in a bucket with broken, repeated or misplaced lines).

    Only buckets that change are written, each as a whole, by Spark's dynamic overwrite of partitions; of a broken bucket the
    good lines stay, of lines of one id the least. With nothing new, nothing is written. Ids are unique in samples; of
    repeated ones, the least body counts. A broken bucket for which nothing is wanted and in which nothing is good stays.
    """
    spark = samples.sparkSession
    wanted = samples.groupBy("split", "id").agg(F.min("body").alias("body")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    there = stored(spark, path)
    good = there.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(buckets)) == F.col("bucket"))).groupBy("split", "bucket", "id").agg(F.min("body").alias("old"))
    lines = there.groupBy("split", "bucket").agg(F.count("*").alias("_lines"))
    whole = lines.join(good.groupBy("split", "bucket").agg(F.count("*").alias("_good")), ["split", "bucket"], "left")
    torn = whole.where("_lines > coalesce(_good, 0)").select("split", "bucket", F.lit(True).alias("_torn"))
    both = wanted.join(good, ["split", "bucket", "id"], "full_outer").join(torn, ["split", "bucket"], "left")
    both = both.withColumn("status", F.when(F.col("old").isNotNull(), "skipped").when(F.col("_torn"), "repaired").otherwise("written"))
    stale = both.groupBy("split", "bucket").agg(F.max(F.coalesce("_torn", F.lit(False)) | (F.col("status") != "skipped")).alias("stale"))
    plan = both.join(stale, ["split", "bucket"]).select("split", "bucket", "id", F.coalesce("old", "body").alias("value"), "status", "stale", F.col("body").isNotNull().alias("asked"))
    # what is read is also written over, so the plan is a table of its own first
    where = shared_folder(spark, "store")
    plan.write.parquet(where)
    plan = spark.read.schema(plan.schema).parquet(where)
    changed = plan.where("stale")
    if not changed.isEmpty():
        changed.select("value", "split", "bucket").repartition("split", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "bucket").text(path)
    return plan.where("asked").select("split", "id", "status")


def rebuilt_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries (split, id, sha256, task_type, source) of all good lines in the store, and a header (split, n, n_broken, sources,
    digest) for each split. The digest is that of the entries' ids, digests and sources, summed in any order: two 64-bit sums
    of hashes, so that it needs no sort; ``splits.digest_sources`` gives the sequential one."""
    lines = stored(spark, path).withColumn("v", F.try_parse_json("body"))
    field = lambda c: F.try_variant_get("v", f"$.metadata.{c}", "string").alias(c)
    rows = lines.select("split", "id", "sha256", field("task_type"), field("source"))
    entries = rows.where("id is not null")
    mark = lambda salt: F.sum(F.when(F.col("id").isNotNull(), F.xxhash64(F.lit(salt), "id", "sha256", "source").cast("decimal(38,0)")))
    header = rows.groupBy("split").agg(F.count("id").alias("n"), F.count_if(F.col("id").isNull()).alias("n_broken"), F.array_sort(F.collect_set("source")).alias("sources"), F.sha2(F.concat_ws(":", mark(1).cast("string"), mark(2).cast("string")), 256).alias("digest"))
    return entries, header
