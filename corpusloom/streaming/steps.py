"""Step artifacts as a streaming sink: each batch is one commit of its steps and the run's state after them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def step_sink(path: str, run: str, max_steps: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``. A batch (step, prompt_id, body) becomes the table path/batch=<id>, written aside and put in place by
    one rename: its steps (kind = step) and a row of state (kind = state) with global_step, samples_consumed, max_steps and
    completed. A batch that is in place already, replayed after a failure, adds nothing; an empty one neither. Steps that an
    earlier batch has are left out.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/batch={batch_id}"
        if _there(spark, target):
            return
        rows = batch.groupBy("step").agg(F.min(F.struct("prompt_id", "body")).alias("x")).select("step", "x.*")
        if _there(spark, path):
            rows = rows.join(steps_of(spark, path).select("step"), "step", "left_anti")
        seen = state_of(spark, path)
        before = (seen.global_step, seen.samples_consumed) if seen else (-1, 0)
        step = rows.select(F.lit("step").alias("kind"), F.lit(run).alias("run"), "step", "prompt_id", "body", *[F.lit(None).cast(t).alias(c) for c, t in _STATE])
        last = F.greatest(F.coalesce(F.max("step"), F.lit(-1)), F.lit(before[0])).cast("long")
        state = rows.agg(last.alias("global_step"), (F.count("*") + before[1]).alias("samples_consumed")).where(F.col("samples_consumed") > before[1])
        state = state.select(F.lit("state").alias("kind"), F.lit(run).alias("run"), F.lit(None).cast("long").alias("step"), F.lit(None).cast("string").alias("prompt_id"), F.lit(None).cast("string").alias("body"), "global_step", "samples_consumed", F.lit(max_steps).cast("long").alias("max_steps"), (F.col("global_step") + 1 >= max_steps).alias("completed"))
        aside = f"{path}/.batch-{batch_id}"
        step.union(state).write.mode("overwrite").parquet(aside)
        files = spark._jvm.org.apache.hadoop.fs.Path
        fs = files(aside).getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.rename(files(aside), files(target)):
            raise OSError(f"{aside} could not be renamed")

    return put


_STATE = [("global_step", "long"), ("samples_consumed", "long"), ("max_steps", "long"), ("completed", "boolean")]
_SCHEMA = "kind string, run string, step long, prompt_id string, body string, global_step long, samples_consumed long, max_steps long, completed boolean, batch long"


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def steps_of(spark: SparkSession, path: str) -> DataFrame:
    """batch, run, step, prompt_id, body of all batches in place."""
    return _read(spark, path).where("kind = 'step'").select("batch", "run", "step", "prompt_id", "body")


def state_of(spark: SparkSession, path: str):
    """The state after the last batch that had steps, as one row; None if there is none."""
    if not _there(spark, path):
        return None
    return _read(spark, path).where("kind = 'state'").agg(F.max(F.struct("batch", *[c for c, _ in _STATE])).alias("s")).select("s.*").where("batch is not null").first()
