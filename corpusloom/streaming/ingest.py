"""Extensions on Structured Streaming: incremental ingest, and counters over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pretokens


def new_files(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that come into a folder; its checkpoint is the list of what is done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def token_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(pretokens(F.col("text"))).cast("long").alias("n_tokens"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is there to Parquet, and ends. Calling it again does only what is new."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def live_counts(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type in windows of event time; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
