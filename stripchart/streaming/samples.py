"""Samples as a stream: incremental reading, windows in event time, sessions by gaps, and files
as they arrive. Each takes a batch DataFrame as well, so that a stream can be held against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files under a path as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream's time gets a zone, which watermarks need; a batch is left as it is, so that its
    windows do not depend on the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean and extent per window and kind; rows later than `late` are not waited for."""
    timed = _watermarked(events, late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "least", "most")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Recordings of each user: samples with less than the gap between them."""
    timed = _watermarked(events, late)
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    return out.select("user_id", F.col("s.start").alias("start"), "n", "most")


def append_batches(stream: DataFrame, transform, path: str, checkpoint: str):
    """Run a batch transform on each micro-batch and append its rows; a batch that is run again
    after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
