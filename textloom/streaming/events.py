"""Structured Streaming forms of the stateful operators over an event stream (an addition: the batch forms are exact)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet folder as a stream; ``ts`` becomes a timestamp, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and value sums by event-time window and type, with a watermark where the input is a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def run_once(df: DataFrame, table: str, checkpoint: str, mode: str = "append"):
    """Write all available input of a stream to an in-memory or catalog table and wait."""
    return df.writeStream.format("memory").queryName(table).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def admit_each_batch(jobs: DataFrame, admit, target: str, checkpoint: str):
    """Polling scheduler: every micro-batch of queued jobs goes through ``admit(df)`` and is appended to ``target``."""

    def batch(df: DataFrame, number: int) -> None:
        admit(df).withColumn("batch", F.lit(number)).write.mode("append").parquet(target)

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
