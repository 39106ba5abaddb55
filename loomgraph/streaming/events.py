"""Windows over events with watermarks, for batch tables and streams alike, and stateful deduplication of walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(window_start, *by, n, total) of tumbling or sliding windows; streams drop what is later than ``late``."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return df.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n) of runs of events with gaps below ``gap``."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_within(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First of equal rows within the watermark; a batch just drops duplicates."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def write_batches(df: DataFrame, folder: str, checkpoint: str):
    """Append each micro-batch to a table, once whatever restarts."""
    return df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).start(folder)
