"""Windows over event time. Each function takes a batch or a stream; on a stream, late rows are dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str | None) -> DataFrame:
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.withWatermark("ts", late) if late and events.isStreaming else at


def tumbling_counts(events: DataFrame, width: str, late: str | None = "1 hour") -> DataFrame:
    """Counts and sums by window and type."""
    rows = timed(events, late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """A user's events with less than ``gap`` between them, as one session."""
    rows = timed(events, late).groupBy(F.session_window("ts", gap), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, within the watermark on a stream."""
    rows = timed(events, late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def write_once(rows: DataFrame, path: str, checkpoint: str):
    """Appends what is there to Parquet files, exactly once, and stops."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
