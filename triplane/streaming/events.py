"""Structured Streaming over event files: windowed counts with late data, and spans of activity kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 10) -> DataFrame:
    """A folder of event Parquet files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """[start, event_type, n, total] of tumbling windows; events later than the watermark are dropped, repeated event ids count once.

    Null times belong to no window.
    """
    kept = events.filter("ts IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    grouped = kept.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def activity_spans(events: DataFrame) -> DataFrame:
    """[user_id, event_type, first, last]: the statements of participation, for the update output mode."""
    return events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
