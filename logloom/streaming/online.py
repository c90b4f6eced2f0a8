"""Streaming forms of the baselines: an extension, for sources that do not end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_counts(events: DataFrame, ts: str, message: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts of each message by event-time window; rows later than the watermark are left out, as the engine does."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, window), message).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), message, "n")


def unseen_rate(events: DataFrame, seen: DataFrame, ts: str, message: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Share of messages by window that a static memory of messages lacks."""
    known = seen.select(F.col(message).alias("__m")).distinct()
    told = events.withWatermark(ts, lateness).join(known, F.col(message) == F.col("__m"), "left")
    return told.groupBy(F.window(ts, window)).agg(F.count("*").alias("lines"), F.avg(F.col("__m").isNull().cast("int")).alias("unseen_rate")).select(F.col("window.start").alias("window_start"), "lines", "unseen_rate")
