"""Structured Streaming forms of the event log: windowed summaries and a bounded log per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(begin, name, n, total) per event-time window; rows later than `late` are dropped by the watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(window.alias("w"), "name").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "name", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin"), "n")
