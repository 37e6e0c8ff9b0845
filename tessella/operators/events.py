"""Event log summaries and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Order of levels.
LEVELS = ("debug", "info", "warning", "error", "critical")


def level_at_least(events: DataFrame, level: str) -> DataFrame:
    return events.where(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")) >= LEVELS.index(level) + 1)


def summary(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts, error rate, distinct names and duration in seconds per group of (name, level, ts)."""
    return events.groupBy(*by).agg(
        F.count("*").alias("n_events"), F.count_distinct("name").alias("n_names"),
        F.avg(F.when(F.col("level").isin("error", "critical"), 1.0).otherwise(0.0)).alias("error_rate"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("duration_us"),
    )


def retained(events: DataFrame, by: list[str], most: int) -> DataFrame:
    """The last `most` events of each group."""
    last = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("k", F.row_number().over(last)).where(F.col("k") <= most).drop("k")


def since(events: DataFrame, time: str) -> DataFrame:
    """Events at or after a time."""
    return events.where(F.col("ts") >= F.lit(time).cast("timestamp"))


def merged(logs: list[DataFrame]) -> DataFrame:
    """Several logs as one, each event once."""
    return reduce(DataFrame.unionByName, logs).dropDuplicates(["event_id"])


def alive(entries: DataFrame, now: str, ttl_seconds: int, most: int, by: list[str]) -> DataFrame:
    """Entries not older than their time to live, of each group the `most` last ones: what a bounded store would still hold."""
    fresh = entries.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= ttl_seconds * 1_000_000)
    return retained(fresh, by, most)
