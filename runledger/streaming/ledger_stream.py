"""Ledgers as streams: each row once, and counts per submission and event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_rows(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Drops rows whose ``seq`` came before, within the watermark on ``at``."""
    return stream.withWatermark("at_time", late).dropDuplicatesWithinWatermark(["seq"])


def event_counts(stream: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows per window and event, final once the watermark has passed the window."""
    return stream.withWatermark("at_time", late).groupBy(F.window("at_time", window).alias("w"), "event").agg(F.count("*").alias("n"), F.max("value").alias("best")).select(F.col("w.start").alias("start"), "event", "n", "best")
