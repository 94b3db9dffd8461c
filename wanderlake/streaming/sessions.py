"""Structured Streaming twins: sessions by a gap, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(points: DataFrame, gap: str = "300 seconds", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of runs of points without a longer gap; works on streams (append mode) and tables."""
    w = F.session_window("ts", gap)
    return points.withWatermark("ts", late).groupBy("user_id", w.alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, start, n, total in tumbling windows of event time."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")
