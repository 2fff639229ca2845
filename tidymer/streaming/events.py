"""Windowed counts and sums of an event stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total by tumbling windows; the same plan serves a stream (append mode) and a table."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "total")
