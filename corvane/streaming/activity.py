"""Streaming forms of the activity counts. The batch operators are the reference; these are an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window start, event_type, n) over a stream of (ts, event_type); events later than the watermark are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
