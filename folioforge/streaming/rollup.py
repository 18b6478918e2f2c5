"""Rollups over events, the same for tables and streams (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame, every: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by kind and window; in a stream, events later than ``late`` are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
