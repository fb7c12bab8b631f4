"""Turns merged by pause over a stream of point events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, lateness: str) -> DataFrame:
    """(keys, start, end, n): runs of events with pauses below ``gap``.  State is kept until the watermark, ``lateness`` behind, passes a run.

    A session ends ``gap`` after its last event, so unlike the batch merge a pause of exactly ``gap`` begins a new one.
    """
    grouped = events.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.max(time).alias("end")).select(*keys, F.col("w.start").alias("start"), "end", "n")
