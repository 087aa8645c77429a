"""Streaming forms of operators on event tables: an extension, offered beside the batch forms.

State is bounded by the watermark in each of them: late rows beyond it are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, time: str, kind: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) per window and kind."""
    by = events.withWatermark(time, late).groupBy(F.window(time, width), kind)
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) per run of events that are less than the gap apart."""
    by = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return by.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
