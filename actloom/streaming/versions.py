"""Versions as a stream: first deliveries only, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, key: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each key once, as long as its repeats come within `delay`; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, group: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window_start, group, n): counts over tumbling windows, late rows within `delay` included."""
    counts = stream.withWatermark(at, delay).groupBy(F.window(at, window), group).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), group, "n")
