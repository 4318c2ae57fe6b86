"""Keep-first dedup and windowed counts over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: Column, time: str, wait: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen within ``wait``; state older than that is let go."""
    return stream.withColumn("fp", key).withWatermark(time, wait).dropDuplicatesWithinWatermark(["fp"])


def counts(stream: DataFrame, time: str, by: str, size: str = "5 minutes", wait: str = "10 minutes") -> DataFrame:
    """Rows per window and group, given out once the window can't change any more."""
    return stream.withWatermark(time, wait).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"))
