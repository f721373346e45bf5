"""The inner level of two-level pooling over a stream: an addition for Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def streaming_series_mean(items: DataFrame, time: str, keys: list[str], value: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Sums and counts of each key in each window; windows close when the watermark passes them."""
    return items.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
