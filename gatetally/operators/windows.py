"""Event time, keys and tumbling window aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatetally.constants import WATERMARK_DELAY


def with_event_time(
    df: DataFrame, column: str = "timestamp", delay: str = WATERMARK_DELAY
) -> DataFrame:
    """Declare the event time and how far out of order it may come; no effect on a static frame."""
    return df.withWatermark(column, delay)


def aggregate_by_window(
    df: DataFrame,
    duration: str,
    keys: Sequence[str],
    *aggregates: Column,
    column: str = "timestamp",
) -> DataFrame:
    """Aggregates per key and tumbling window: (keys..., aggregates..., window_start, window_end).

    Windows are aligned to the epoch and half-open; only windows that hold rows appear. Any
    aggregate column can be given. Spark aggregates each partition before the shuffle and spreads
    the groups by window and key together, so a key that holds much of the data sends one row per
    window and partition, and a stream keeps one row per open window and key.
    """
    grouped = df.groupBy(F.window(column, duration).alias("window"), *keys).agg(*aggregates)
    start = F.col("window.start").alias("window_start")
    end = F.col("window.end").alias("window_end")
    return grouped.select("*", start, end).drop("window")


def count_by_window(
    df: DataFrame, duration: str, keys: Sequence[str], column: str = "timestamp"
) -> DataFrame:
    """Rows per key and tumbling window: (keys..., window_start, window_end, n)."""
    counted = aggregate_by_window(df, duration, keys, F.count(F.lit(1)).alias("n"), column=column)
    return counted.select(*keys, "window_start", "window_end", "n")
