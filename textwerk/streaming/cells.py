"""Counts of cells kept up to date as rows arrive. Counts merge by addition, so every statistic of cells can follow a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def running_cells(stream: DataFrame, x: str, y: str, time: str, delay: str = "30 days", window: str = "1 day") -> DataFrame:
    """(window, x, y, n) of a stream in event-time windows; rows that come later than ``delay`` are left out."""
    return stream.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withWatermark(time, delay).groupBy(F.window(time, window), F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))


def merged(cells: DataFrame) -> DataFrame:
    """(x, y, n) over all windows."""
    return cells.groupBy("x", "y").agg(F.sum("n").alias("n"))
