"""Joins between points in time and intervals, without nested loops and without a broadcast.

Intervals are cut at bucket borders so that point and interval meet through an equality on (keys, bucket); the exact
bounds are checked afterwards. A point meets an interval at most once because it lies in one bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(time: Column, width_sec: int) -> Column:
    return F.floor(F.unix_micros(time) / F.lit(width_sec * 1_000_000)).cast("long")


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    time: str = "timestamp",
    bucket_sec: int = 6 * 3600,
    closed: bool = False,
) -> DataFrame:
    """Inner join of points with the intervals of the same keys that contain them; ``[start, end)`` or ``[start, end]``."""
    cut = intervals.withColumn(
        "_bucket", F.explode(F.sequence(_bucket(F.col(start), bucket_sec), _bucket(F.col(end), bucket_sec)))
    )
    located = points.withColumn("_bucket", _bucket(F.col(time), bucket_sec))
    before_end = F.col(time) <= F.col(end) if closed else F.col(time) < F.col(end)
    inside = (F.col(time) >= F.col(start)) & before_end
    return located.join(cut, [*keys, "_bucket"]).where(inside).drop("_bucket")
