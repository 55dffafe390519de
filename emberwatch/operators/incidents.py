"""Incident windows: tracked from per-tick health, tiled from a schedule, compared with a schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.config import SeriesLayout
from emberwatch.plans.blocks import AUTO, Layout, bucket_of, home_rows, series
from emberwatch.plans.durable import durable
from emberwatch.plans.ranking import numbered


def track_incidents(metrics: DataFrame, interval_sec: int, layout: Layout = AUTO) -> DataFrame:
    """One row per maximal run of unhealthy ticks: opens at its first tick, closes one interval after its last.

    Only the ticks where health changes leave the window; starts and ends are then paired by their order.
    """
    rows, _, window = series(metrics.select("timestamp", "service", "healthy"), layout, 1, 1)
    bad = ~F.col("healthy")
    first = bad & F.coalesce(F.lag("healthy").over(window), F.lit(True))
    last = bad & F.coalesce(F.lead("healthy").over(window), F.lit(True))
    borders = home_rows(rows.withColumn("_first", first).withColumn("_last", last)).where("_first or _last")
    borders = durable(borders.select("service", "timestamp", "_first", "_last"), "incident_borders")
    starts = numbered(borders.where("_first").select("service", "timestamp"), ["timestamp"], "_pair", ["service"])
    ends = numbered(borders.where("_last").select("service", "timestamp"), ["timestamp"], "_pair", ["service"])
    step = F.make_interval(secs=F.lit(float(interval_sec)))
    runs = starts.withColumnRenamed("timestamp", "start_ts").join(
        ends.select("service", "_pair", (F.col("timestamp") + step).alias("end_ts")), ["service", "_pair"]
    )
    return numbered(runs.drop("_pair"), ["start_ts", "service"], "incident_id")


def tile_schedule(schedule: DataFrame, repeats: int, period_min: float) -> DataFrame:
    """The schedule repeated ``repeats`` times, each round ``period_min`` later."""
    if repeats <= 1 or period_min <= 0:
        return schedule
    rounds = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    tiled = schedule.withColumn("_round", rounds)
    return tiled.withColumn("start_min", F.col("start_min") + F.col("_round") * F.lit(float(period_min))).drop("_round")


def duration_mismatch(schedule: DataFrame, incidents: DataFrame, interval_sec: int) -> DataFrame:
    """Incidents whose length differs from the schedule of their service and type by more than six intervals.

    An incident meets each length that is scheduled for them once, however often it is.
    """
    actual = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(60_000_000.0)
    paired = schedule.select("service", "scenario_type", "duration_min").distinct().join(
        incidents.withColumn("actual_min", actual), ["service", "scenario_type"]
    )
    tolerance = 6 * interval_sec / 60.0
    return paired.where(F.abs(F.col("actual_min") - F.col("duration_min")) > tolerance)


def missing_types(expected: DataFrame, incidents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected scenario types that never occurred, or not in the same group of ``by``."""
    keys = [*by, "scenario_type"]
    return expected.select(*keys).distinct().join(incidents, keys, "left_anti")


def overlapping(incidents: DataFrame, layout: SeriesLayout = SeriesLayout()) -> DataFrame:
    """Incidents that start before every earlier one of their service has ended.

    The latest end so far is taken within a time bucket and, from one row per bucket, over the buckets before it.
    """
    rows = incidents.withColumn("_bucket", bucket_of(layout, "start_ts"))
    per_bucket = rows.groupBy("service", "_bucket").agg(F.max("end_ts").alias("_end"))
    before = W.partitionBy("service").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = per_bucket.select("service", "_bucket", F.max("_end").over(before).alias("_carried"))
    local = W.partitionBy("service", "_bucket").orderBy("start_ts", "end_ts", "incident_id")
    until = F.greatest(F.max("end_ts").over(local.rowsBetween(W.unboundedPreceding, -1)), F.col("_carried"))
    joined = rows.join(carried, ["service", "_bucket"])
    return joined.withColumn("_until", until).where(F.col("start_ts") < F.col("_until")).drop(
        "_bucket", "_carried", "_until"
    )
