"""Failure labels: is a tick inside an incident, does one lie ahead, and how many minutes until the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.config import FeatureConfig, LabelConfig, SeriesLayout
from emberwatch.operators.features import feature_columns, require_metrics
from emberwatch.plans.blocks import AUTO, Layout, cut_blocks, home_rows
from emberwatch.plans.slices import borders, slice_of

FOREVER = 253402300799_000000  # fixed value: last microsecond timestamps are compared against


def _markers(incidents: DataFrame, config: LabelConfig) -> DataFrame:
    """Two rows per incident: +1 at its start, -1 at its end. Ends never precede starts, so the running sum counts
    the incidents open at a tick."""
    start = F.unix_micros(F.col("start_ts").cast("timestamp"))
    missing_end = F.lit(FOREVER) if config.open_incident_is_failing else start
    end = F.greatest(F.coalesce(F.unix_micros(F.col("end_ts").cast("timestamp")), missing_end), start)
    return incidents.select(
        "service",
        F.inline(
            F.array(
                F.struct(start.alias("_us"), F.lit(1).alias("_open"), start.alias("_start")),
                F.struct(end.alias("_us"), F.lit(-1).alias("_open"), F.lit(None).cast("long").alias("_start")),
            )
        ),
    )


def mark_failures(
    ticks: DataFrame, incidents: DataFrame, config: LabelConfig, layout: Layout = AUTO
) -> DataFrame:
    """Adds ``_failing`` (0/1), ``_minutes`` to the next start and, with a layout, ``_idx`` of the tick.

    Ticks and incident borders are swept together in time order: no join, so nothing has to be broadcast. With a layout
    the sweep runs per slice of time and takes what happened in other slices from sums per slice.
    """
    rows = ticks.withColumn("_us", F.unix_micros(F.col("timestamp"))).withColumn("_tick", F.lit(True))
    both = rows.unionByName(_markers(incidents, config), allowMissingColumns=True)
    keys = ["service"]
    if layout is not None:
        cuts = borders(ticks, F.unix_micros(F.col("timestamp")))
        both = both.withColumn("_bucket", slice_of(F.col("_us"), cuts))
        keys.append("_bucket")
    ahead_of = W.partitionBy(*keys).orderBy(F.col("_us").desc()).rangeBetween(W.unboundedPreceding, -1)
    up_to_now = W.partitionBy(*keys).orderBy("_us").rangeBetween(W.unboundedPreceding, 0)
    swept = both.select(
        "*",
        F.min("_start").over(ahead_of).alias("_next"),
        F.coalesce(F.sum("_open").over(up_to_now), F.lit(0)).alias("_depth"),
    )
    if layout is not None:
        ticks_so_far = up_to_now.rowsBetween(W.unboundedPreceding, 0)
        swept = swept.withColumn("_seen", F.count("_tick").over(ticks_so_far))
        per_bucket = both.groupBy(*keys).agg(
            F.sum("_open").alias("_net"), F.min("_start").alias("_first"), F.count("_tick").alias("_rows")
        )
        by_bucket = W.partitionBy("service").orderBy("_bucket")
        before = by_bucket.rowsBetween(W.unboundedPreceding, -1)
        later = W.partitionBy("service").orderBy(F.col("_bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
        carried = per_bucket.select(
            *keys,
            F.min("_first").over(later).alias("_next_later"),
            F.coalesce(F.sum("_net").over(before), F.lit(0)).alias("_depth_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        )
        swept = (
            swept.where("_tick")
            .join(carried, keys)
            .withColumn("_next", F.coalesce("_next", "_next_later"))
            .withColumn("_depth", F.col("_depth") + F.col("_depth_before"))
            .withColumn("_idx", F.col("_rows_before") + F.col("_seen") - 1)
            .drop("_bucket", "_next_later", "_depth_before", "_rows_before", "_seen")
        )
    failing = (F.col("_depth") > 0).cast("int")
    minutes = F.when(failing == 1, F.lit(0.0)).otherwise((F.col("_next") - F.col("_us")) / F.lit(60_000_000.0))
    return (
        swept.where("_tick")
        .withColumn("_failing", failing)
        .withColumn("_minutes", minutes)
        .drop("_us", "_tick", "_open", "_start", "_next", "_depth")
    )


def label_columns(config: LabelConfig, window) -> list:
    """Label expressions over rows carrying ``_failing`` and ``_minutes``."""
    columns = []
    for minutes in config.horizons_min:
        ticks = config.ticks(minutes)
        first, last = (0, ticks - 1) if config.include_current_failure else (1, ticks)
        ahead = F.max("_failing").over(window.rowsBetween(first, last))
        columns.append(F.coalesce(ahead, F.lit(0)).alias(config.horizon_name(minutes)))
    if config.include_current_failure:
        columns.append(F.col("_failing").alias("in_failure"))
    if config.include_time_to_failure:
        columns.append(F.col("_minutes").alias("time_to_failure_min"))
    return columns


def _windowed(marked: DataFrame, layout: SeriesLayout | None, lookback: int, lookahead: int):
    if layout is None:
        return marked, W.partitionBy("service").orderBy("timestamp"), []
    cut = cut_blocks(marked, layout, lookback, lookahead)
    return cut, W.partitionBy("service", "_block").orderBy("timestamp"), ["_home", "_block"]


def build_labels(
    ticks: DataFrame, incidents: DataFrame, config: LabelConfig = LabelConfig(), layout: Layout = AUTO
) -> DataFrame:
    """timestamp, service and the label columns for every tick."""
    marked = mark_failures(ticks.select("timestamp", "service"), incidents, config, layout)
    rows, window, extra = _windowed(marked, layout, 0, config.lookahead)
    return home_rows(rows.select("timestamp", "service", *label_columns(config, window), *extra))


def build_dataset(
    metrics: DataFrame,
    incidents: DataFrame,
    features: FeatureConfig = FeatureConfig(),
    labels: LabelConfig = LabelConfig(),
    layout: Layout = AUTO,
) -> DataFrame:
    """Features and labels in one pass over the series; no join between the two."""
    require_metrics(metrics)
    kept = [c for c in features.passthrough if c in metrics.columns]
    marked = mark_failures(metrics, incidents, labels, layout)
    rows, window, extra = _windowed(marked, layout, features.lookback, labels.lookahead)
    return home_rows(
        rows.select(
            "timestamp",
            "service",
            *feature_columns(features, window),
            *kept,
            *label_columns(labels, window),
            *extra,
        )
    )


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of separately stored features and labels on (timestamp, service)."""
    return features.join(labels, ["timestamp", "service"], "left")
