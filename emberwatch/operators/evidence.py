"""Evidence packages: what a flagged tick looked like against the recent history of its service."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.config import EvidenceConfig
from emberwatch.functions.columns import half_even, null_if_nan
from emberwatch.plans.blocks import AUTO, Layout, home_rows, series
from emberwatch.plans.slices import borders, slice_of

# Wording of the recommended actions, by component and by a word in the feature's name.
GENERAL_ACTIONS = [
    ("failure_probability", "Escalate to on-call: high failure probability detected"),
    ("error_rate", "Check downstream dependencies and circuit breakers"),
    ("error_rate", "Review recent deployments for regression"),
    ("latency_trend", "Scale horizontally: add replicas to reduce queue depth"),
    ("latency_trend", "Enable request shedding for non-critical paths"),
    ("memory_growth", "Trigger heap dump and memory profile analysis"),
    ("memory_growth", "Consider rolling restart to reclaim memory"),
]
FEATURE_ACTIONS = [
    ("memory", "Investigate ", " growth - possible leak"),
    ("latency", "Profile ", " - check for contention or slow queries"),
    ("error", "Analyze ", " - correlate with upstream errors"),
]
COMPONENTS = ("failure_probability", "error_rate", "latency_trend", "memory_growth", "anomaly_score")


def _trailing(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, population deviation and number of the known values among the ``width`` rows before each row."""
    padded = np.concatenate([np.full(width, np.nan), values[:-1]])
    frames = np.lib.stride_tricks.sliding_window_view(padded, width)
    known = ~np.isnan(frames)
    number = known.sum(axis=1)
    safe = np.maximum(number, 1)
    mean = np.where(known, frames, 0.0).sum(axis=1) / safe
    spread = np.sqrt((np.where(known, frames - mean[:, None], 0.0) ** 2).sum(axis=1) / safe)
    return np.where(number > 0, mean, np.nan), np.where(number > 0, spread, np.nan), number


def _history(rows: DataFrame, keys: Sequence[str], features: Sequence[str], metrics: Sequence[str], config: EvidenceConfig):
    """Rows with the trailing statistics of every feature, the earlier value of every key metric and ``_seen``.

    Per group and feature this is three passes over one array; the same frames as window aggregates cost about a hundred
    times as much, because every aggregate of every feature is rebuilt from all rows of its frame. A group is one block
    of consecutive rows, so its size is bounded.
    """
    width = config.history_rows - 1
    added = [T.StructField(f"{f}__{s}", T.DoubleType()) for f in features for s in ("mean", "std", "n")]
    added += [T.StructField(f"{m}__before", T.DoubleType()) for m in metrics]
    schema = T.StructType([*rows.schema.fields, *added, T.StructField("_seen", T.LongType())])

    def describe(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("timestamp", kind="mergesort").reset_index(drop=True)
        new: dict[str, object] = {}
        for f in features:
            stats = _trailing(group[f].to_numpy(dtype="float64"), width)
            new[f"{f}__mean"], new[f"{f}__std"], new[f"{f}__n"] = stats
        for m in metrics:
            new[f"{m}__before"] = group[m].astype("float64").shift(config.delta_lag)
        new["_seen"] = np.minimum(np.arange(1, len(group) + 1), config.history_rows)
        return pd.concat([group, pd.DataFrame(new)], axis=1)

    return rows.groupBy(*keys).applyInPandas(describe, schema)


def _deviation(feature: str, position: int, config: EvidenceConfig) -> Column:
    """Struct for one feature, NULL unless it deviates clearly from the rows before it."""
    value, mean = null_if_nan(F.col(feature)), null_if_nan(F.col(f"{feature}__mean"))
    spread = F.col(f"{feature}__std") + F.lit(1e-6)
    z = (value - mean) / spread
    rounded = half_even(z, 2)
    return F.when(
        (F.col(f"{feature}__n") >= config.min_values) & (F.abs(z) > config.min_abs_z),
        F.struct(
            (-F.abs(rounded)).alias("order"),
            F.lit(position).alias("position"),
            F.lit(feature).alias("feature"),
            value.alias("current"),
            mean.alias("baseline_mean"),
            spread.alias("baseline_std"),
            rounded.alias("zscore"),
            F.when(z > 0, "up").otherwise("down").alias("direction"),
        ),
    )


def _delta(metric: str) -> Column:
    """Percent change against the row ``delta_lag`` rows back, plain difference where that row is 0."""
    before, now = null_if_nan(F.col(f"{metric}__before")), F.col(metric)
    return F.when(before != 0, half_even((now - before) / before * 100, 1)).otherwise(half_even(now - before, 1))


def describe_ticks(
    table: DataFrame,
    features: Sequence[str],
    config: EvidenceConfig = EvidenceConfig(),
    layout: Layout = AUTO,
) -> DataFrame:
    """(timestamp, service, top_anomalous_features, metrics_deltas) of every row of a feature table. One pass of windows
    for all rows; callers filter afterwards, so no row's history is read twice."""
    needed = list(dict.fromkeys([*features, *[m for m in config.delta_metrics if m in table.columns]]))
    doubles = [F.col(c).cast("double").alias(c) for c in needed]
    rows, keys, _ = series(
        table.select("timestamp", "service", *doubles), layout, max(config.history_rows - 1, config.delta_lag)
    )
    metrics = [m for m in config.delta_metrics if m in table.columns]
    windowed = _history(rows, keys, features, metrics, config)
    found = F.array_compact(F.array(*[_deviation(f, i, config) for i, f in enumerate(features)]))
    deltas = F.map_filter(
        F.create_map(*[x for m in metrics for x in (F.lit(m), _delta(m))]), lambda _, change: change.isNotNull()
    )
    described = windowed.select(
        *[c for c in ("timestamp", "service", "_home", "_block") if c in rows.columns],
        "_seen",
        found.alias("_found"),
        deltas.alias("metrics_deltas"),
    )
    best = F.slice(F.array_sort("_found"), 1, config.top_k)
    top = F.transform(best, lambda s: s.dropFields("order", "position"))
    # the frame counts at most history_rows rows, so warm-up is all that has fewer than min_rows
    described = described.withColumn(
        "top_anomalous_features", F.when(F.col("_seen") >= config.min_rows, top).otherwise(F.slice(top, 1, 0))
    )
    return home_rows(described.drop("_seen", "_found"))


def _serious(logs: DataFrame) -> DataFrame:
    """WARNING and ERROR lines that have a service and a time; ``_log`` sorts newest first, then by level, message and id."""
    last = F.col("event_id") if "event_id" in logs.columns else F.lit(0)
    known = F.col("service").isNotNull() & F.col("timestamp").isNotNull()
    return logs.where(F.col("level").isin("WARNING", "ERROR") & known).select(
        "service",
        F.unix_micros("timestamp").alias("_at"),
        F.struct((-F.unix_micros("timestamp")).alias("age"), "level", "message", last.alias("id")).alias("_log"),
    )


def recent_logs(lines: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The last few lines per group.

    ``row_number() <= k`` keeps k lines per group on the map side before anything is shuffled.
    """
    newest = W.partitionBy(*keys).orderBy("_log")
    return lines.withColumn("_nr", F.row_number().over(newest)).where(F.col("_nr") <= limit).drop("_nr")


def _lines_before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Rows without a line, with ``_found``: the last ``limit`` lines that ``order`` puts before them in their group."""
    over = f"(PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}, _log DESC)"
    earlier = [F.expr(f"lag(_log, {i}) IGNORE NULLS OVER {over}") for i in range(1, limit + 1)]
    return rows.withColumn("_found", F.array_compact(F.array(*earlier))).where(F.col("_log").isNull()).drop("_log")


def correlated_logs(flagged: DataFrame, logs: DataFrame, config: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """(timestamp, service, correlated_logs): the last ``log_limit`` serious lines in ``[t - window, t]``, newest first.

    Ticks may lie anywhere. Ticks and the last lines of every instant are sorted together in slices of time, and each tick
    takes the lines just before it; a slice also receives the last lines of the slices before it. No tick meets a line in
    a join, so rows move once however many lines lie in a window, and neither a service nor an instant is one task.
    """
    limit = config.log_limit
    window = int(round(config.log_window_min * 60_000_000))
    known = flagged.where(F.col("service").isNotNull() & F.col("timestamp").isNotNull())
    ticks, lines = known.select("service", F.unix_micros("timestamp").alias("_at")), _serious(logs)
    cut = slice_of(F.col("_at"), borders(ticks.select("_at").union(lines.select("_at")), "_at"))
    ticks, lines = ticks.withColumn("_slice", cut).distinct(), lines.withColumn("_slice", cut)
    group, no_line = ["service", "_slice"], F.lit(None).cast(lines.schema["_log"].dataType).alias("_log")
    # at most log_limit lines and one tick per service and slice
    last = recent_logs(lines, group, limit).select(*group, F.lit(1).alias("_order"), "_log")
    asked = ticks.select(*group).distinct().select(*group, F.lit(0).alias("_order"), no_line)
    carried = _lines_before(last.union(asked), ["service"], ["_slice", "_order"], limit)
    carried = carried.select(*group, F.explode("_found").alias("_log"))
    rows = [
        recent_logs(lines, [*group, "_at"], limit).select(*group, "_at", F.lit(0).alias("_order"), "_log"),
        carried.select(*group, (-F.col("_log.age")).alias("_at"), F.lit(0).alias("_order"), "_log"),
        ticks.select(*group, "_at", F.lit(1).alias("_order"), no_line),
    ]
    found = _lines_before(reduce(DataFrame.union, rows), group, ["_at", "_order"], limit)
    near = F.filter("_found", lambda x: -x["age"] >= F.col("_at") - F.lit(window))
    lines_of = F.transform(near, lambda x: F.struct(F.timestamp_micros(-x["age"]).alias("timestamp"), x["level"].alias("level"), x["message"].alias("message")))
    return found.where(F.size(near) > 0).select(
        F.timestamp_micros("_at").alias("timestamp"), "service", F.reverse(F.array_sort(lines_of)).alias("correlated_logs")
    )


def recommended_actions(components: dict[str, Column], top_features: Column) -> Column:
    """Distinct action texts in order: by dominant component first, then by the top three features."""

    def high(name: str) -> Column:
        return F.coalesce(components[name], F.lit(0.0)) > 0.7

    general = [F.when(high(component), text) for component, text in GENERAL_ACTIONS]
    rising = F.filter(F.slice(top_features, 1, 3), lambda f: f["direction"] == "up")

    def texts(feature: Column) -> Column:
        name = feature["feature"]
        made = [
            F.when(F.lower(name).contains(word), F.concat(F.lit(before), name, F.lit(after)))
            for word, before, after in FEATURE_ACTIONS
        ]
        return F.array(*made)

    specific = F.flatten(F.transform(rising, texts))
    return F.array_distinct(F.array_compact(F.concat(F.array(*general), specific)))


def assemble(
    table: DataFrame,
    scored: DataFrame,
    features: Sequence[str],
    logs: DataFrame | None = None,
    config: EvidenceConfig = EvidenceConfig(),
    layout: Layout = AUTO,
) -> DataFrame:
    """One evidence package per row of ``scored`` whose risk reaches the threshold; ``table`` holds the features."""
    present = [c for c in COMPONENTS if c in scored.columns]
    flagged = scored.where(F.col("risk_score") >= config.threshold).select(
        "timestamp", "service", "risk_score", "risk_level", *present
    )
    described = describe_ticks(table, features, config, layout).join(flagged, ["timestamp", "service"])
    if logs is None:
        packed = described.withColumn(
            "correlated_logs", F.lit(None).cast("array<struct<timestamp:timestamp,level:string,message:string>>")
        )
    else:
        packed = described.join(correlated_logs(flagged, logs, config), ["timestamp", "service"], "left")
    components = {c: F.col(c) for c in present}
    for name in COMPONENTS:
        components.setdefault(name, F.lit(None).cast("double"))
    return packed.select(
        "timestamp",
        "service",
        "risk_score",
        "risk_level",
        "failure_probability",
        F.create_map(*[x for c in present for x in (F.lit(c), F.col(c))]).alias("components"),
        "top_anomalous_features",
        "metrics_deltas",
        F.coalesce("correlated_logs", F.array().cast("array<struct<timestamp:timestamp,level:string,message:string>>")).alias(
            "correlated_logs"
        ),
        recommended_actions(components, F.col("top_anomalous_features")).alias("recommended_actions"),
    )


def top_per_service(evidence: DataFrame) -> DataFrame:
    """The highest-risk package of every service."""
    names = evidence.columns
    order = F.struct(F.col("risk_score"), F.col("timestamp"))
    return evidence.groupBy("service").agg(F.max_by(F.struct(*names), order).alias("row")).select("row.*")
