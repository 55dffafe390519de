"""Causal features of a telemetry series: every value uses the current and earlier ticks of its service only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from emberwatch.config import FeatureConfig
from emberwatch.functions.columns import finite, null_if_nan
from emberwatch.plans.blocks import AUTO, Layout, home_rows, series
from emberwatch.schemas import METRIC_NAMES


def rolling_mean(value: Column, window: WindowSpec, ticks: int, min_periods: int = 1) -> Column:
    """Mean over the last ``ticks`` rows; NULL with fewer than ``min_periods`` values in the frame."""
    frame = window.rowsBetween(-(ticks - 1), 0)
    mean = F.avg(value).over(frame)
    need = min(min_periods, ticks)
    return mean if need <= 1 else F.when(F.count(value).over(frame) >= need, mean)


def growth_rate(value: Column, window: WindowSpec, ticks: int, eps: float) -> Column:
    """Relative change against the value ``ticks`` rows earlier; 0 during warm-up."""
    before = F.lag(value, ticks).over(window)
    return F.coalesce(finite((value - before) / F.greatest(F.abs(before), F.lit(eps))), F.lit(0.0))


def feature_columns(config: FeatureConfig, window: WindowSpec) -> list[Column]:
    def metric(name: str) -> Column:
        return null_if_nan(F.col(name).cast("double"))

    errors = metric("http_4xx_rate") + metric("http_5xx_rate")
    means = [
        rolling_mean(metric(source), window, ticks, config.min_periods).alias(name)
        for name, source, ticks in config.rolling
    ]
    growth = [growth_rate(metric(s), window, ticks, config.eps).alias(name) for name, s, ticks in config.growth]
    derived = [
        rolling_mean(errors, window, config.ticks(config.error_window_min), config.min_periods).alias("Error_rate"),
        rolling_mean(
            metric("request_rate_rps"), window, config.ticks(config.request_window_min), config.min_periods
        ).alias("Request_rate"),
        (metric("cpu_util_pct") / F.greatest(metric("memory_util_pct"), F.lit(config.eps))).alias("CPU_memory_ratio"),
        (metric("latency_ms") / F.greatest(metric("request_rate_rps"), F.lit(config.request_floor_rps))).alias(
            "latency_per_request"
        ),
    ]
    return means + growth + derived


def require_metrics(metrics: DataFrame) -> None:
    needed = {"timestamp", "service", *METRIC_NAMES} - {
        "network_out_mbps",
        "db_connections",
        "container_restarts",
    }
    missing = sorted(needed - set(metrics.columns))
    if missing:
        raise ValueError(f"metrics missing required columns: {missing}")


def build_features(
    metrics: DataFrame,
    config: FeatureConfig = FeatureConfig(),
    layout: Layout = AUTO,
    also: Callable[[WindowSpec], list[Column]] = lambda window: [],
) -> DataFrame:
    """timestamp, service, the generated features and the pass-through columns present in ``metrics``.

    ``also`` adds columns over the window of a series; their frames reach back ``lookback`` rows at most.
    """
    require_metrics(metrics)
    kept = [c for c in config.passthrough if c in metrics.columns]
    rows, keys, window = series(metrics, layout, config.lookback)
    extra = [c for c in (*keys, "_home") if c in rows.columns and c != "service"]
    featured = rows.select("timestamp", "service", *feature_columns(config, window), *also(window), *kept, *extra)
    return home_rows(featured)
