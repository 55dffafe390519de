"""Recovery verification: did the watched metrics of a service come back after remediation?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.config import RecoveryConfig
from emberwatch.functions.columns import half_even
from emberwatch.plans.quantiles import column_quantiles


def snapshot(df: DataFrame, config: RecoveryConfig = RecoveryConfig()) -> DataFrame:
    """Mean of every watched metric present, per service, with the row count."""
    present = [m for m in config.metrics if m in df.columns]
    if not present:
        raise ValueError(f"none of the configured metrics appear in frame ({list(config.metrics)})")
    return df.groupBy("service").agg(F.count(F.lit(1)).alias("rows"), *[F.avg(m).alias(m) for m in present])


def _long(snap: DataFrame, name: str) -> DataFrame:
    metrics = [c for c in snap.columns if c not in ("service", "rows")]
    return snap.unpivot(["service"], metrics, "metric", name)


def check_metric(before: Column, after: Column, threshold: Column, min_improvement: float) -> Column:
    """healthy / improved / worsened / unchanged, tested in this order."""
    return (
        F.when(threshold.isNotNull() & (after <= threshold), "healthy")
        .when(after <= before * (1.0 - min_improvement), "improved")
        .when(after > before * (1.0 + min_improvement), "worsened")
        .otherwise("unchanged")
    )


def check_metrics(before: DataFrame, after: DataFrame, config: RecoveryConfig = RecoveryConfig()) -> DataFrame:
    """One row per service and metric known on both sides."""
    pairs = _long(before, "before").join(_long(after, "after"), ["service", "metric"])
    pairs = pairs.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    limits = F.create_map(*[F.lit(x) for pair in config.thresholds.items() for x in pair])[F.col("metric")]
    checked = pairs.withColumn("threshold", limits)
    status = check_metric(F.col("before"), F.col("after"), F.col("threshold"), config.min_improvement)
    change = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100).otherwise(0.0)
    return (
        checked.withColumn("delta_pct", half_even(change, 4))
        .withColumn("status", status)
        .withColumn("recovered", F.col("status").isin("healthy", "improved"))
    )


def median_time(df: DataFrame) -> DataFrame:
    """Median tick per service in microseconds."""
    times = df.select("service", F.unix_micros("timestamp").cast("double").alias("us"))
    return column_quantiles(times, ["service"], "us", {"mid": 0.5})


def verify(
    before: DataFrame,
    after: DataFrame,
    config: RecoveryConfig = RecoveryConfig(),
    action: str | None = None,
    services: Sequence[str] | None = None,
) -> DataFrame:
    """One verdict per service: SUCCESS when at least one metric was checked and all checked ones recovered."""
    if services is not None:
        before = before.where(F.col("service").isin(*services))
        after = after.where(F.col("service").isin(*services))
    snap_before, snap_after = snapshot(before, config), snapshot(after, config)
    checks = check_metrics(snap_before, snap_after, config).groupBy("service").agg(
        F.bool_and("recovered").alias("all_recovered"),
        F.count(F.lit(1)).alias("checked"),
        F.count(F.when(F.col("recovered"), 1)).alias("recovered_metrics"),
    )
    sizes = snap_before.select("service", F.col("rows").alias("before_rows")).join(
        snap_after.select("service", F.col("rows").alias("after_rows")), "service"
    )
    verdict = sizes.join(checks, "service", "left").select(
        "service",
        F.when(F.coalesce("all_recovered", F.lit(False)), "SUCCESS").otherwise("FAILURE").alias("status"),
        F.coalesce("checked", F.lit(0)).alias("checked"),
        F.coalesce("recovered_metrics", F.lit(0)).alias("recovered_metrics"),
        "before_rows",
        "after_rows",
        F.lit(action).cast("string").alias("action"),
    )
    if "timestamp" not in before.columns or "timestamp" not in after.columns:
        return verdict.withColumn("recovery_time_sec", F.lit(float(config.cooldown_sec)))
    mids = median_time(before).withColumnRenamed("mid", "mid_before").join(
        median_time(after).withColumnRenamed("mid", "mid_after"), "service"
    )
    seconds = F.greatest((F.col("mid_after") - F.col("mid_before")) / F.lit(1e6), F.lit(float(config.cooldown_sec)))
    return verdict.join(mids.select("service", seconds.alias("recovery_time_sec")), "service", "left")


def gate_executed(verdicts: DataFrame, executed: DataFrame) -> DataFrame:
    """Only the services for which at least one action was executed."""
    return verdicts.join(executed.where(F.col("executed") > 0).select("service"), "service", "left_semi")
