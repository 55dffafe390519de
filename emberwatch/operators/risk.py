"""Fused incident risk: model probabilities and operational signals weighted into one score per tick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.config import LEVELS, RiskConfig
from emberwatch.functions.columns import half_even, null_if_nan, total_of
from emberwatch.plans.ranking import percentile_ranks

KEYS = ["timestamp", "service"]


def calibration(train: DataFrame, config: RiskConfig = RiskConfig(), anomaly: str | None = None) -> DataFrame:
    """Training reference as a table of (component, value)."""
    sources = {c: f for c, f in config.signals.items() if f in train.columns}
    if anomaly and anomaly in train.columns:
        sources["anomaly_score"] = anomaly
    return _components_long(train, [], sources)


def _components_long(df: DataFrame, ids: Sequence[str], sources: dict[str, str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("component"), F.col(f).cast("double").alias("value")) for c, f in sources.items()]
    rows = df.select(*ids, F.inline(F.array(*parts)))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def signal_percentiles(
    df: DataFrame, reference: DataFrame, config: RiskConfig = RiskConfig(), anomaly: str | None = None
) -> DataFrame:
    """(timestamp, service) with one percentile column per signal, NULL where the signal itself is missing.

    All signals are ranked in one pass over (component, value); the anomaly score is ranked inside the scored rows
    unless the configuration asks for the training reference.
    """
    sources = {c: f for c, f in config.signals.items() if f in df.columns}
    if anomaly:
        sources["anomaly_score"] = anomaly
    rows = _components_long(df, KEYS, sources)
    if anomaly and config.anomaly_reference == "batch":
        own = rows.where(F.col("component") == "anomaly_score").select("component", "value")
        reference = reference.where(F.col("component") != "anomaly_score").unionByName(own)
    ranked = percentile_ranks(rows, reference, ["component"], "value")
    return ranked.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("component") == c, F.col("percentile"))).alias(c) for c in sources]
    )


def mean_available(columns: Sequence[str]) -> Column:
    """Row mean over the columns that have a value; NULL if none has."""
    values = [null_if_nan(F.col(c)) for c in columns]
    known = total_of([v.isNotNull().cast("int") for v in values])
    return F.when(known > 0, total_of([F.coalesce(v, F.lit(0.0)) for v in values]) / known)


def effective_weights(config: RiskConfig, available: Sequence[str]) -> dict[str, float]:
    """Configured weights of the available components, scaled to sum to 1."""
    chosen = {c: w for c, w in config.weights.items() if c in available}
    total = sum(chosen.values()) or 1.0
    return {c: w / total for c, w in chosen.items()}


def fused(weights: dict[str, float]) -> Column:
    """Weighted mean over the components of the row that have a value, within [0, 1]; 0 if none has."""
    values = {c: null_if_nan(F.col(c)) for c in weights}
    mass = total_of([F.when(v.isNotNull(), F.lit(weights[c])).otherwise(0.0) for c, v in values.items()])
    score = total_of([F.lit(weights[c]) * F.coalesce(v, F.lit(0.0)) for c, v in values.items()])
    return F.when(mass > 0, F.least(F.greatest(score / mass, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def risk_level(score: Column, cuts: dict[str, float]) -> Column:
    return (
        F.when(score >= cuts["CRITICAL"], LEVELS[3])
        .when(score >= cuts["ANOMALOUS"], LEVELS[2])
        .when(score >= cuts["WARNING"], LEVELS[1])
        .otherwise(LEVELS[0])
    )


def risk_text(score: Column, level: Column) -> Column:
    """Alert line, e.g. ``INCIDENT RISK 91% — CRITICAL``."""
    return F.format_string("INCIDENT RISK %d%% — %s", half_even(score * 100, 0).cast("int"), level)


def score_risk(
    df: DataFrame,
    reference: DataFrame,
    config: RiskConfig = RiskConfig(),
    probabilities: Sequence[str] = (),
    anomaly: str | None = None,
) -> DataFrame:
    """``df`` with the components, ``risk_score``, ``risk_level`` and ``risk`` (0/1).

    Spark compares column names without case, so a feature named like a component (``Error_rate``) gives its place to it;
    it stays available, under its own name, in the struct ``inputs``.
    """
    signals = signal_percentiles(df, reference, config, anomaly)
    named = {c.lower() for c in (*config.weights, *signals.columns)} - set(KEYS)
    clashing = [c for c in df.columns if c.lower() in named]
    kept = df.withColumn("inputs", F.struct(*clashing)) if clashing else df
    joined = kept.drop(*clashing).join(signals, KEYS, "left")
    probability = mean_available(probabilities) if probabilities else F.lit(None).cast("double")
    joined = joined.withColumn("failure_probability", probability)
    available = ["failure_probability", *[c for c in signals.columns if c not in KEYS]]
    weights = effective_weights(config, available)
    return (
        joined.withColumn("risk_score", fused(weights))
        .withColumn("risk_level", risk_level(F.col("risk_score"), config.cuts))
        .withColumn("risk", (F.col("risk_level") != LEVELS[0]).cast("int"))
    )


def trailing(df: DataFrame, minutes: float) -> DataFrame:
    """Rows of the last ``minutes`` before the newest tick of the whole table."""
    newest = df.agg(F.max("timestamp").alias("newest")).select("newest").scalar()
    return df.where(F.col("timestamp") >= newest - F.make_interval(secs=F.lit(minutes * 60.0)))


def latest_by_service(scored: DataFrame) -> DataFrame:
    """Newest row of every service: partial maxima per task, no sort of a service."""
    names = scored.columns
    newest = scored.groupBy("service").agg(F.max_by(F.struct(*names), F.col("timestamp")).alias("row"))
    return newest.select("row.*")


def fleet_summary(latest: DataFrame) -> DataFrame:
    """Services tracked, services flagged and the newest tick."""
    return latest.agg(
        F.count(F.lit(1)).alias("services"),
        F.coalesce(F.sum("risk"), F.lit(0)).alias("flagged"),
        F.max("timestamp").alias("as_of"),
    )


def riskiest(scored: DataFrame, k: int = 10) -> DataFrame:
    """Top-k rows by risk."""
    return scored.orderBy(F.col("risk_score").desc(), "timestamp", "service").limit(k)
