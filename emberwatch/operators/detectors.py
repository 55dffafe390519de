"""Statistical anomaly detectors, their fusion and the severity scale.

A fitted detector is a table (per-service statistics) plus a few numbers for series of unknown services. Scores are
column expressions over the rows joined with that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.config import LEVELS, AnomalyConfig
from emberwatch.functions.columns import as_long, greatest_of, total_of
from emberwatch.operators.evaluation import binary_metrics, decide, level_distribution, mean_lead_time, ranking_metrics
from emberwatch.plans.blocks import AUTO, Layout, home_rows, series
from emberwatch.plans.durable import durable
from emberwatch.plans.quantiles import column_quantiles, merged, quantiles, sketches
from emberwatch.plans.ranking import percentile_ranks

STATISTICAL = ("zscore", "iqr", "rolling_iqr")
QUARTILES = {"q1": 0.25, "q3": 0.75}


def normal_rows(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows on which every label column present is 0."""
    for label in labels:
        if label in df.columns:
            df = df.where(F.col(label) == 0)
    return df


# --- per-service statistics -------------------------------------------------------------------------------------------


def moments(train: DataFrame, features: Sequence[str], eps: float) -> DataFrame:
    """Mean and population deviation per service and feature, in wide form."""
    return train.groupBy("service").agg(*_moment_columns(features, eps))


def _moment_columns(features: Sequence[str], eps: float) -> list[Column]:
    means = [F.avg(f).alias(f"{f}__mean") for f in features]
    return means + [F.greatest(F.stddev_pop(f), F.lit(eps)).alias(f"{f}__std") for f in features]


def _widen(quartiles: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    def pick(feature: str, column: str) -> Column:
        return F.max(F.when(F.col("feature") == feature, F.col(column))).alias(f"{feature}__{column}")

    return quartiles.groupBy(*keys).agg(*[pick(f, q) for f in features for q in ("q1", "q3")])


def quartiles(train: DataFrame, features: Sequence[str], keys: Sequence[str] = ("service",)) -> DataFrame:
    """Exact quartiles per (keys, feature), long form."""
    return quantiles(train, keys, features, QUARTILES)


@dataclass
class Fitted:
    """Per-service statistics and the same numbers over all services, used for services never seen in training."""

    table: DataFrame
    overall: dict[str, float]

    def on(self, df: DataFrame) -> DataFrame:
        """Rows with the statistics of their service, missing ones filled in."""
        joined = df.join(self.table, "service", "left")
        return joined.fillna(self.overall)


def fit_zscore(train: DataFrame, features: Sequence[str], eps: float = 1e-9) -> Fitted:
    overall = train.agg(*_moment_columns(features, eps)).first().asDict()
    return Fitted(durable(moments(train, features, eps), "zscore"), overall)


def fit_iqr(train: DataFrame, features: Sequence[str]) -> Fitted:
    """Quartiles per service and over all services, both bracketed by the sketches of the services, which are made once."""
    sketched = durable(sketches(train, ["service"], features), "iqr-sketches")
    by_service = quantiles(train, ["service"], features, QUARTILES, sketched)
    everywhere = quantiles(train, [], features, QUARTILES, merged(sketched, features))
    return Fitted(durable(_widen(by_service, features, ["service"]), "iqr"), _widen(everywhere, features, []).first().asDict())


def zscore_column(features: Sequence[str]) -> Column:
    return greatest_of([F.abs((F.col(f) - F.col(f"{f}__mean")) / F.col(f"{f}__std")) for f in features])


def excursion(value: Column, q1: Column, q3: Column, eps: float) -> Column:
    """Distance outside [q1, q3] in units of the inter-quartile range."""
    return F.greatest(q1 - value, value - q3, F.lit(0.0)) / F.greatest(q3 - q1, F.lit(eps))


def iqr_column(features: Sequence[str], eps: float) -> Column:
    return greatest_of([excursion(F.col(f), F.col(f"{f}__q1"), F.col(f"{f}__q3"), eps) for f in features])


def score_zscore(df: DataFrame, fitted: Fitted, features: Sequence[str], name: str = "score") -> DataFrame:
    kept = df.columns
    return fitted.on(df).select(*kept, zscore_column(features).alias(name))


def score_iqr(df: DataFrame, fitted: Fitted, features: Sequence[str], eps: float = 1e-9, name: str = "score"):
    kept = df.columns
    return fitted.on(df).select(*kept, iqr_column(features, eps).alias(name))


def score_rolling_iqr(
    df: DataFrame,
    features: Sequence[str],
    config: AnomalyConfig = AnomalyConfig(),
    layout: Layout = AUTO,
    by: Sequence[str] = ("service",),
    name: str = "score",
) -> DataFrame:
    """Excursion beyond the quartiles of the last ``rolling_ticks`` rows of the same series.

    Rolling quartiles are kept up to date row by row inside each task (one sorted window per feature) instead of being
    recomputed per row; a group is one series, or one block of it if the series is long.
    """
    ticks, eps, columns = config.rolling_ticks, config.eps, list(features)
    kept = list(df.columns)
    rows, keys, _ = series(df, layout, ticks - 1, by=by)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("timestamp", kind="mergesort")
        values = group[columns].astype("float64")
        window = values.rolling(ticks, min_periods=1)
        q1, q3 = window.quantile(0.25), window.quantile(0.75)
        outside = np.maximum(np.maximum(q1 - values, values - q3), 0.0)
        return group.assign(**{name: (outside / (q3 - q1).clip(lower=eps)).max(axis=1)})

    return home_rows(rows.groupBy(*keys).applyInPandas(score, schema)).select(*kept, name)


# --- thresholds and severities ----------------------------------------------------------------------------------------


def calibrate(scores: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """One row per ``model`` of a long (model, score) table: decision threshold and severity cuts.

    Severity cuts are forced to increase strictly.
    """
    warning, anomalous, critical = config.severity_quantiles
    c = config.contamination
    q = column_quantiles(
        scores,
        ["model"],
        "score",
        {
            "threshold": 1 - c,
            "median": 0.5,
            "upper": 1 - c / 2,
            "warning": warning,
            "q_anomalous": anomalous,
            "q_critical": critical,
        },
    )
    step = F.lit(1e-12)
    return (
        q.withColumn("anomalous", F.greatest("q_anomalous", F.col("warning") + step))
        .withColumn("critical", F.greatest("q_critical", F.col("anomalous") + step))
        .drop("q_anomalous", "q_critical")
    )


def bucket(score: Column, cuts: Sequence) -> Column:
    """Level of a score: strictly above the third cut CRITICAL, above the second ANOMALOUS, above the first WARNING."""
    return (
        F.when(score > cuts[2], LEVELS[3])
        .when(score > cuts[1], LEVELS[2])
        .when(score > cuts[0], LEVELS[1])
        .otherwise(LEVELS[0])
    )


def severity(score: Column, cuts) -> Column:
    return bucket(score, [cuts["warning"], cuts["anomalous"], cuts["critical"]])


def legacy_level(score: Column, cuts) -> Column:
    """Older scale: cuts at the median, the decision threshold and half the contamination."""
    return bucket(score, [cuts["median"], cuts["threshold"], cuts["upper"]])


# --- fusion -----------------------------------------------------------------------------------------------------------


def member_calibration(train_scores: DataFrame, members: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every member's training scores; a zero deviation counts as 1."""
    row = train_scores.agg(
        *[F.avg(f"{m}_score").alias(f"{m}_mean") for m in members],
        *[F.stddev_pop(f"{m}_score").alias(f"{m}_std") for m in members],
    ).first()
    return {m: (row[f"{m}_mean"], row[f"{m}_std"] or 1.0) for m in members}


def fuse_mean_z(members: Sequence[str], calibration: dict, weights: dict[str, float] | None = None) -> Column:
    weights = weights or {}
    w = {m: float(weights.get(m, 1.0)) for m in members}
    total = sum(w.values()) or 1.0
    parts = [
        F.lit(w[m]) * ((F.col(f"{m}_score") - F.lit(calibration[m][0])) / F.lit(calibration[m][1])) for m in members
    ]
    return total_of(parts) / F.lit(total)


def fuse_mean_rank(
    scored: DataFrame,
    reference: DataFrame,
    members: Sequence[str],
    weights: dict[str, float] | None = None,
    ids: Sequence[str] = ("timestamp", "service"),
    name: str = "ensemble_score",
) -> DataFrame:
    """Weighted mean of the members' percentiles in their training scores, one row per id."""
    weights = weights or {}
    columns = [f"{m}_score" for m in members]
    rows = as_long(scored, ids, columns, "member", "value")
    ranked = percentile_ranks(rows, reference.unpivot([], columns, "member", "value"), ["member"], "value")
    pick = total_of([F.when(F.col("member") == f"{m}_score", F.lit(float(weights.get(m, 1.0)))).otherwise(0.0) for m in members])
    total = sum(float(weights.get(m, 1.0)) for m in members) or 1.0
    return ranked.groupBy(*ids).agg((F.sum(pick * F.col("percentile")) / F.lit(total)).alias(name))


# --- the suite --------------------------------------------------------------------------------------------------------


@dataclass
class Suite:
    features: list[str]
    config: AnomalyConfig
    zscore: Fitted
    iqr: Fitted
    ensemble: dict[str, tuple[float, float]] = field(default_factory=dict)
    cuts: dict[str, dict] = field(default_factory=dict)

    @property
    def models(self) -> list[str]:
        return [*STATISTICAL, "ensemble"]


def _member_scores(df: DataFrame, suite: Suite, by: Sequence[str], layout: Layout) -> DataFrame:
    df = score_rolling_iqr(df, suite.features, suite.config, layout, by, name="rolling_iqr_score")
    df = score_zscore(df, suite.zscore, suite.features, "zscore_score")
    return score_iqr(df, suite.iqr, suite.features, suite.config.eps, "iqr_score")


def long_scores(scored: DataFrame, models: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids, model, score) rows of a wide score frame."""
    columns = [f"{m}_score" for m in models]
    rows = scored.select(*ids, *columns).unpivot(list(ids), columns, "model", "score")
    return rows.withColumn("model", F.regexp_replace("model", "_score$", ""))


def fit_suite(
    train: DataFrame, features: Sequence[str], config: AnomalyConfig = AnomalyConfig(), layout: Layout = AUTO
) -> Suite:
    """Fit every detector on the training rows, then the fusion on their training scores, then all cuts."""
    return fit_and_score(train.select("timestamp", "service", *features), F.lit(True), features, config, ["service"], layout)[0]


def fit_and_score(
    df: DataFrame,
    train: Column,
    features: Sequence[str],
    config: AnomalyConfig = AnomalyConfig(),
    by: Sequence[str] = ("service",),
    layout: Layout = AUTO,
) -> tuple[Suite, DataFrame]:
    """The suite fitted on the rows of ``df`` that ``train`` selects, and the scores of all rows, each scored once."""
    rows = df.where(train)
    suite = Suite(list(features), config, fit_zscore(rows, features, config.eps), fit_iqr(rows, features))
    members = durable(_member_scores(df, suite, by, layout).drop(*features), "member_scores")
    scores = members.where(train)
    suite.ensemble = member_calibration(scores, config.members)
    fused = scores.withColumn("ensemble_score", fuse_mean_z(config.members, suite.ensemble))
    # one row per model, so the cuts are read as plain numbers
    suite.cuts = {row["model"]: row.asDict() for row in calibrate(long_scores(fused, suite.models), config).collect()}
    return suite, _levelled(members, suite)


def score_suite(df: DataFrame, suite: Suite, by: Sequence[str] = ("service",), layout: Layout = AUTO) -> DataFrame:
    """Wide frame: the input without features, score and level per detector, primary level and flag."""
    return _levelled(_member_scores(df, suite, by, layout).drop(*suite.features), suite)


def _levelled(members: DataFrame, suite: Suite) -> DataFrame:
    kept = [c for c in members.columns if c not in [f"{m}_score" for m in STATISTICAL]]
    scored = members.withColumn("ensemble_score", fuse_mean_z(suite.config.members, suite.ensemble))
    primary = suite.config.primary
    levels = [severity(F.col(f"{m}_score"), suite.cuts[m]).alias(f"{m}_level") for m in suite.models]
    out = scored.select(*kept, *[f"{m}_score" for m in suite.models], *levels)
    return out.withColumn("anomaly_level", F.col(f"{primary}_level")).withColumn(
        "anomaly", (F.col("anomaly_level") != LEVELS[0]).cast("int")
    )


def long_score_table(scored: DataFrame, suite: Suite, label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Score-table sink layout: timestamp, service, split, model, score, anomaly, level, label."""
    ids = ["timestamp", "service", "split", label, *extra]
    rows = long_scores(scored, suite.models, ids)

    def by_model(make) -> Column:
        out = None
        for m in suite.models:
            out = F.when(F.col("model") == m, make(m)) if out is None else out.when(F.col("model") == m, make(m))
        return out

    score = F.col("score")
    return rows.select(
        *ids,
        "model",
        "score",
        by_model(lambda m: decide("score", F.lit(suite.cuts[m]["threshold"]), inclusive=False)).alias("anomaly"),
        by_model(lambda m: severity(score, suite.cuts[m])).alias("severity"),
        by_model(lambda m: legacy_level(score, suite.cuts[m])).alias("level"),
    )


def evaluate_suite(table: DataFrame, label: str, keys: Sequence[str] = ("split", "model")) -> DataFrame:
    """Metrics of every detector per split. A row counts as flagged when its severity is not NORMAL."""
    keys = list(keys)
    flagged = table.withColumn("_flag", (F.col("severity") != LEVELS[0]).cast("int"))
    detection = binary_metrics(flagged, label, "_flag", keys)
    ranking = ranking_metrics(flagged, label, "score", keys)
    out = detection.join(ranking, keys, "left")
    if "in_failure" in table.columns:
        inside = binary_metrics(flagged, "in_failure", "_flag", keys)
        out = out.join(
            inside.select(*keys, *[F.col(c).alias(f"in_failure_{c}") for c in ("precision", "recall", "f1")]), keys, "left"
        )
    if "time_to_failure_min" in table.columns:
        out = out.join(mean_lead_time(flagged, label, "_flag", "time_to_failure_min", keys), keys, "left")
    return out


def suite_levels(table: DataFrame, keys: Sequence[str] = ("split", "model")) -> DataFrame:
    return level_distribution(table, "severity", keys)
