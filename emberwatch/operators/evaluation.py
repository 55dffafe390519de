"""Quality of flags and scores against labels: confusion-based metrics, ranking metrics, thresholds, lead time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.config import LEVELS
from emberwatch.functions.columns import ratio
from emberwatch.plans.ranking import running_totals


def decide(score: str, threshold, inclusive: bool) -> Column:
    """1 where the score passes the threshold. Detectors exclude the threshold itself, classifiers include it."""
    passed = F.col(score) >= threshold if inclusive else F.col(score) > threshold
    return F.coalesce(passed, F.lit(False)).cast("int")


def confusion_columns(label: str, flag: str) -> list[Column]:
    y, p = F.col(label), F.col(flag)
    support, flagged, rows = F.sum(y), F.sum(p), F.count(F.lit(1))
    hits = F.sum(y * p)
    right = F.sum(F.when(y == p, 1).otherwise(0))
    return [
        rows.alias("rows"),
        support.alias("support"),
        flagged.alias("flagged"),
        ratio(hits, flagged).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2 * hits, support + flagged).alias("f1"),
        ratio(right, rows).alias("accuracy"),
        ratio(support, rows).alias("positive_rate"),
        ratio(flagged, rows).alias("predicted_rate"),
    ]


def binary_metrics(df: DataFrame, label: str, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key; every undefined ratio is 0."""
    return df.groupBy(*keys).agg(*confusion_columns(label, flag))


def score_steps(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score from the highest down with ``cum_n`` rows and ``cum_pos`` positives at or above it."""
    clean = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    return running_totals(clean, keys, score, {"n": F.lit(1), "pos": F.col(label)}, descending=True)


def ranking_columns() -> list[Column]:
    """ROC-AUC (ties count one half) and step-wise average precision over ``score_steps``; NULL with a single class."""
    negatives_here = F.col("n") - F.col("pos")
    pairs = F.sum(negatives_here * (F.col("cum_pos") - F.col("pos") / 2))
    positives, negatives = F.max("total_pos"), F.max(F.col("total_n") - F.col("total_pos"))
    both = (positives > 0) & (negatives > 0)
    precision_steps = F.sum(F.col("pos") * (F.col("cum_pos") / F.col("cum_n")))
    return [
        F.when(both, pairs / (positives * negatives)).alias("roc_auc"),
        F.when(both, precision_steps / positives).alias("pr_auc"),
    ]


def ranking_metrics(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return score_steps(df, label, score, keys).groupBy(*keys).agg(*ranking_columns())


def threshold_columns(score: str) -> list[Column]:
    """F1-optimal threshold over ``score_steps``; the lowest score among equally good ones."""
    precision = F.col("cum_pos") / F.col("cum_n")
    recall = ratio(F.col("cum_pos"), F.col("total_pos"))
    f1 = 2 * precision * recall / (precision + recall + F.lit(1e-12))
    best = F.max(F.struct(f1.alias("f1"), (-F.col(score)).alias("low")))
    return [(-best["low"]).alias("threshold"), best["f1"].alias("best_f1")]


def best_threshold(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return score_steps(df, label, score, keys).groupBy(*keys).agg(*threshold_columns(score))


def evaluate_scores(
    df: DataFrame, label: str, score: str, flag: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Confusion and ranking metrics side by side, one row per key."""
    keys = list(keys)
    if not keys:
        ranking = ranking_metrics(df, label, score)
        return binary_metrics(df, label, flag).select(
            "*", *[ranking.select(c).scalar().alias(c) for c in ("roc_auc", "pr_auc")]
        )
    return binary_metrics(df, label, flag, keys).join(ranking_metrics(df, label, score, keys), keys, "left")


def evaluate_at(df: DataFrame, label: str, score: str, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics of a scored split at a fixed, inclusive threshold."""
    flagged = df.withColumn("_flag", decide(score, F.lit(threshold), inclusive=True))
    return evaluate_scores(flagged, label, score, "_flag", keys)


def mean_lead_time(df: DataFrame, label: str, flag: str, minutes: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average minutes to the failure over correctly flagged rows."""
    hit = (F.col(label) == 1) & (F.col(flag) == 1)
    return df.groupBy(*keys).agg(F.avg(F.when(hit, F.col(minutes))).alias("mean_lead_time_min"))


def level_distribution(df: DataFrame, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of every level, including levels that never occur."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(
        *[F.count(F.when(F.col(level) == name, 1)).alias(name) for name in LEVELS],
        F.count(F.lit(1)).alias("_rows"),
    )
    return counts.unpivot([*keys, "_rows"], list(LEVELS), "level", "count").select(
        *keys, "level", "count", F.round(ratio(F.col("count"), F.col("_rows")), 4).alias("share")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weights per class: n0/n1 for the positive class, and the balanced variant n/(2·count)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label)).alias("n1"),
        F.sum(1 - F.col(label)).alias("n0"),
    )
    known = (F.col("n0") > 0) & (F.col("n1") > 0)
    return counts.select(
        "rows",
        "n0",
        "n1",
        F.when(known, F.col("n0") / F.col("n1")).otherwise(1.0).alias("positive_weight"),
        ratio(F.col("rows"), 2 * F.col("n0")).alias("balanced_0"),
        ratio(F.col("rows"), 2 * F.col("n1")).alias("balanced_1"),
    )


def select_model(metrics: DataFrame, split: str = "val", metric: str = "f1") -> DataFrame:
    """Best model of a (model, split, metric, value) table and its value on every split."""
    best = metrics.where((F.col("split") == split) & (F.col("metric") == metric)).agg(
        F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best")
    )
    return metrics.where((F.col("metric") == metric) & (F.col("model") == best.select("best").scalar()))
