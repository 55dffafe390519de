"""Feature drift between two tables, model performance watch and the retraining decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.config import DriftConfig
from emberwatch.functions.columns import half_even, total_of
from emberwatch.operators.evaluation import binary_metrics
from emberwatch.plans.durable import durable
from emberwatch.plans.ranking import rank_value, running_totals

NOT_FEATURES = {"timestamp", "service", "in_failure", "time_to_failure_min", "split"}


def comparable_columns(reference: DataFrame, target: DataFrame) -> list[str]:
    """Numeric columns of both tables that are neither identifiers nor labels. Booleans are not numeric."""
    return [
        f.name
        for f in reference.schema.fields
        if f.name in target.columns
        and f.name not in NOT_FEATURES
        and not f.name.startswith("failure_in_next_")
        and isinstance(f.dataType, T.NumericType)
    ]


def _side(df: DataFrame, columns: Sequence[str], is_reference: int) -> DataFrame:
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = doubles.unpivot([], list(columns), "feature", "value")
    kept = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.withColumn("ref", F.lit(is_reference)).withColumn("tgt", F.lit(1 - is_reference))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    lam2 = d * d * n * m / (n + m)
    series = total_of(
        [F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam2) for k in range(1, terms + 1)]
    )
    # the alternating series needs many terms near 0, where the p-value is 1 anyway
    return F.when(lam2 < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def drift_steps(reference: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per feature with running counts of both sides; every statistic below reads this one table."""
    both = _side(reference, columns, 1).unionByName(_side(target, columns, 0))
    return durable(
        running_totals(both, ["feature"], "value", {"ref": F.col("ref"), "tgt": F.col("tgt")}), "drift_steps"
    )


def _shape(steps: DataFrame, config: DriftConfig) -> DataFrame:
    """Per feature: sizes, ranges, means, KS distance and the reference quantile edges."""
    has_ref, has_tgt = F.col("ref") > 0, F.col("tgt") > 0
    gap = F.abs(F.col("cum_ref") / F.col("total_ref") - F.col("cum_tgt") / F.col("total_tgt"))

    def edge(i: int) -> Column:
        position = F.lit(i / config.bins) * (F.col("total_ref") - 1)
        low = rank_value("value", F.floor(position), "ref")
        high = rank_value("value", F.ceil(position), "ref")
        return low + (high - low) * F.max(position - F.floor(position))

    def mean(n: str) -> Column:
        return F.sum(F.col("value") * F.col(n)) / F.max(f"total_{n}")

    return steps.groupBy("feature").agg(
        mean("ref").alias("ref_mean"),
        mean("tgt").alias("tgt_mean"),
        F.max("total_ref").alias("n_ref"),
        F.max("total_tgt").alias("n_tgt"),
        F.min(F.when(has_ref, F.col("value"))).alias("ref_min"),
        F.max(F.when(has_ref, F.col("value"))).alias("ref_max"),
        F.min(F.when(has_tgt, F.col("value"))).alias("tgt_min"),
        F.max(F.when(has_tgt, F.col("value"))).alias("tgt_max"),
        F.max(gap).alias("distance"),
        F.array(*[edge(i) for i in range(config.bins + 1)]).alias("all_edges"),
    )


def psi_bins(steps: DataFrame, shape: DataFrame) -> DataFrame:
    """Rows and squared deviations of both sides per (feature, bin). Bin = number of inner edges at or below the
    value."""
    known = shape.select("feature", "ref_mean", "tgt_mean", F.array_distinct("all_edges").alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    located = steps.join(F.broadcast(known), "feature").withColumn(  # one row per column of the schema
        "bin", F.size(F.filter(inner, lambda e: e <= F.col("value")))
    )

    def squares(n: str) -> Column:
        return F.sum(F.col(n) * F.pow(F.col("value") - F.col(f"{n}_mean"), 2)).alias(f"{n}_squares")

    return located.groupBy("feature", "bin").agg(
        F.sum("ref").alias("ref"), F.sum("tgt").alias("tgt"), squares("ref"), squares("tgt")
    )


def feature_drift(
    reference: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, config: DriftConfig = DriftConfig()
) -> DataFrame:
    """One row per feature: PSI (and KL divergence), KS distance and p-value, moments, drift level, detection flag."""
    columns = list(columns) if columns is not None else comparable_columns(reference, target)
    steps = drift_steps(reference, target, columns)
    shape = durable(_shape(steps, config), "drift_shape")
    eps = F.lit(config.epsilon)

    slots = shape.select(
        "feature",
        "n_ref",
        "n_tgt",
        (F.greatest(F.size(F.array_distinct("all_edges")) - 1, F.lit(1))).alias("k"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.size(F.array_distinct("all_edges")) - 2, F.lit(0)))).alias("bin"),
    )
    filled = slots.join(psi_bins(steps, shape), ["feature", "bin"], "left").fillna(
        0, ["ref", "tgt", "ref_squares", "tgt_squares"]
    )
    p = (F.col("ref") + eps) / (F.col("n_ref") + eps * F.col("k"))
    q = (F.col("tgt") + eps) / (F.col("n_tgt") + eps * F.col("k"))
    index = filled.groupBy("feature").agg(
        F.sum((q - p) * F.ln(q / p)).alias("binned_psi"),
        F.sum(q * F.ln(q / p)).alias("kl_divergence"),
        F.sqrt(F.sum("ref_squares") / F.max("n_ref")).alias("ref_std"),
        F.sqrt(F.sum("tgt_squares") / F.max("n_tgt")).alias("tgt_std"),
    )
    empty = (F.coalesce("n_ref", F.lit(0)) == 0) | (F.coalesce("n_tgt", F.lit(0)) == 0)
    ref_flat = _close(F.col("ref_min"), F.col("ref_max"))
    tgt_flat = _close(F.col("tgt_max"), F.col("tgt_min"))
    same_range = _close(F.col("ref_min"), F.col("tgt_min")) & _close(F.col("ref_max"), F.col("tgt_max"))
    psi = (
        F.when(empty, 0.0)
        .when(ref_flat, F.when(same_range, 0.0).otherwise(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.col("binned_psi")))
    )
    flat_both = ref_flat & tgt_flat
    distance = F.when(empty, 0.0).when(flat_both, F.when(same_range, 0.0).otherwise(1.0)).otherwise(F.col("distance"))
    pvalue = (
        F.when(empty, 1.0)
        .when(flat_both, F.when(same_range, 1.0).otherwise(0.0))
        .otherwise(ks_pvalue(F.col("distance"), F.col("n_ref").cast("double"), F.col("n_tgt").cast("double")))
    )
    out = (
        shape.join(index, "feature")
        .select(
            "feature",
            psi.alias("psi"),
            "kl_divergence",
            distance.alias("ks_statistic"),
            pvalue.alias("ks_pvalue"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ref_mean", "tgt_mean", "ref_std", "tgt_std")],
        )
        .withColumn("mean_shift", F.col("tgt_mean") - F.col("ref_mean"))
    )
    return out.withColumn("drift_level", drift_level(F.col("psi"), config)).withColumn(
        "drift_detected",
        (F.col("drift_level") == "significant")
        | ((F.col("drift_level") == "moderate") & (F.col("ks_pvalue") < config.ks_alpha)),
    )


def drift_level(psi: Column, config: DriftConfig) -> Column:
    return (
        F.when(psi >= config.significant_psi, "significant").when(psi >= config.moderate_psi, "moderate").otherwise("none")
    )


def dataset_drift(features: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """One row: how many features drifted significantly, their share, the verdict and both name lists."""

    def named(level: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("drift_level") == level, F.col("feature"))))

    total, drifted = F.count(F.lit(1)), F.count(F.when(F.col("drift_level") == "significant", 1))
    share = F.when(total > 0, drifted / total).otherwise(0.0)
    return features.agg(
        total.alias("total_features"),
        drifted.alias("drifted_features_count"),
        F.round(share, 4).alias("drift_share"),
        (share >= config.dataset_share).alias("dataset_drift"),
        named("significant").alias("drifted_features"),
        named("moderate").alias("moderate_drift_features"),
    )


def performance(
    df: DataFrame, label: str, flag: str, baseline_f1: float | None = None, config: DriftConfig = DriftConfig()
) -> DataFrame:
    """One row: rolling metrics and the verdict insufficient_data / degraded / ok."""
    m = binary_metrics(df, label, flag).select(
        F.col("rows").alias("sample_count"), *[F.round(c, 4).alias(c) for c in ("f1", "precision", "recall", "accuracy")]
    )
    enough = F.col("sample_count") >= config.min_samples
    drop = F.lit(None).cast("double") if baseline_f1 is None else F.round(F.lit(float(baseline_f1)) - F.col("f1"), 4)
    low = F.col("f1") < config.min_f1
    bad = low if baseline_f1 is None else (drop >= config.f1_drop) | low
    degraded = enough & bad
    return m.select(
        "*",
        F.lit(baseline_f1).cast("double").alias("baseline_f1"),
        F.when(enough, drop).alias("f1_drop"),
        degraded.alias("degraded"),
        F.when(~enough, "insufficient_data").when(degraded, "degraded").otherwise("ok").alias("status"),
    )


def retraining(features: DataFrame, perf: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """One row: is retraining required, why, how urgent and what to do."""
    critical = features.where(
        F.col("feature").isin(*config.critical_features) & (F.col("drift_level") == "significant")
    ).agg(F.array_sort(F.collect_list("feature")).alias("critical_drifted"))
    one = dataset_drift(features, config).select(
        "*",
        critical.select("critical_drifted").scalar().alias("critical_drifted"),
        *[perf.select(c).scalar().alias(c) for c in ("degraded", "f1", "f1_drop", "baseline_f1")],
    )
    names = F.concat(F.lit("["), F.array_join("critical_drifted", ", "), F.lit("]"))
    has_critical = F.size("critical_drifted") > 0
    percent = F.format_string("%.1f", half_even(F.col("drift_share") * 100, 1))
    # Wording of reasons and recommendations.
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("dataset_drift"),
                F.concat(
                    F.lit("Dataset drift threshold breached: "),
                    F.concat_ws("/", F.col("drifted_features_count"), F.col("total_features")),
                    F.lit(" features ("),
                    percent,
                    F.lit(f"%) exhibit significant drift (threshold: {int(config.dataset_share * 100)}%)."),
                ),
            ),
            F.when(has_critical, F.concat(F.lit("Critical operational feature(s) drifted significantly: "), names, F.lit("."))),
            F.when(
                F.col("degraded") & F.col("f1_drop").isNotNull(),
                F.format_string(
                    "Model performance degradation: rolling F1 (%.4f) dropped by %.4f compared to baseline (%.4f).",
                    "f1",
                    "f1_drop",
                    "baseline_f1",
                ),
            ),
            F.when(
                F.col("degraded") & F.col("f1_drop").isNull(),
                F.format_string("Model performance below acceptable threshold: rolling F1 is %.4f.", "f1"),
            ),
        )
    )
    required = F.size("trigger_reasons") > 0
    recommendations = F.when(
        required,
        F.array_compact(
            F.array(
                F.when(
                    F.col("degraded"),
                    "Immediate model retraining required: model accuracy has degraded on recent production telemetry.",
                ).otherwise(
                    "Scheduled model retraining recommended: input feature distributions have shifted significantly "
                    "from baseline."
                ),
                F.when(
                    has_critical, F.concat(F.lit("Inspect upstream service telemetry anomalies affecting: "), names, F.lit("."))
                ),
                F.lit("Update feature baseline and evaluate retrained model candidates via experiment registry."),
            )
        ),
    ).otherwise(
        F.array(
            F.lit(
                "System healthy: feature distributions and model performance are within nominal operating ranges."
            )
        )
    )
    severity = F.when(F.col("degraded"), "critical").when(required, "warning").otherwise("normal")
    return one.withColumn("trigger_reasons", reasons).select(
        required.alias("retraining_required"),
        severity.alias("severity"),
        "trigger_reasons",
        recommendations.alias("recommendations"),
        "critical_drifted",
    )


def drift_report(
    reference: DataFrame,
    target: DataFrame,
    columns: Sequence[str] | None = None,
    label: str | None = None,
    flag: str | None = None,
    baseline_f1: float | None = None,
    config: DriftConfig = DriftConfig(),
) -> dict[str, DataFrame]:
    """The drift job: per-feature results, dataset summary, performance and the retraining decision.

    Predictions must be given as a column of ``target``; without them performance is not judged.
    """
    features = durable(feature_drift(reference, target, columns, config), "feature_drift")
    if label and flag:
        perf = performance(target, label, flag, baseline_f1, config)
    else:
        perf = target.limit(0).agg(
            F.count(F.lit(1)).alias("sample_count"),
            *[F.lit(None).cast("double").alias(c) for c in ("f1", "precision", "recall", "accuracy")],
            F.lit(baseline_f1).cast("double").alias("baseline_f1"),
            F.lit(None).cast("double").alias("f1_drop"),
            F.lit(False).alias("degraded"),
            F.lit("insufficient_data").alias("status"),
        )
    return {
        "features": features,
        "summary": dataset_drift(features, config),
        "performance": perf,
        "retraining": retraining(features, perf, config),
    }
