"""Risk scoring, fleet views, drift and retraining."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.config import DriftConfig
from emberwatch.operators import drift as dr
from emberwatch.operators import risk as rk
from emberwatch.operators.evaluation import evaluate_scores, level_distribution, mean_lead_time
from emberwatch.operators.splits import split_report
from emberwatch.plans.durable import fresh_folder
from emberwatch.queries.base import FEATURES, LABEL, RANKED, Tables, comparable, query
from emberwatch.queries.detection import confusion, confusion_sql, ranking_sql
from emberwatch.queries.preparation import KEYS, ids
from emberwatch.queries.sqlbase import block, long_of, r, t, with_blocks
from emberwatch.sources import adapter

COMPONENTS = ["failure_probability", "anomaly_score", "error_rate", "latency_trend", "memory_growth"]


def rounded(names, prefix="") -> str:
    return ", ".join(r(f'{prefix}"{n}"', n) for n in names)


# --- risk -------------------------------------------------------------------------------------------------------------


@query(
    "d16_risk_fusion",
    with_blocks(f"SELECT {ids()}, {rounded([*COMPONENTS, 'risk_score'])}, risk_level, risk FROM risk", "risk"),
)
def _(x: Tables):
    scored = rk.score_risk(x.probed, x.reference, adapter.RISK, ["p_rows", "p_windows"], "zscore_score")
    return scored.select(*KEYS, *COMPONENTS, "risk_score", "risk_level", "risk")


Z10 = r('a.zscore_score')
FLAGSHIP = with_blocks(
    f"""SELECT {ids()}, {rounded(['error_rate', 'latency_trend', 'memory_growth', 'anomaly_score'])}, {r('fused', 'risk_score')},
    CASE WHEN fused >= 85e-2 THEN 'CRITICAL' WHEN fused >= 65e-2 THEN 'ANOMALOUS' WHEN fused >= 4e-1 THEN 'WARNING' ELSE 'NORMAL' END AS risk_level
    FROM (SELECT *, (25e-2 * anomaly_score + 15e-2 * error_rate + 1e-1 * latency_trend + 1e-1 * memory_growth) / 6e-1 AS fused,
    row_number() OVER (PARTITION BY service ORDER BY ts DESC) AS nr FROM comp) WHERE nr = 1""",
    "comp",
)


@query("flagship_latest_risk", FLAGSHIP)
def flagship(x: Tables):
    """Events to the newest risk per service without model probabilities: grid, features, split, z-score, percentiles,
    fusion, latest row."""
    from emberwatch.operators.detectors import score_zscore

    scored = score_zscore(x.dataset, x.zscore, FEATURES, "zscore_score")
    scored = scored.withColumns({c: comparable(F.col(c)) for c in RANKED})
    latest = rk.latest_by_service(rk.score_risk(scored, x.reference, adapter.RISK, [], "zscore_score"))
    return latest.select(
        *KEYS, "error_rate", "latency_trend", "memory_growth", "anomaly_score", "risk_score", "risk_level"
    )


AGAINST_TRAIN = (
    f"(SELECT count(*) FROM zs a JOIN split s USING (service, ts) WHERE s.split = 'train' AND {Z10} <= p.zscore_score)"
    " / (SELECT count(*) FROM split WHERE split = 'train')::DOUBLE"
)


@query(
    "d16_risk_anomaly_vs_train",
    with_blocks(f"SELECT {ids()}, {r(AGAINST_TRAIN, 'anomaly_score')} FROM probed p", "probed", "split"),
)
def _(x: Tables):
    """The anomaly score ranked in the training scores instead of in the scored rows."""
    from dataclasses import replace

    config = replace(adapter.RISK, anomaly_reference="train")
    train = x.probed.join(x.part("train").select(*KEYS), KEYS, "left_semi")
    reference = rk.calibration(train, config, "zscore_score")
    return rk.score_risk(x.probed, reference, config, [], "zscore_score").select(*KEYS, "anomaly_score")


@query("s15_risk_calibration", with_blocks(f"SELECT component, count(*) AS n, {r('min(value)', 'lo')}, {r('max(value)', 'hi')} FROM ("
    + long_of("(SELECT \"Error_rate\" AS error_rate, \"Latency_30t_avg\" AS latency_trend, \"Memory_growth_rate\" AS memory_growth FROM split WHERE split = 'train')", ["error_rate", "latency_trend", "memory_growth"], "component")
    + ") GROUP BY component", "split"))
def _(x: Tables):
    path = fresh_folder(x.spark, "s15")
    rk.calibration(x.part("train"), adapter.RISK).write.partitionBy("component").parquet(path)
    back = x.spark.read.parquet(path)
    return back.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("p15_risk_level", with_blocks("SELECT risk_level, risk, count(*) AS rows FROM risk GROUP BY ALL", "risk"))
def _(x: Tables):
    level = rk.risk_level(F.col("risk_score"), adapter.RISK.cuts)
    return x.risk.groupBy(level.alias("risk_level"), (level != "NORMAL").cast("int").alias("risk")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "p16_alert_text",
    with_blocks(
        f"SELECT {ids()}, 'INCIDENT RISK ' || round_even(round(risk_score * 100, 9), 0)::INT || '% — ' || risk_level AS alert FROM risk WHERE risk = 1",
        "risk",
    ),
)
def _(x: Tables):
    return x.risk.where("risk = 1").select(*KEYS, rk.risk_text(F.col("risk_score"), F.col("risk_level")).alias("alert"))


@query("p9_flagged_rows", with_blocks(f"SELECT {ids()} FROM risk WHERE risk_score >= 4e-1", "risk"))
def _(x: Tables):
    return x.risk.where(F.col("risk_score") >= 0.40).select(*KEYS)


@query(
    "p8_trailing_window",
    with_blocks(f"SELECT {ids()}, {r('risk_score', 'risk_score')} FROM risk WHERE ts >= (SELECT max(ts) FROM risk) - INTERVAL 20 HOUR", "risk"),
)
def _(x: Tables):
    return rk.trailing(x.risk, 20 * 60).select(*KEYS, "risk_score")


@query(
    "p8_trailing_events",
    "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY",
)
def _(x: Tables):
    return rk.trailing(x.events, 2 * 1440).select("event_id")


LATEST = "(SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC) AS nr FROM risk)"


@query(
    "w8_latest_by_service",
    with_blocks(
        f"SELECT {ids()}, {r('risk_score', 'risk_score')}, risk_level, row_number() OVER (ORDER BY risk_score DESC, service) AS place FROM {LATEST} WHERE nr = 1",
        "risk",
    ),
)
def _(x: Tables):
    from emberwatch.plans.ranking import numbered

    latest = rk.latest_by_service(x.risk).withColumn("_down", -F.col("risk_score"))
    return numbered(latest, ["_down", "service"], "place").select(*KEYS, "risk_score", "risk_level", "place")


@query(
    "w8_latest_event_per_user",
    f"SELECT user_id, event_id, {t('ts', 'timestamp')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS nr FROM events) WHERE nr = 1",
)
def _(x: Tables):
    """The same operator with every user as a service."""
    by_user = x.events.select("user_id", "event_id", "timestamp", F.col("user_id").alias("service"))
    return rk.latest_by_service(by_user).select("user_id", "event_id", "timestamp")


@query(
    "a30_fleet_summary",
    with_blocks(f"SELECT count(*) AS services, sum(risk)::BIGINT AS flagged, {t('max(ts)', 'as_of')} FROM {LATEST} WHERE nr = 1", "risk"),
)
def _(x: Tables):
    return rk.fleet_summary(rk.latest_by_service(x.risk))


@query(
    "t3_riskiest_rows",
    with_blocks(f"SELECT {ids()}, {r('risk_score', 'risk_score')} FROM risk ORDER BY risk_score DESC, ts, service LIMIT 10", "risk"),
)
def _(x: Tables):
    return rk.riskiest(x.risk, 10).select(*KEYS, "risk_score")


@query(
    "p20_api_rows",
    with_blocks(
        f"SELECT {t('ts')}, service, risk_level, risk, "
        + ", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in ["risk_score", *COMPONENTS])
        + f" FROM {LATEST} WHERE nr = 1",
        "risk",
    ),
)
def _(x: Tables):
    latest = rk.latest_by_service(x.risk)
    numbers = [F.round(F.col(c) + F.lit(1e-9), 4).alias(c) for c in ["risk_score", *COMPONENTS]]
    return latest.select(*KEYS, "risk_level", "risk", *numbers)


@query(
    "a29_overview",
    with_blocks(
        f"""SELECT split, count(*) AS rows, {r('100e0 * count(*) / (SELECT count(*) FROM split)', 'share_pct')}, {r(f'avg({LABEL})', 'positive_rate')},
        (SELECT count(*) FROM ds) AS n_rows, (SELECT count(DISTINCT service) FROM ds) AS n_services FROM split GROUP BY split""",
        "split",
    ),
)
def _(x: Tables):
    report = split_report(x.split, [LABEL])
    total = x.split.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    whole = x.dataset.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("service").alias("n_services"))
    return report.select(
        "split",
        "rows",
        (F.lit(100.0) * F.col("rows") / total).alias("share_pct"),
        F.col(f"{LABEL}_rate").alias("positive_rate"),
        whole.select("n_rows").scalar().alias("n_rows"),
        whole.select("n_services").scalar().alias("n_services"),
    )


block("risk_split", f"SELECT k.*, s.split FROM risk k JOIN (SELECT service, ts, split FROM split) s USING (service, ts)", "risk", "split")


def risk_with_split(x: Tables):
    return x.risk.join(x.split.select(*KEYS, "split"), KEYS)


@query(
    "d15_risk_evaluation",
    with_blocks(
        f"SELECT e.*, {r('roc_auc', 'roc_auc')}, {r('pr_auc', 'pr_auc')} FROM (SELECT split, {confusion_sql(LABEL, 'risk')} FROM risk_split GROUP BY split) e "
        f"JOIN ({ranking_sql('risk_split', LABEL, 'risk_score', 'split')}) k USING (split)",
        "risk_split",
    ),
)
def _(x: Tables):
    return evaluate_scores(risk_with_split(x), LABEL, "risk_score", "risk", ["split"])


@query(
    "a21_risk_lead_time",
    with_blocks(
        f"SELECT split, {r(f'avg(CASE WHEN risk = 1 AND {LABEL} = 1 THEN time_to_failure_min END)', 'mean_lead_time_min')} FROM risk_split GROUP BY split",
        "risk_split",
    ),
)
def _(x: Tables):
    return mean_lead_time(risk_with_split(x), LABEL, "risk", "time_to_failure_min", ["split"])


@query(
    "a17_risk_levels",
    with_blocks(
        "SELECT k.split, l.level, count(t.risk_level) AS count, round(count(t.risk_level) / max(total)::DOUBLE, 4) AS share FROM "
        "(SELECT split, count(*) AS total FROM risk_split GROUP BY ALL) k CROSS JOIN (SELECT unnest(['NORMAL', 'WARNING', 'ANOMALOUS', 'CRITICAL']) AS level) l "
        "LEFT JOIN risk_split t ON t.split = k.split AND t.risk_level = l.level GROUP BY k.split, l.level",
        "risk_split",
    ),
)
def _(x: Tables):
    return level_distribution(risk_with_split(x), "risk_level", ["split"])


# --- drift ------------------------------------------------------------------------------------------------------------

LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EARLY, LATE = "l_shipdate < TIMESTAMP '1998-01-01'", "l_shipdate >= TIMESTAMP '1998-01-01'"


def drift_blocks(name: str, early: str, late: str, columns) -> None:
    """SQL of PSI, KL, KS and moments for two relations, as blocks ``{name}_v``, ``_edges``, ``_psi``, ``_ks``, ``_drift``."""
    block(
        f"{name}_v",
        f"SELECT feature, value, 1 AS ref FROM ({long_of(early, columns)}) WHERE value IS NOT NULL UNION ALL "
        f"SELECT feature, value, 0 FROM ({long_of(late, columns)}) WHERE value IS NOT NULL",
        *[b for b in ("split",) if "split" in early],
    )
    probs = ", ".join(f"{i / 10}" for i in range(1, 10))
    block(
        f"{name}_sides",
        f"""SELECT feature, count(*) FILTER (WHERE ref = 1) AS n, count(*) FILTER (WHERE ref = 0) AS m,
        min(value) FILTER (WHERE ref = 1) AS lo, max(value) FILTER (WHERE ref = 1) AS hi,
        avg(value) FILTER (WHERE ref = 1) AS ref_mean, avg(value) FILTER (WHERE ref = 0) AS tgt_mean,
        stddev_pop(value) FILTER (WHERE ref = 1) AS ref_std, stddev_pop(value) FILTER (WHERE ref = 0) AS tgt_std
        FROM {name}_v GROUP BY feature""",
        f"{name}_v",
    )
    block(
        f"{name}_edges",
        f"""SELECT e.feature, edge FROM (SELECT DISTINCT feature, unnest(quantile_cont(value, [{probs}])) AS edge FROM {name}_v
        WHERE ref = 1 GROUP BY feature) e JOIN {name}_sides s ON s.feature = e.feature AND edge > lo AND edge < hi""",
        f"{name}_sides",
    )
    block(
        f"{name}_bins",
        f"""SELECT b.feature, b.bin, s.n, s.m, k.k, coalesce(sum(v.ref), 0)::DOUBLE AS r, (coalesce(count(v.ref), 0) - coalesce(sum(v.ref), 0))::DOUBLE AS g
        FROM (SELECT feature, unnest(generate_series(0, (count(edge))::BIGINT)) AS bin FROM {name}_sides LEFT JOIN {name}_edges USING (feature) GROUP BY feature) b
        JOIN {name}_sides s USING (feature)
        JOIN (SELECT feature, count(edge) + 1 AS k FROM {name}_sides LEFT JOIN {name}_edges USING (feature) GROUP BY feature) k USING (feature)
        LEFT JOIN (SELECT v.feature, v.ref, count(e.edge) AS bin FROM (SELECT *, row_number() OVER () AS i FROM {name}_v) v
                   LEFT JOIN {name}_edges e ON e.feature = v.feature AND e.edge <= v.value GROUP BY v.i, v.feature, v.ref) v
          ON v.feature = b.feature AND v.bin = b.bin GROUP BY ALL""",
        f"{name}_edges",
    )
    p, q = "((r + 1e-4) / (n + 1e-4 * k))", "((g + 1e-4) / (m + 1e-4 * k))"
    block(
        f"{name}_psi",
        f"SELECT feature, sum(({q} - {p}) * ln({q} / {p})) AS psi, sum({q} * ln({q} / {p})) AS kl FROM {name}_bins GROUP BY feature",
        f"{name}_bins",
    )
    block(
        f"{name}_ks",
        f"""SELECT feature, max(abs(cr / n::DOUBLE - cg / m::DOUBLE)) AS d FROM (SELECT feature, sum(rr) OVER w AS cr, sum(gg) OVER w AS cg FROM
        (SELECT feature, value, sum(ref) AS rr, sum(1 - ref) AS gg FROM {name}_v GROUP BY ALL) WINDOW w AS (PARTITION BY feature ORDER BY value))
        JOIN {name}_sides USING (feature) GROUP BY feature""",
        f"{name}_sides",
    )
    lam = "(d * d * n * m / (n + m))"
    series = " + ".join(f"{2 * (-1) ** (k - 1)}e0 * exp({-2 * k * k}e0 * {lam})" for k in range(1, 21))
    block(
        f"{name}_drift",
        f"""SELECT *, CASE WHEN psi >= 25e-2 THEN 'significant' WHEN psi >= 1e-1 THEN 'moderate' ELSE 'none' END AS drift_level
        FROM (SELECT s.*, greatest(p.psi, 0) AS psi, p.kl, k.d, CASE WHEN {lam} < 4e-2 THEN 1e0 ELSE least(greatest({series}, 0), 1) END AS pvalue
        FROM {name}_sides s JOIN {name}_psi p USING (feature) JOIN {name}_ks k USING (feature))""",
        f"{name}_psi",
        f"{name}_ks",
    )


drift_blocks("line", f"(SELECT * FROM lineitem WHERE {EARLY})", f"(SELECT * FROM lineitem WHERE {LATE})", LINES)
# values that are equal up to rounding error must fall into the same bin in both engines
SPLIT_DIGITS = "(SELECT " + ", ".join(r(f'"{f}"', f) for f in FEATURES) + " FROM split WHERE split = '{0}')"
drift_blocks("grid", SPLIT_DIGITS.format("train"), SPLIT_DIGITS.format("test"), FEATURES)


def split_digits(x: Tables, name: str):
    return x.part(name).select(*KEYS, *[comparable(F.col(f)).alias(f) for f in FEATURES])


def line_sides(x: Tables):
    lines = x.read("lineitem")
    return lines.where(EARLY).select(*LINES), lines.where(LATE).select(*LINES)


DRIFT_COLUMNS = (
    f"feature, {r('psi', 'psi')}, {r('kl', 'kl_divergence')}, {r('d', 'ks_statistic')}, {r('pvalue', 'ks_pvalue')}, "
    f"{r('ref_mean', 'ref_mean')}, {r('tgt_mean', 'tgt_mean')}, {r('tgt_mean - ref_mean', 'mean_shift', 4)}, {r('ref_std', 'ref_std')}, {r('tgt_std', 'tgt_std')}, "
    "drift_level, (drift_level = 'significant' OR (drift_level = 'moderate' AND pvalue < 5e-2))::INT AS drift_detected"
)


def comparable_drift(df):
    return df.withColumn("mean_shift", comparable(F.col("mean_shift"), 4))


@query("a22_a23_lineitem_drift", with_blocks(f"SELECT {DRIFT_COLUMNS} FROM line_drift", "line_drift"))
def _(x: Tables):
    """All line items shipped early against all shipped late."""
    return comparable_drift(dr.feature_drift(*line_sides(x)))


@query("d18_train_test_drift", with_blocks(f"SELECT {DRIFT_COLUMNS} FROM grid_drift", "grid_drift"))
def _(x: Tables):
    return comparable_drift(dr.feature_drift(split_digits(x, "train"), split_digits(x, "test"), FEATURES))


def grid_drift(x: Tables):
    from emberwatch.plans.durable import durable

    if not hasattr(x, "_drift"):
        x._drift = durable(dr.feature_drift(split_digits(x, "train"), split_digits(x, "test"), FEATURES), "grid_drift")
    return x._drift


@query("a22_psi", with_blocks(f"SELECT feature, {r('psi', 'psi')}, {r('kl', 'kl_divergence')} FROM grid_psi", "grid_psi"))
def _(x: Tables):
    return grid_drift(x).select("feature", "psi", "kl_divergence")


@query("a23_ks", with_blocks(f"SELECT feature, {r('d', 'ks_statistic')}, {r('pvalue', 'ks_pvalue')} FROM grid_drift", "grid_drift"))
def _(x: Tables):
    return grid_drift(x).select("feature", "ks_statistic", "ks_pvalue")


@query(
    "a24_moments",
    with_blocks(f"SELECT feature, {rounded(['ref_mean', 'tgt_mean', 'ref_std', 'tgt_std'])} FROM grid_sides", "grid_sides"),
)
def _(x: Tables):
    return grid_drift(x).select("feature", "ref_mean", "tgt_mean", "ref_std", "tgt_std")


@query("p19_drift_level", with_blocks("SELECT drift_level, count(*) AS features FROM grid_drift GROUP BY drift_level", "grid_drift"))
def _(x: Tables):
    level = dr.drift_level(F.col("psi"), adapter.DRIFT)
    return grid_drift(x).groupBy(level.alias("drift_level")).agg(F.count(F.lit(1)).alias("features"))


@query(
    "p17_comparable_columns",
    with_blocks("SELECT unnest(" + str(sorted(FEATURES)) + ") AS feature, count(*) AS rows FROM split GROUP BY 1", "split"),
)
def _(x: Tables):
    columns = dr.comparable_columns(x.part("train"), x.part("test"))
    return x.split.select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows")
    )


SUMMARY = """SELECT count(*) AS total_features, count(*) FILTER (WHERE drift_level = 'significant') AS drifted_features_count,
round(count(*) FILTER (WHERE drift_level = 'significant') / count(*)::DOUBLE, 4) AS drift_share,
(count(*) FILTER (WHERE drift_level = 'significant') / count(*)::DOUBLE >= 3e-1)::INT AS dataset_drift,
list_sort(coalesce(list(feature) FILTER (WHERE drift_level = 'significant'), [])) AS drifted_features,
list_sort(coalesce(list(feature) FILTER (WHERE drift_level = 'moderate'), [])) AS moderate_drift_features FROM {0}"""


@query("a25_dataset_drift", with_blocks(SUMMARY.format("grid_drift"), "grid_drift"))
def _(x: Tables):
    return dr.dataset_drift(grid_drift(x), adapter.DRIFT)


@query("t6_features_by_psi", with_blocks(f"SELECT feature, {r('psi', 'psi')}, row_number() OVER (ORDER BY psi DESC, feature) AS place FROM grid_drift", "grid_drift"))
def _(x: Tables):
    from emberwatch.plans.ranking import numbered

    ranked = numbered(grid_drift(x).select("feature", "psi", (-F.col("psi")).alias("_down")), ["_down", "feature"], "place")
    return ranked.select("feature", "psi", "place").orderBy("place")


PERFORMANCE = (
    "SELECT count(*) AS sample_count, "
    + ", ".join(f"round(({confusion('quality', 'flag')[k]}) + 1e-9, 4) AS {k}" for k in ("f1", "precision", "recall", "accuracy"))
    + " FROM scored_docs"
)


@query(
    "a26_performance",
    with_blocks(
        f"""SELECT *, 95e-2::DOUBLE AS baseline_f1, {r('round(95e-2 - f1, 4)', 'f1_drop')}, (95e-2 - f1 >= 15e-2 OR f1 < 6e-1)::INT AS degraded,
        CASE WHEN 95e-2 - f1 >= 15e-2 OR f1 < 6e-1 THEN 'degraded' ELSE 'ok' END AS status FROM ({PERFORMANCE})""",
        "scored_docs",
    ),
)
def _(x: Tables):
    """Length as a predictor of quality, judged against a promised F1."""
    from emberwatch.queries.detection import scored_documents

    return dr.performance(scored_documents(x), "quality", "flag", 0.95)


REASON = f"""SELECT (drift OR crit)::INT AS retraining_required, CASE WHEN drift OR crit THEN 'warning' ELSE 'normal' END AS severity,
list_filter([CASE WHEN drift THEN 'Dataset drift threshold breached: ' || a || '/' || b || ' features (' || printf('%.1f', round(100e0 * round(a / b::DOUBLE, 4), 1))
 || '%) exhibit significant drift (threshold: 30%).' END,
 CASE WHEN crit THEN 'Critical operational feature(s) drifted significantly: [' || array_to_string(c, ', ') || '].' END], lambda s: s IS NOT NULL) AS trigger_reasons,
c AS critical_drifted FROM (SELECT count(*) FILTER (WHERE drift_level = 'significant') AS a, count(*) AS b,
a / b::DOUBLE >= 3e-1 AS drift, list_sort(coalesce(list(feature) FILTER (WHERE drift_level = 'significant' AND feature IN
 ('Error_rate', 'Latency_30t_avg', 'Memory_growth_rate')), [])) AS c, len(c) > 0 AS crit FROM grid_drift)"""


@query("d17_retraining_decision", with_blocks(REASON, "grid_drift"))
def _(x: Tables):
    report = dr.drift_report(split_digits(x, "train"), split_digits(x, "test"), FEATURES, config=adapter.DRIFT)
    return report["retraining"].select("retraining_required", "severity", "trigger_reasons", "critical_drifted")


ORDERS = ["o_totalprice"]
drift_blocks(
    "ord",
    "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')",
    "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')",
    ORDERS,
)


@query("d18_orders_drift", with_blocks(f"SELECT {DRIFT_COLUMNS} FROM ord_drift", "ord_drift"))
def _(x: Tables):
    orders = x.read("orders")
    early = orders.where("o_orderdate < TIMESTAMP '1998-01-01'").select(*ORDERS)
    late = orders.where("o_orderdate >= TIMESTAMP '1998-01-01'").select(*ORDERS)
    return comparable_drift(dr.feature_drift(early, late, ORDERS, DriftConfig()))
