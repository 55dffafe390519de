"""Detectors, severities, evaluation and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.config import LEVELS
from emberwatch.operators import detectors as d
from emberwatch.operators import evaluation as ev
from emberwatch.operators import forest, models, reconstruction
from emberwatch.operators.boosting import SPACE
from emberwatch.operators.sequences import build_sequences, window_counts
from emberwatch.plans.durable import durable, fresh_folder
from emberwatch.plans.ranking import exact_quantiles, percentile_ranks
from emberwatch.queries.base import FEATURES, GRID, LABEL, Tables, comparable, query
from emberwatch.queries.preparation import KEYS, ids, rounded
from emberwatch.queries.sqlbase import block, over, r, with_blocks
from emberwatch.sources import adapter

MODELS = ["zscore", "iqr", "rolling_iqr", "ensemble"]
LABELS = adapter.LABELS.label_columns

# --- SQL for the detectors --------------------------------------------------------------------------------------------

block(
    "ifit",
    "SELECT service, "
    + ", ".join(f'quantile_cont("{f}", 0.25) AS "{f}__q1", quantile_cont("{f}", 0.75) AS "{f}__q3"' for f in FEATURES)
    + " FROM split WHERE split = 'train' GROUP BY service",
    "split",
)


def outside(value: str, q1: str, q3: str) -> str:
    return f"greatest({q1} - {value}, {value} - {q3}, 0) / greatest({q3} - {q1}, 1e-9)"


IQR = "greatest(" + ", ".join(outside(f's."{f}"', f'i."{f}__q1"', f'i."{f}__q3"') for f in FEATURES) + ")"
RECENT = "OVER (PARTITION BY split, service ORDER BY ts ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"
block(
    "rolling",
    "SELECT service, ts, split, greatest("
    + ", ".join(
        outside(f'"{f}"', f'quantile_cont("{f}", 0.25) {RECENT}', f'quantile_cont("{f}", 0.75) {RECENT}') for f in FEATURES
    )
    + ") AS rolling_iqr_score FROM split",
    "split",
)
ZSCORE = "greatest(" + ", ".join(f'abs((s."{f}" - z."{f}__mean") / z."{f}__std")' for f in FEATURES) + ")"
block(
    "members",
    f"""SELECT s.service, s.ts, s.split, s.{LABEL}, s.in_failure, s.time_to_failure_min, {ZSCORE} AS zscore_score,
    {IQR} AS iqr_score, o.rolling_iqr_score
    FROM split s JOIN zfit z USING (service) JOIN ifit i USING (service) JOIN rolling o USING (split, service, ts)""",
    "zfit",
    "ifit",
    "rolling",
)
PARTS = " + ".join(f"({m}_score - {m}_mean) / {m}_std" for m in MODELS[:3])
block(
    "det",
    f"SELECT m.*, ({PARTS}) / 3e0 AS ensemble_score FROM members m, (SELECT "
    + ", ".join(f"avg({m}_score) AS {m}_mean, stddev_pop({m}_score) AS {m}_std" for m in MODELS[:3])
    + " FROM members WHERE split = 'train') c",
    "members",
)
block(
    "det_long",
    " UNION ALL ".join(
        f"SELECT service, ts, split, {LABEL}, in_failure, time_to_failure_min, '{m}' AS model, {m}_score AS score FROM det"
        for m in MODELS
    ),
    "det",
)
block(
    "cuts",
    """SELECT model, threshold, median, upper, warning, greatest(a, warning + 1e-12) AS anomalous,
    greatest(c, greatest(a, warning + 1e-12) + 1e-12) AS critical
    FROM (SELECT model, quantile_cont(score, 0.95) AS threshold, quantile_cont(score, 0.5) AS median,
    quantile_cont(score, 0.975) AS upper, quantile_cont(score, 0.95) AS warning, quantile_cont(score, 0.975) AS a,
    quantile_cont(score, 0.99) AS c FROM det_long WHERE split = 'train' GROUP BY model)""",
    "det_long",
)


def level(score: str, *cuts: str) -> str:
    w, a, c = cuts
    return f"CASE WHEN {score} > {c} THEN 'CRITICAL' WHEN {score} > {a} THEN 'ANOMALOUS' WHEN {score} > {w} THEN 'WARNING' ELSE 'NORMAL' END"


block(
    "table_",
    f"""SELECT l.* REPLACE ({r('score')} AS score), (score > threshold)::INT AS anomaly, {level('score', 'warning', 'anomalous', 'critical')} AS severity,
    {level('score', 'median', 'threshold', 'upper')} AS level FROM det_long l JOIN cuts USING (model)""",
    "cuts",
)


def confusion(label: str, flag: str) -> dict[str, str]:
    tp, pos, flagged = f"sum({label} * {flag})", f"sum({label})", f"sum({flag})"
    return {
        "rows": "count(*)",
        "support": f"{pos}::BIGINT",
        "flagged": f"{flagged}::BIGINT",
        "precision": r(f"coalesce({tp} / nullif({flagged}, 0), 0)"),
        "recall": r(f"coalesce({tp} / nullif({pos}, 0), 0)"),
        "f1": r(f"coalesce(2 * {tp} / nullif({pos} + {flagged}, 0), 0)"),
        "accuracy": r(f"avg(({label} = {flag})::INT)"),
        "positive_rate": r(f"avg({label})"),
        "predicted_rate": r(f"avg({flag})"),
    }


def confusion_sql(label: str, flag: str, only=None) -> str:
    c = confusion(label, flag)
    return ", ".join(f"{c[k]} AS {k}" for k in (only or c))


def ranking_sql(source: str, label: str, score: str, keys: str) -> str:
    """ROC-AUC and average precision per key from distinct scores."""
    return f"""SELECT {keys}, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum((c - y) * (cy - y / 2e0)) / (max(p) * max(n)) END AS roc_auc,
    CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(y * (cy / cc)) / max(p) END AS pr_auc
    FROM (SELECT {keys}, c, y::DOUBLE AS y, sum(y) OVER w::DOUBLE AS cy, sum(c) OVER w::DOUBLE AS cc, sum(y) OVER g::DOUBLE AS p,
          (sum(c) OVER g - sum(y) OVER g)::DOUBLE AS n
          FROM (SELECT {keys}, {score}, count(*) AS c, sum({label}) AS y FROM {source} GROUP BY {keys}, {score})
          WINDOW w AS (PARTITION BY {keys} ORDER BY {score} DESC), g AS (PARTITION BY {keys})) GROUP BY {keys}"""


# --- fitted statistics ------------------------------------------------------------------------------------------------


def fitted_sql(source: str, a: str, b: str) -> str:
    return with_blocks(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT service, '{f}' AS feature, {r(f'\"{f}__{a}\"', a)}, {r(f'\"{f}__{b}\"', b)} FROM {source}" for f in FEATURES
        )
        + ")",
        source,
    )


@query("a13_service_moments", fitted_sql("zfit", "mean", "std"))
def _(x: Tables):
    fitted = d.fit_zscore(x.part("train"), FEATURES).table
    return fitted.select(
        "service",
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"), F.col(f"{f}__std").alias("std")) for f in FEATURES])),
    )


@query("a14_service_quartiles", fitted_sql("ifit", "q1", "q3"))
def _(x: Tables):
    return d.quartiles(x.part("train"), FEATURES)


@query(
    "a14_event_quartiles",
    with_blocks(
        f"SELECT service, event_type, {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.75)', 'q3')} FROM ev GROUP BY ALL",
        "ev",
    ),
)
def _(x: Tables):
    """Exact quartiles of all event values per service and type."""
    return exact_quantiles(x.events, ["service", "event_type"], "value", {"q1": 0.25, "q3": 0.75})


def suite(x: Tables):
    if not hasattr(x, "_suite"):
        train = F.col("split") == "train"
        x._suite, wide = d.fit_and_score(x.split, train, FEATURES, adapter.ANOMALY, ["split", "service"], GRID)
        x._wide = durable(wide, "suite_scores")
        table = d.long_score_table(x._wide, x._suite, LABEL, ["in_failure", "time_to_failure_min"])
        # scores that are equal up to rounding error must tie alike in both engines
        x._table = durable(table.withColumn("score", comparable(F.col("score"))), "score_table")
    return x._suite


def score_table(x: Tables):
    suite(x)
    return x._table


def one_model(name: str, digits: int = 6) -> str:
    return f"SELECT {ids()}, split, {r(f'{name}_score', 'score', digits)} FROM det"


@query("d1_zscore", with_blocks(f"SELECT {ids()}, split, {r(f'{ZSCORE}', 'score')} FROM split s JOIN zfit z USING (service)", "zfit"))
def _(x: Tables):
    fitted = d.fit_zscore(x.part("train"), FEATURES)
    return d.score_zscore(x.split, fitted, FEATURES).select(*KEYS, "split", "score")


@query("d2_tukey_iqr", with_blocks(f"SELECT {ids()}, split, {r(IQR, 'score')} FROM split s JOIN ifit i USING (service)", "ifit"))
def _(x: Tables):
    fitted = d.fit_iqr(x.part("train"), FEATURES)
    return d.score_iqr(x.split, fitted, FEATURES).select(*KEYS, "split", "score")


@query("d3_rolling_iqr", with_blocks(f"SELECT {ids()}, split, {r('rolling_iqr_score', 'score')} FROM rolling", "rolling"))
def _(x: Tables):
    return d.score_rolling_iqr(x.split, FEATURES, adapter.ANOMALY, GRID, ["split", "service"]).select(*KEYS, "split", "score")


EVENT_RECENT = "OVER (PARTITION BY service ORDER BY ts, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"


@query(
    "w9_rolling_quartiles_events",
    with_blocks(
        f"SELECT event_id, service, {r(f'quantile_cont(value, 0.25) {EVENT_RECENT}', 'q1')}, {r(f'quantile_cont(value, 0.75) {EVENT_RECENT}', 'q3')} FROM ev",
        "ev",
    ),
)
def _(x: Tables):
    """Local quartiles of single events with the built-in aggregate over a bounded frame, in blocks of a service."""
    from emberwatch.plans.blocks import home_rows, series
    from emberwatch.queries.base import EVENT_LAYOUT

    rows, _, window = series(x.events, EVENT_LAYOUT, 119, order=("timestamp", "event_id"))
    both = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(window.rowsBetween(-119, 0))
    out = home_rows(rows.select("event_id", "service", both.alias("q"), "_home", "_block"))
    return out.select("event_id", "service", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))


@query(
    "j7_unseen_service_fallback",
    with_blocks(
        f"""SELECT {ids()}, {r('greatest(' + ', '.join(f'abs((d."{f}" - coalesce(z."{f}__mean", g."{f}__mean")) / coalesce(z."{f}__std", g."{f}__std"))' for f in FEATURES) + ')', 'score')}
        FROM ds d LEFT JOIN (SELECT * FROM zfit WHERE service <> 'svc-4') z USING (service), (SELECT """
        + ", ".join(f'avg("{f}") AS "{f}__mean", greatest(stddev_pop("{f}"), 1e-9) AS "{f}__std"' for f in FEATURES)
        + " FROM split WHERE split = 'train' AND service <> 'svc-4') g",
        "zfit",
        "ds",
    ),
)
def _(x: Tables):
    """One service is unknown at fit time and is scored with the statistics over all others."""
    fitted = d.fit_zscore(x.part("train").where("service <> 'svc-4'"), FEATURES)
    return d.score_zscore(x.dataset, fitted, FEATURES).select(*KEYS, "score")


@query("d7_ensemble_mean_z", with_blocks(one_model("ensemble"), "det"))
def _(x: Tables):
    suite(x)
    return x._wide.select(*KEYS, "split", F.col("ensemble_score").alias("score"))


@query(
    "d7_ensemble_mean_rank",
    with_blocks(
        f"SELECT {ids()}, "
        + r(
            "("
            + " + ".join(
                f"(SELECT count(*) FROM det a WHERE a.split = 'train' AND {r(f'a.{m}_score')} <= {r(f'm.{m}_score')}) / (SELECT count(*) FROM det WHERE split = 'train')::DOUBLE"
                for m in MODELS[:3]
            )
            + ") / 3e0",
            "ensemble_score",
        )
        + " FROM det m",
        "det",
    ),
)
def _(x: Tables):
    suite(x)
    columns = [f"{m}_score" for m in MODELS[:3]]
    rounded_scores = x._wide.select(*KEYS, "split", *[comparable(F.col(c)).alias(c) for c in columns])
    train = rounded_scores.where("split = 'train'").select(*columns)
    return d.fuse_mean_rank(rounded_scores.drop("split"), train, MODELS[:3])


@query(
    "d8_suite_scores",
    with_blocks(
        f"SELECT {ids()}, split, model, {r('score', 'score')}, severity, anomaly FROM table_",
        "table_",
    ),
)
def _(x: Tables):
    return score_table(x).select(*KEYS, "split", "model", "score", "severity", "anomaly")


EVAL = f"""SELECT e.split, e.model, {', '.join('e.' + k for k in confusion('a', 'b'))}, {r('k.roc_auc', 'roc_auc')}, {r('k.pr_auc', 'pr_auc')},
e.in_failure_precision, e.in_failure_recall, e.in_failure_f1, e.mean_lead_time_min FROM (SELECT split, model, {confusion_sql(LABEL, "f")},
{confusion('in_failure', 'f')['precision']} AS in_failure_precision, {confusion('in_failure', 'f')['recall']} AS in_failure_recall,
{confusion('in_failure', 'f')['f1']} AS in_failure_f1, {r(f'avg(CASE WHEN f = 1 AND {LABEL} = 1 THEN time_to_failure_min END)', 'mean_lead_time_min')}
FROM (SELECT *, (severity <> 'NORMAL')::INT AS f FROM table_) GROUP BY split, model) e JOIN ({ranking_sql('table_', LABEL, 'score', 'split, model')}) k USING (split, model)"""


@query("d9_suite_evaluation", with_blocks(EVAL, "table_"))
def _(x: Tables):
    return d.evaluate_suite(score_table(x), LABEL)


@query(
    "p13_severity_bucket",
    with_blocks("SELECT split, model, severity, count(*) AS rows FROM table_ GROUP BY ALL", "table_"),
)
def _(x: Tables):
    return score_table(x).groupBy("split", "model", "severity").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "p14_legacy_level",
    with_blocks(f"SELECT {ids()}, split, model, level FROM table_", "table_"),
)
def _(x: Tables):
    return score_table(x).select(*KEYS, "split", "model", "level")


@query("p11_detector_decision", with_blocks("SELECT split, model, anomaly, count(*) AS rows FROM table_ GROUP BY ALL", "table_"))
def _(x: Tables):
    return score_table(x).groupBy("split", "model", "anomaly").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a15_a16_thresholds",
    with_blocks(
        "SELECT model, " + ", ".join(r(c, c) for c in ("threshold", "median", "upper", "warning", "anomalous", "critical")) + " FROM cuts",
        "cuts",
    ),
)
def _(x: Tables):
    suite(x)
    return d.calibrate(d.long_scores(x._wide.where("split = 'train'"), MODELS), adapter.ANOMALY)


@query(
    "a17_level_distribution",
    with_blocks(
        "SELECT split, model, l.level, count(t.severity) AS count, round(count(t.severity) / max(total)::DOUBLE, 4) AS share FROM "
        "(SELECT split, model, count(*) AS total FROM table_ GROUP BY ALL) k CROSS JOIN (SELECT unnest("
        + str(list(LEVELS))
        + ") AS level) l LEFT JOIN table_ t ON t.split = k.split AND t.model = k.model AND t.severity = l.level GROUP BY k.split, k.model, l.level".replace(
            "GROUP BY k.split, k.model, l.level", "GROUP BY ALL"
        ),
        "table_",
    ).replace("SELECT split, model, l.level", "SELECT k.split, k.model, l.level"),
)
def _(x: Tables):
    return d.suite_levels(score_table(x))


@query(
    "s12_score_sink",
    with_blocks(f"SELECT {ids()}, split, model, {r('score', 'score')}, anomaly, level, {LABEL} FROM table_ WHERE split <> 'train'", "table_"),
)
def _(x: Tables):
    path = fresh_folder(x.spark, "s12")
    table = score_table(x).where("split <> 'train'").select(*KEYS, "split", "model", "score", "anomaly", "level", LABEL)
    table.write.partitionBy("model").parquet(path)
    return x.spark.read.parquet(path)


@query("s16_fitted_tables", fitted_sql("zfit", "mean", "std"))
def _(x: Tables):
    """Fitted statistics written and read back."""
    path = fresh_folder(x.spark, "s16")
    d.moments(x.part("train"), FEATURES, 1e-9).write.parquet(path)
    back = x.spark.read.parquet(path)
    return back.select(
        "service",
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"), F.col(f"{f}__std").alias("std")) for f in FEATURES])),
    )


@query("p10_normal_rows", with_blocks(f"SELECT {ids()} FROM ds WHERE in_failure = 0 AND {LABEL} = 0", "ds"))
def _(x: Tables):
    return d.normal_rows(x.dataset, LABELS).select(*KEYS)


# --- evaluation of scored labels --------------------------------------------------------------------------------------

SCORED = """SELECT doc_id, lang, n_chars::DOUBLE AS score, toxic, quality, (n_chars > 2000)::INT AS flag
FROM documents JOIN labels USING (doc_id)"""


def scored_documents(x: Tables):
    """Labelled documents scored by their length."""
    documents = x.read("documents").select("doc_id", "lang", "n_chars")
    score = F.col("n_chars").cast("double")
    return documents.join(x.read("labels"), "doc_id").select(
        "doc_id", "lang", score.alias("score"), "toxic", "quality", (score > 2000).cast("int").alias("flag")
    )


block("scored_docs", SCORED)


@query("a18_binary_metrics", with_blocks(f"SELECT lang, {confusion_sql('quality', 'flag')} FROM scored_docs GROUP BY lang", "scored_docs"))
def _(x: Tables):
    return ev.binary_metrics(scored_documents(x), "quality", "flag", ["lang"])


@query(
    "a19_ranking_metrics",
    with_blocks(
        f"SELECT lang, {r('roc_auc', 'roc_auc')}, {r('pr_auc', 'pr_auc')} FROM ({ranking_sql('scored_docs', 'quality', 'score', 'lang')})",
        "scored_docs",
    ),
)
def _(x: Tables):
    return ev.ranking_metrics(scored_documents(x), "quality", "score", ["lang"])


@query(
    "a19_ranking_metrics_events",
    f"""WITH e AS (SELECT 1 AS k, value AS score, (event_type = 'error')::INT AS y FROM events)
    SELECT {r('roc_auc', 'roc_auc')}, {r('pr_auc', 'pr_auc')} FROM ({ranking_sql('e', 'y', 'score', 'k')})""",
)
def _(x: Tables):
    rows = x.events.select(F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("y"))
    return ev.ranking_metrics(rows.withColumn("k", F.lit(1)), "y", "score", ["k"]).drop("k")


THRESHOLD = """SELECT lang, f1, score FROM (SELECT lang, score, 2 * p * rc / (p + rc + 1e-12) AS f1,
row_number() OVER (PARTITION BY lang ORDER BY 2 * p * rc / (p + rc + 1e-12) DESC, score) AS nr FROM (SELECT lang, score,
sum(y) OVER w / (sum(c) OVER w)::DOUBLE AS p, coalesce(sum(y) OVER w / nullif(sum(y) OVER g, 0)::DOUBLE, 0) AS rc
FROM (SELECT lang, score, count(*) AS c, sum(quality) AS y FROM scored_docs GROUP BY ALL)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC), g AS (PARTITION BY lang))) WHERE nr = 1"""


@query("a20_best_threshold", with_blocks(f"SELECT lang, score AS threshold, {r('f1', 'best_f1')} FROM ({THRESHOLD})", "scored_docs"))
def _(x: Tables):
    return ev.best_threshold(scored_documents(x), "quality", "score", ["lang"])


@query(
    "p12_classifier_decision",
    with_blocks("SELECT doc_id, (score >= 1000)::INT AS flag FROM scored_docs", "scored_docs"),
)
def _(x: Tables):
    docs = scored_documents(x)
    return docs.select("doc_id", ev.decide("score", F.lit(1000.0), inclusive=True).alias("flag"))


@query(
    "d15_evaluate_at_threshold",
    with_blocks(
        f"SELECT e.*, {r('roc_auc', 'roc_auc')}, {r('pr_auc', 'pr_auc')} FROM (SELECT lang, {confusion_sql('quality', 'f')} FROM (SELECT *, (score >= 1000)::INT AS f FROM scored_docs) GROUP BY lang) e "
        f"JOIN ({ranking_sql('scored_docs', 'quality', 'score', 'lang')}) k USING (lang)",
        "scored_docs",
    ),
)
def _(x: Tables):
    return ev.evaluate_at(scored_documents(x), "quality", "score", 1000.0, ["lang"])


@query(
    "a21_mean_lead_time",
    with_blocks(
        f"SELECT model, split, {r(f'avg(CASE WHEN anomaly = 1 AND {LABEL} = 1 THEN time_to_failure_min END)', 'mean_lead_time_min')} FROM table_ GROUP BY ALL",
        "table_",
    ),
)
def _(x: Tables):
    return ev.mean_lead_time(score_table(x), LABEL, "anomaly", "time_to_failure_min", ["model", "split"])


@query(
    "a35_class_weights",
    "SELECT count(*) AS rows, sum(1 - quality)::BIGINT AS n0, sum(quality)::BIGINT AS n1, "
    + ", ".join(
        [
            r("sum(1 - quality) / sum(quality)", "positive_weight"),
            r("count(*) / (2 * sum(1 - quality))", "balanced_0"),
            r("count(*) / (2 * sum(quality))", "balanced_1"),
        ]
    )
    + " FROM labels",
)
def _(x: Tables):
    return ev.class_weights(x.read("labels"), "quality")


METRIC_LONG = " UNION ALL ".join(
    f"SELECT model, split, '{m}' AS metric, {confusion(LABEL, 'anomaly')[m]} AS value FROM table_ GROUP BY model, split"
    for m in ("f1", "precision", "recall")
)


@query(
    "a34_model_selection",
    with_blocks(
        f"""SELECT model, split, metric, value FROM ({METRIC_LONG}) WHERE metric = 'f1' AND model = (SELECT model FROM ({METRIC_LONG})
        WHERE metric = 'f1' AND split = 'val' ORDER BY value DESC, model LIMIT 1)""",
        "table_",
    ),
)
def _(x: Tables):
    m = ev.binary_metrics(score_table(x), LABEL, "anomaly", ["model", "split"])
    return ev.select_model(m.unpivot(["model", "split"], ["f1", "precision", "recall"], "metric", "value"))


@query(
    "w10_reference_percentile",
    with_blocks(
        f"SELECT event_id, service, {r('(SELECT count(*) FROM ev b WHERE b.event_type = a.event_type AND b.service = \'svc-0\' AND b.value <= a.value) / (SELECT count(*) FROM ev b WHERE b.event_type = a.event_type AND b.service = \'svc-0\')::DOUBLE', 'percentile')} FROM ev a",
        "ev",
    ),
)
def _(x: Tables):
    """Every event value ranked within the values of the first service, per event type."""
    events = x.events.select("event_id", "service", "event_type", "value")
    reference = events.where("service = 'svc-0'").select("event_type", "value")
    return percentile_ranks(events, reference, ["event_type"], "value").select("event_id", "service", "percentile")


@query(
    "w11_batch_percentile",
    with_blocks(f"SELECT event_id, {r('cume_dist() OVER (PARTITION BY event_type ORDER BY value)', 'percentile')} FROM ev", "ev"),
)
def _(x: Tables):
    events = x.events.select("event_id", "event_type", "value")
    return percentile_ranks(events, events.select("event_type", "value"), ["event_type"], "value").select("event_id", "percentile")


# --- sequences --------------------------------------------------------------------------------------------------------

SEQ = 20
SEQ_FRAME = over(f"ROWS BETWEEN {SEQ - 1} PRECEDING AND CURRENT ROW").replace("PARTITION BY service", "PARTITION BY split, service")


@query(
    "w14_sequence_windows",
    with_blocks(
        f"""SELECT {ids()}, split, {LABEL}, {r('total', 'total')}, all_normal::INT AS all_normal FROM (SELECT ts, service, split, {LABEL},
        sum("Error_rate" + "CPU_memory_ratio") {SEQ_FRAME} AS total, max(greatest({LABEL}, in_failure)) {SEQ_FRAME} = 0 AS all_normal,
        count(*) {SEQ_FRAME} AS n FROM split) WHERE n = {SEQ}""",
        "split",
    ),
)
def _(x: Tables):
    """Windows of twenty rows of two features; the flattened window is checked through its sum."""
    w = build_sequences(x.split, ["Error_rate", "CPU_memory_ratio"], LABEL, SEQ, GRID, ["split", "service"], normal_labels=LABELS)
    total = F.aggregate("window", F.lit(0.0), lambda a, v: a + v)
    return w.select(*KEYS, "split", LABEL, total.alias("total"), "all_normal")


@query(
    "w14_window_counts",
    with_blocks(
        f"SELECT split, service, count(*) - {SEQ - 1} AS windows FROM split GROUP BY ALL HAVING count(*) >= {SEQ}",
        "split",
    ),
)
def _(x: Tables):
    w = build_sequences(x.split, ["Error_rate"], LABEL, SEQ, GRID, ["split", "service"])
    return window_counts(w, ["split", "service"])


@query(
    "j10_window_probability",
    with_blocks(
        f"SELECT {ids()}, {r('failure_probability', 'failure_probability')}, (p_windows IS NULL)::INT AS warm_up FROM comp",
        "comp",
    ),
)
def _(x: Tables):
    """Window probabilities stay NULL on warm-up rows and are left out of the mean there."""
    from emberwatch.operators.risk import mean_available

    return x.probed.select(
        *KEYS, mean_available(["p_rows", "p_windows"]).alias("failure_probability"), F.col("p_windows").isNull().alias("warm_up")
    )


# --- trained models: checked by row counts and by tests ---------------------------------------------------------------


@query("d4_isolation_forest")
def _(x: Tables):
    trees = forest.fit_forest(x.part("train").select(*KEYS, *FEATURES), FEATURES)
    scored = forest.score_forest(x.split.select(*KEYS, "split", LABEL, *FEATURES), trees, FEATURES)
    return scored.select(*KEYS, "split", LABEL, "score")


@query("d5_reconstruction_error")
def _(x: Tables):
    net = reconstruction.fit_rows(x.part("train"), FEATURES, LABELS)
    scored = reconstruction.score_rows(x.split.select(*KEYS, "split", LABEL, *FEATURES), net, FEATURES)
    return scored.select(*KEYS, "split", LABEL, "score").withColumn(
        "anomaly", ev.decide("score", F.lit(net.threshold), inclusive=False)
    )


@query("d6_sequence_reconstruction")
def _(x: Tables):
    net = reconstruction.fit_windows(x.part("train"), FEATURES, LABELS)
    scored = reconstruction.score_windows(x.split.select(*KEYS, LABEL, *FEATURES), net, FEATURES, LABEL)
    return scored.select(*KEYS, LABEL, "score").withColumn(
        "anomaly", ev.decide("score", F.lit(net.threshold), inclusive=False)
    )


def trained(x: Tables, name: str, params: dict | None = None):
    cache = x.__dict__.setdefault("_trained", {})
    if name not in cache:
        cache[name] = models.train(x.part("train"), x.part("val"), FEATURES, LABEL, name, params)
    return cache[name]


@query("d10_logistic_regression")
def _(x: Tables):
    return models.evaluate(trained(x, "logistic_regression"), x.split, LABEL, ["split"])


@query("d11_random_forest")
def _(x: Tables):
    return models.evaluate(trained(x, "random_forest"), x.split, LABEL, ["split"])


@query("d12_gradient_boosting")
def _(x: Tables):
    return models.evaluate(trained(x, "histogram_boosting"), x.split, LABEL, ["split"])


@query("d13_randomised_search")
def _(x: Tables):
    """A row per draw with its cross-validated area under ROC, and the metrics of the chosen one on the test rows."""
    best, results = models.tune(x.part("train"), x.part("val"), FEATURES, LABEL)
    test = models.evaluate(best, x.part("test"), LABEL).first()
    rows = [
        (r["draw"], *[float(r[c]) for c in SPACE], r["roc_auc"], *((best.threshold, test["roc_auc"], test["f1"]) if "chosen" in r else (None,) * 3))
        for r in results
    ]
    names = ["draw int", *[f"{c} double" for c in SPACE], "roc_auc double", "threshold double", "test_roc_auc double", "test_f1 double"]
    return x.spark.createDataFrame(rows, ", ".join(names))


@query("d14_sequence_classifier")
def _(x: Tables):
    model = models.train_sequences(x.part("train"), x.part("val"), FEATURES, LABEL)
    scored = models.predict_sequences(model, x.split, LABEL, 20, by=("split", "service"))
    return ev.evaluate_at(scored, LABEL, "probability", model.threshold, ["split"])


@query("t5_feature_importance")
def _(x: Tables):
    return models.importance(trained(x, "logistic_regression"), x.spark)


@query("s17_saved_classifier")
def _(x: Tables):
    path = fresh_folder(x.spark, "s17")
    models.save(trained(x, "logistic_regression"), path, x.spark)
    return models.evaluate(models.load(path, x.spark), x.part("test"), LABEL)


