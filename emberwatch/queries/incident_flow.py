"""Evidence, root cause, remediation, recovery, registry, end-to-end runs and streaming."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from emberwatch.config import PolicyConfig
from emberwatch.operators import evidence as evd
from emberwatch.operators import recovery as rec
from emberwatch.operators import registry as reg
from emberwatch.operators import remediation as rem
from emberwatch.operators import rootcause as rca
from emberwatch.operators.endtoend import fleet_report, fleet_summary, run
from emberwatch.operators.evaluation import binary_metrics
from emberwatch.operators.risk import latest_by_service
from emberwatch.plans.durable import durable, fresh_folder
from emberwatch.queries.base import FEATURES, GRID, LABEL, Tables, query
from emberwatch.queries.detection import confusion, score_table
from emberwatch.queries.preparation import KEYS, ids
from emberwatch.queries.sqlbase import BLOCKS, block, r, t, with_blocks
from emberwatch.sources import adapter
from emberwatch.streaming import jobs

# --- evidence ---------------------------------------------------------------------------------------------------------

BEFORE = "OVER (PARTITION BY service ORDER BY ts ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING)"
block(
    "dev",
    " UNION ALL ".join(
        f"""SELECT service, ts, seen, {i} AS pos, '{f}' AS feature, v AS cur, m AS base_mean, s AS base_std, (v - m) / s AS z FROM
        (SELECT service, ts, "{f}" AS v, avg("{f}") {BEFORE} AS m, stddev_pop("{f}") {BEFORE} + 1e-6 AS s, count("{f}") {BEFORE} AS c,
        row_number() OVER (PARTITION BY service ORDER BY ts) AS seen FROM ds) WHERE c >= 5 AND abs((v - m) / s) > 15e-1 AND seen >= 10"""
        for i, f in enumerate(FEATURES)
    ),
    "ds",
)
block(
    "top5",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service, ts ORDER BY abs(round_even(round(z, 9), 2)) DESC, pos) AS nr FROM dev) WHERE nr <= 5""",
    "dev",
)


@query(
    "w12_trailing_zscores",
    with_blocks(f"SELECT {ids()}, nr AS place, feature, {r('cur', 'current')}, {r('round_even(round(z, 9), 2)', 'zscore')}, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction FROM top5", "top5"),
)
def _(x: Tables):
    """Most deviating features of every row, in order."""
    described = evd.describe_ticks(x.dataset, FEATURES, adapter.EVIDENCE, GRID)
    exploded = described.select(*KEYS, F.posexplode("top_anomalous_features").alias("p", "f"))
    return exploded.select(*KEYS, (F.col("p") + 1).cast("long").alias("place"), "f.feature", "f.current", "f.zscore", "f.direction")


@query(
    "t2_top_features_of_flagged",
    with_blocks(f"SELECT {ids()}, list(feature ORDER BY nr) AS features FROM top5 JOIN risk USING (service, ts) WHERE risk_score >= 4e-1 GROUP BY service, ts", "top5", "risk"),
)
def _(x: Tables):
    described = evd.describe_ticks(x.dataset, FEATURES, adapter.EVIDENCE, GRID).join(x.risk.where("risk_score >= 0.4").select(*KEYS), KEYS)
    names = F.transform("top_anomalous_features", lambda f: f["feature"])
    return described.where(F.size("top_anomalous_features") > 0).select(*KEYS, names.alias("features"))


def change(place: int, metric: str) -> str:
    before = f'lag("{metric}", 19) OVER (PARTITION BY service ORDER BY ts)'
    return f"""SELECT service, ts, {place} AS place, '{metric}' AS metric, CASE WHEN {before} <> 0 THEN round_even(round(("{metric}" - {before}) / {before} * 100, 9), 1)
    ELSE round_even(round("{metric}" - {before}, 9), 1) END AS delta FROM ds"""


block("deltas", " UNION ALL ".join(change(i, m) for i, m in enumerate(adapter.EVIDENCE.delta_metrics)), "ds")


@query("w13_metric_deltas", with_blocks(f"SELECT {ids()}, metric, {r('delta', 'delta')} FROM deltas WHERE delta IS NOT NULL", "deltas"))
def _(x: Tables):
    described = evd.describe_ticks(x.dataset, FEATURES, adapter.EVIDENCE, GRID)
    return described.select(*KEYS, F.explode("metrics_deltas").alias("metric", "delta"))


LOG_CHOICE = """SELECT f.service, f.ts, list(l.message ORDER BY l.ts DESC, l.level DESC, l.message DESC) AS messages FROM risk f
JOIN LATERAL (SELECT * FROM log WHERE log.service = f.service AND log.level IN ('WARNING', 'ERROR') AND log.ts <= f.ts AND log.ts >= f.ts - INTERVAL 20 HOUR
ORDER BY log.ts DESC, log.level, log.message, log.event_id LIMIT 3) l ON true WHERE f.risk_score >= 4e-1 GROUP BY f.service, f.ts"""
block("near", LOG_CHOICE, "risk", "log")


@query(
    "i2_correlated_logs",
    with_blocks(
        f"""SELECT {ids()}, list(message ORDER BY ts_log DESC, level DESC, message DESC) AS messages FROM (
        SELECT f.service, f.ts, l.ts AS ts_log, l.level, l.message,
            row_number() OVER (PARTITION BY f.service, f.ts ORDER BY l.ts DESC, l.level, l.message, l.event_id) AS nr
        FROM (SELECT DISTINCT service, ts FROM log WHERE level = 'ERROR') f
        JOIN log l ON l.service = f.service AND l.level IN ('WARNING', 'ERROR') AND l.ts <= f.ts AND l.ts >= f.ts - INTERVAL 20 HOUR)
        WHERE nr <= 3 GROUP BY service, ts""",
        "log",
    ),
)
def _(x: Tables):
    """Ticks are the times of all errors, which lie anywhere between the borders of the grid."""
    ticks = x.logs.where("level = 'ERROR'").select(*KEYS).distinct()
    logs = evd.correlated_logs(ticks, x.logs, adapter.EVIDENCE)
    return logs.select(*KEYS, F.transform("correlated_logs", lambda e: e["message"]).alias("messages"))


def packages(x: Tables):
    if not hasattr(x, "_packages"):
        x._packages = durable(
            evd.assemble(x.dataset, x.risk, FEATURES, x.logs, adapter.EVIDENCE, GRID), "packages"
        )
    return x._packages


block(
    "pack",
    """SELECT k.service, k.ts, k.risk_score, k.risk_level, k.failure_probability, k.error_rate, k.latency_trend, k.memory_growth, k.anomaly_score,
    coalesce(f.features, []) AS features, coalesce(f.directions, []) AS directions, coalesce(n.messages, []) AS messages
    FROM risk k LEFT JOIN (SELECT service, ts, list(feature ORDER BY nr) AS features, list(CASE WHEN z > 0 THEN 'up' ELSE 'down' END ORDER BY nr) AS directions
    FROM top5 GROUP BY service, ts) f USING (service, ts) LEFT JOIN near n USING (service, ts) WHERE k.risk_score >= 4e-1""",
    "risk",
    "top5",
    "near",
)


# Of numbers with more than ten digits, which stem from division by almost nothing, the first ten are compared.
LONG_NUMBER = r"(\d{10})\d+\.\d+"


@query(
    "i1_evidence",
    with_blocks(
        f"SELECT {ids()}, {r('risk_score', 'risk_score')}, risk_level, features, directions, messages, deltas, "
        + ", ".join(r(c, c) for c in evd.COMPONENTS)
        + " FROM pack LEFT JOIN (SELECT service, ts, list(regexp_replace(metric || '=' || printf('%.1f', delta + 0e0), '" + LONG_NUMBER + "', '\\1') ORDER BY place) AS deltas FROM deltas "
        "WHERE delta IS NOT NULL GROUP BY service, ts) d USING (service, ts)",
        "pack",
        "deltas",
    ),
)
def _(x: Tables):
    """All evidence packages, from the tables to logs."""
    made = evd.assemble(x.dataset, x.risk, FEATURES, x.logs, adapter.EVIDENCE, GRID)
    return made.select(
        *KEYS,
        "risk_score",
        "risk_level",
        F.transform("top_anomalous_features", lambda f: f["feature"]).alias("features"),
        F.transform("top_anomalous_features", lambda f: f["direction"]).alias("directions"),
        F.transform("correlated_logs", lambda e: e["message"]).alias("messages"),
        F.when(F.size("metrics_deltas") > 0, F.transform(F.map_entries("metrics_deltas"), lambda e: F.regexp_replace(F.format_string("%s=%.1f", e["key"], e["value"]), LONG_NUMBER, "$1"))).alias("deltas"),
        *[F.col("components")[c].alias(c) for c in evd.COMPONENTS],
    )


SPECIFIC = [(word, f"'{before}' || feature || '{after}'") for word, before, after in evd.FEATURE_ACTIONS]
block(
    "advice",
    " UNION ALL ".join(f"SELECT service, ts, {i} AS o, '{text}' AS action FROM pack WHERE {c} > 7e-1" for i, (c, text) in enumerate(evd.GENERAL_ACTIONS))
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT service, ts, 100 + nr * 10 + {i}, {text} FROM top5 JOIN pack USING (service, ts) WHERE nr <= 3 AND z > 0 AND contains(lower(feature), '{word}')"
        for i, (word, text) in enumerate(SPECIFIC)
    ),
    "pack",
    "top5",
)


@query(
    "i3_recommended_actions",
    with_blocks(f"SELECT {ids()}, list(action ORDER BY o) AS recommended_actions FROM (SELECT service, ts, action, min(o) AS o FROM advice GROUP BY ALL) GROUP BY service, ts", "advice"),
)
def _(x: Tables):
    return packages(x).where(F.size("recommended_actions") > 0).select(*KEYS, "recommended_actions")


@query(
    "u4_distinct_actions",
    with_blocks("SELECT action, count(DISTINCT (service, ts)) AS packages FROM advice GROUP BY action", "advice"),
)
def _(x: Tables):
    return packages(x).select(F.explode("recommended_actions").alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("packages"))


# --- root cause -------------------------------------------------------------------------------------------------------


def points_sql(text: str, category: str, features: str | None = None) -> str:
    parts = [f"2e0 * contains({text}, '{k}')::INT" for k in rca.KEYWORDS[category]]
    tokens = rca.FEATURE_TOKENS.get(category, [])
    if features and tokens:
        hit = " OR ".join(f"contains(replace(lower(f), '-', '_'), '{k}')" for k in tokens)
        parts.append(f"15e-1 * len(list_filter({features}, lambda f: {hit}))")
    if features and category == "memory_leak":
        parts.append("(memory_growth > 75e-2)::INT")
    return " + ".join(parts)


def category_sql(source: str, text: str, keep: str, features: str | None = None) -> str:
    points = ", ".join(f"({points_sql(text, c, features)})::DOUBLE AS p_{c}" for c in rca.CATEGORIES)
    names = [f"p_{c}" for c in rca.CATEGORIES]
    case = " ".join(f"WHEN best > 0 AND p_{c} = best THEN '{c}'" for c in rca.CATEGORIES)
    return f"""SELECT {keep}, CASE {case} ELSE 'unknown' END AS root_cause_category,
    CASE WHEN best > 0 THEN round_even(round(least(98e-2, 3e-1 + best / ({' + '.join(names)})), 9), 2) ELSE 3e-1 END AS confidence_score
    FROM (SELECT *, greatest({', '.join(names)}) AS best FROM (SELECT {keep}, {points} FROM {source}))"""


block(
    "diag",
    category_sql(
        "(SELECT *, lower(array_to_string(messages, chr(10))) AS txt FROM pack)", "txt", "service, ts, risk_score", "features"
    ),
    "pack",
)


@query(
    "i4_root_cause",
    with_blocks(f"SELECT {ids()}, root_cause_category, {r('confidence_score', 'confidence_score')} FROM diag", "diag"),
)
def _(x: Tables):
    return rca.classify(packages(x)).select(*KEYS, "root_cause_category", "confidence_score")


@query(
    "i4_conversation_keywords",
    category_sql("(SELECT conv_id, turn, lower(text) AS txt FROM conversations)", "txt", "conv_id, turn"),
)
def _(x: Tables):
    """Keyword diagnosis of every conversation turn, whole texts."""
    return rca.classify_text(x.read("conversations"), "text").select("conv_id", "turn", "root_cause_category", "confidence_score")


@query(
    "i4_document_keywords",
    category_sql("(SELECT doc_id, lower(text) AS txt FROM documents)", "txt", "doc_id"),
)
def _(x: Tables):
    return rca.classify_text(x.read("documents"), "text").select("doc_id", "root_cause_category", "confidence_score")


@query("i4_root_cause_full_json")
def _(x: Tables):
    """Keywords searched in the whole package; engines print JSON numbers differently, hence no SQL."""
    return rca.classify(packages(x), "full_json").select(*KEYS, "root_cause_category", "confidence_score")


def case_of(mapping: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@query(
    "i5_summary_and_action",
    with_blocks(
        f"SELECT {ids()}, {case_of(rca.SUMMARIES, 'root_cause_category')} AS probable_root_cause, {case_of(rca.ACTIONS, 'root_cause_category')} AS recommended_action FROM diag",
        "diag",
    ),
)
def _(x: Tables):
    return rca.classify(packages(x)).select(*KEYS, "probable_root_cause", "recommended_action")


block(
    "snip",
    """SELECT service, ts, list_slice([s FOR s IN
        ['component ' || c.k || ' = ' || printf('%.3f', c.v + 1e-9) FOR c IN [
            {'k': 'failure_probability', 'v': failure_probability}, {'k': 'error_rate', 'v': error_rate}, {'k': 'latency_trend', 'v': latency_trend},
            {'k': 'memory_growth', 'v': memory_growth}, {'k': 'anomaly_score', 'v': anomaly_score}]]
        || coalesce(d.deltas, []) || coalesce(f.features, []) || ['log: ' || m FOR m IN list_slice(messages, 1, 4)] IF s IS NOT NULL], 1, 8) AS evidence
    FROM pack LEFT JOIN (SELECT service, ts, list('metric ' || metric || ' delta = ' || printf('%.1f', delta + 0e0) ORDER BY place) AS deltas FROM (
            SELECT *, row_number() OVER (PARTITION BY service, ts ORDER BY place) AS nr FROM deltas WHERE delta IS NOT NULL) WHERE nr <= 4 GROUP BY service, ts) d USING (service, ts)
        LEFT JOIN (SELECT service, ts, list('feature ' || feature || ' z=' || printf('%.2f', round_even(round(z, 9), 2)) || CASE WHEN z > 0 THEN ' (up)' ELSE ' (down)' END ORDER BY nr) AS features
            FROM top5 WHERE nr <= 4 GROUP BY service, ts) f USING (service, ts)""",
    "pack",
    "deltas",
    "top5",
)


@query(
    "i6_evidence_snippets",
    with_blocks(
        f"SELECT {ids()}, CASE WHEN len(evidence) > 0 THEN list_transform(evidence, lambda s: regexp_replace(s, '{LONG_NUMBER}', '\\1')) "
        "ELSE ['no structured evidence available'] END AS evidence FROM snip",
        "snip",
    ),
)
def _(x: Tables):
    """All evidence snippets: components, metric changes, features and log lines."""
    lines = F.transform("evidence", lambda s: F.regexp_replace(s, LONG_NUMBER, "$1"))
    return rca.classify(packages(x)).select(*KEYS, lines.alias("evidence"))


def answers(x: Tables):
    """Turns of all conversations with an answer as a model might write it: fenced, out of range, no JSON, empty."""
    good = F.concat(
        F.lit('```json\n{"probable_root_cause": "case '), F.col("conv_id"), F.lit('", "confidence_score": 0.'), F.col("conv_id") % 10,
        F.lit(', "recommended_action": "restart", "root_cause_category": "'),
        F.when(F.col("conv_id") % 2 == 0, "memory_leak").otherwise("gremlins"), F.lit('"}\n```'),
    )
    kind = F.col("turn") % 4
    text = (
        F.when(kind == 0, good)
        .when(kind == 1, '{"probable_root_cause": "x", "confidence_score": 1.5, "recommended_action": "y"}')
        .when(kind == 2, "no idea")
        .otherwise('{"probable_root_cause": "  ", "confidence_score": 0.5, "recommended_action": "y"}')
    )
    return x.read("conversations").withColumn("answer", text)


@query(
    "i7_answer_validation",
    "SELECT a.conv_id, a.turn, CASE WHEN a.turn % 4 = 0 THEN 'ok' ELSE 'fallback_heuristic' END AS status, "
    "CASE WHEN a.turn % 4 <> 0 THEN c.root_cause_category WHEN a.conv_id % 2 = 0 THEN 'memory_leak' ELSE 'unknown' END AS root_cause_category, "
    "CASE WHEN a.turn % 4 <> 0 THEN c.confidence_score ELSE (a.conv_id % 10) / 10 END AS confidence_score FROM conversations a JOIN ("
    + category_sql("(SELECT conv_id, turn, lower(text) AS txt FROM conversations)", "txt", "conv_id, turn")
    + ") c USING (conv_id, turn)",
)
def _(x: Tables):
    return rca.parse_answers(answers(x), "answer", "text").select("conv_id", "turn", "status", "root_cause_category", "confidence_score")


@query("i8_prompts")
def _(x: Tables):
    return rca.prompts(packages(x))


@query(
    "w18_top_evidence_per_service",
    with_blocks(
        f"SELECT {ids()}, {r('risk_score', 'risk_score')} FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY risk_score DESC, ts DESC) AS nr FROM pack) WHERE nr = 1",
        "pack",
    ),
)
def _(x: Tables):
    return evd.top_per_service(packages(x)).select(*KEYS, "risk_score")


# --- remediation ------------------------------------------------------------------------------------------------------

PLAN_VALUES = ", ".join(f"('{c}', {i + 1}, '{a}', '{d}')" for c, steps in rem.PLANS.items() for i, (a, d) in enumerate(steps))
REGISTRY_VALUES = ", ".join(f"('{a}', '{risk}', {rev}, '{rb}', {params})" for a, (risk, rev, rb, params) in rem.REGISTRY.items())
block(
    "plan",
    f"""SELECT d.service, d.ts, d.root_cause_category AS category, p.step, p.action, p.description, g.action_risk, g.reversible, g.rollback, g.rollback_params
    FROM diag d JOIN (VALUES {PLAN_VALUES}) p(category, step, action, description) ON p.category = d.root_cause_category
    JOIN (VALUES {REGISTRY_VALUES}) g(action, action_risk, reversible, rollback, rollback_params) USING (action)""",
    "diag",
)


def plans(x: Tables):
    return rem.build_plans(rca.classify(packages(x)).select(*KEYS, "root_cause_category"))


@query("j12_action_plan", with_blocks(f"SELECT {ids()}, category, step, action, description FROM plan", "plan"))
def _(x: Tables):
    return plans(x).select(*KEYS, "category", "step", "action", "description")


@query(
    "i9_plan_parameters",
    with_blocks(
        f"""SELECT {ids()}, step, CASE WHEN action = 'restart_container' THEN service END AS container,
        CASE WHEN action <> 'restart_container' THEN service END AS target, CASE WHEN action = 'scale_replicas' THEN '3' END AS replicas,
        CASE WHEN action = 'create_incident_ticket' THEN '[' || service || '] ' || replace(category, '_', ' ') || ' detected' END AS summary FROM plan""",
        "plan",
    ),
)
def _(x: Tables):
    p = F.col("params")
    return plans(x).select(
        *KEYS, "step", p["container"].alias("container"), p["service"].alias("target"), p["count"].alias("replicas"), p["summary"].alias("summary")
    )


@query("j15_action_registry", with_blocks("SELECT action, action_risk, reversible::INT AS reversible, count(*) AS uses FROM plan GROUP BY ALL", "plan"))
def _(x: Tables):
    return plans(x).groupBy("action", "action_risk", "reversible").agg(F.count(F.lit(1)).alias("uses"))


POLICY = PolicyConfig(whitelist=("clear_cache", "restart_container", "scale_replicas"), max_actions=1)
DECIDED = """SELECT *, CASE WHEN allowed AND used < 1 THEN 'execute' ELSE 'propose' END AS decision,
CASE WHEN used >= 1 THEN 'exceeds max_actions_per_incident=1' WHEN action = 'create_incident_ticket'
 THEN 'action ''create_incident_ticket'' not in autonomous whitelist: [''clear_cache'', ''restart_container'', ''scale_replicas'']'
 WHEN action_risk <> 'low' THEN 'risk ''' || action_risk || ''' exceeds autonomous limit ''low''' ELSE 'ok' END AS reason
FROM (SELECT *, coalesce(sum(allowed::INT) OVER (PARTITION BY service, ts ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
FROM (SELECT *, action <> 'create_incident_ticket' AND action_risk = 'low' AS allowed FROM plan))"""
block("decided", DECIDED, "plan")


def decided(x: Tables):
    return rem.decide_actions(plans(x), True, POLICY, ("service", "timestamp"))


@query("i10_policy_decisions", with_blocks(f"SELECT {ids()}, step, action, decision, reason FROM decided", "decided"))
def _(x: Tables):
    return decided(x).select(*KEYS, "step", "action", "decision", "reason")


@query(
    "w15_autonomy_cap",
    with_blocks(f"SELECT {ids()}, count(*) FILTER (WHERE decision = 'execute') AS executed, count(*) AS actions FROM decided GROUP BY service, ts", "decided"),
)
def _(x: Tables):
    d = decided(x)
    return d.groupBy(*KEYS).agg(F.count(F.when(F.col("decision") == "execute", 1)).alias("executed"), F.count(F.lit(1)).alias("actions"))


@query(
    "i11_planned_status",
    with_blocks(
        f"""SELECT {ids()}, step, 'planned' AS advisory, 'planned' AS approval, 'execute' AS approved,
        CASE WHEN decision = 'execute' THEN 'execute' ELSE 'requires_approval' END AS autonomous FROM decided""",
        "decided",
    ),
)
def _(x: Tables):
    d = decided(x)

    def status(mode: str, approved: bool = False, name: str | None = None):
        return rem.planned_status(d, mode, approved).select(*KEYS, "step", F.col("status").alias(name or mode))

    out = status("advisory")
    for other in (status("approval"), status("approval", True, "approved"), status("autonomous")):
        out = out.join(other, [*KEYS, "step"])
    return out


def executed(x: Tables):
    """Outcome of the autonomous run, every executed action taken as successful."""
    done = rem.planned_status(decided(x), "autonomous")
    return done.withColumn("status", F.when(F.col("status") == "execute", "ok").otherwise(F.col("status")))


block("results", "SELECT *, CASE WHEN decision = 'execute' THEN 'ok' ELSE 'requires_approval' END AS status FROM decided", "decided")


@query(
    "i12_rollback_plan",
    with_blocks(
        f"""SELECT {ids()}, step, CASE WHEN status = 'ok' AND reversible THEN 'rollback' ELSE 'skipped' END AS rollback_status,
        CASE WHEN status <> 'ok' THEN 'nothing to roll back' WHEN NOT reversible THEN 'not reversible' ELSE rollback END AS detail,
        CASE WHEN status = 'ok' AND reversible THEN service END AS argument FROM results""",
        "results",
    ),
)
def _(x: Tables):
    plan = rem.rollback_plan(executed(x))
    return plan.select(*KEYS, "step", "rollback_status", "detail", F.element_at(F.map_values("rollback_arguments"), 1).alias("argument"))


@query(
    "a32_execution_counts",
    with_blocks(
        f"SELECT {ids()}, count(*) AS actions, count(*) FILTER (WHERE status = 'ok') AS executed, count(*) FILTER (WHERE status = 'requires_approval') AS pending, "
        "bool_and(status = 'ok')::INT AS all_ok FROM results GROUP BY service, ts",
        "results",
    ),
)
def _(x: Tables):
    return rem.execution_counts(executed(x), ("timestamp", "service"))


NOW = "(SELECT max(ts) FROM metrics)"


@query(
    "i13_pending_approvals",
    with_blocks(
        f"""SELECT service, category, {t('ts', 'event_ts')} FROM (SELECT DISTINCT service, ts, category FROM plan)
        WHERE ts >= {NOW} - INTERVAL 240 HOUR AND service <> 'svc-1'""",
        "plan",
        "metrics",
    ),
)
def _(x: Tables):
    """Approval requests of all incidents; those of one service were taken, old ones have expired."""
    created = rem.approval_requests(plans(x), F.col("timestamp"))
    taken = created.where("service = 'svc-1'").withColumn("event", F.lit("taken")).withColumn(
        "event_ts", F.col("event_ts") + F.expr("interval 1 minute")
    )
    events = created.unionByName(taken).drop("plan")
    now = F.lit(x.metrics.agg(F.max("timestamp")).first()[0])
    return rem.pending_approvals(events, now, 240 * 60).select("service", "category", "event_ts")


# --- recovery ---------------------------------------------------------------------------------------------------------

WATCHED = list(adapter.RECOVERY.metrics)
block(
    "snaps",
    "SELECT service, "
    + ", ".join(
        f'avg("{m}") FILTER (WHERE split = \'val\') AS "{m}_b", avg("{m}") FILTER (WHERE split = \'test\') AS "{m}_a"' for m in WATCHED
    )
    + ", count(*) FILTER (WHERE split = 'val') AS before_rows, count(*) FILTER (WHERE split = 'test') AS after_rows, "
    "quantile_cont(epoch_us(ts), 0.5) FILTER (WHERE split = 'val') AS mid_b, quantile_cont(epoch_us(ts), 0.5) FILTER (WHERE split = 'test') AS mid_a "
    "FROM split GROUP BY service",
    "split",
)
block(
    "chk",
    " UNION ALL ".join(
        f"""SELECT service, '{m}' AS metric, "{m}_b" AS before, "{m}_a" AS after, {adapter.RECOVERY.thresholds[m]}::DOUBLE AS threshold FROM snaps"""
        for m in WATCHED
    ),
    "snaps",
)
STATUS = "CASE WHEN after <= threshold THEN 'healthy' WHEN after <= before * 95e-2 THEN 'improved' WHEN after > before * 105e-2 THEN 'worsened' ELSE 'unchanged' END"
block("checked", f"SELECT *, {STATUS} AS status, {STATUS} IN ('healthy', 'improved') AS recovered FROM chk", "chk")


@query(
    "a27_recovery_snapshot",
    with_blocks("SELECT service, before_rows AS rows, " + ", ".join(r(f'"{m}_b"', m) for m in WATCHED) + " FROM snaps", "snaps"),
)
def _(x: Tables):
    return rec.snapshot(x.part("val"), adapter.RECOVERY)


@query("a28_median_time", with_blocks(f"SELECT service, {r('mid_b / 6e7', 'median_min')} FROM snaps", "snaps"))
def _(x: Tables):
    return rec.median_time(x.part("val")).select("service", (F.col("mid") / 6e7).alias("median_min"))


CHECKS = (
    f"SELECT service, metric, {r('before', 'before')}, {r('after', 'after')}, threshold, "
    "round_even(round(CASE WHEN before <> 0 THEN (after - before) / before * 100 ELSE 0 END, 9), 4) AS delta_pct, status, recovered::INT AS recovered FROM checked"
)


@query("i14_metric_checks", with_blocks(CHECKS, "checked"))
def _(x: Tables):
    return rec.check_metrics(rec.snapshot(x.part("val"), adapter.RECOVERY), rec.snapshot(x.part("test"), adapter.RECOVERY), adapter.RECOVERY)


@query("j11_snapshot_pairs", with_blocks(f"SELECT service, metric, {r('before', 'before')}, {r('after', 'after')} FROM chk", "chk"))
def _(x: Tables):
    before, after = rec.snapshot(x.part("val"), adapter.RECOVERY), rec.snapshot(x.part("test"), adapter.RECOVERY)
    return rec.check_metrics(before, after, adapter.RECOVERY).select("service", "metric", "before", "after")


block(
    "verdicts",
    """SELECT service, CASE WHEN bool_and(recovered) THEN 'SUCCESS' ELSE 'FAILURE' END AS status, count(*) AS checked,
    count(*) FILTER (WHERE recovered) AS recovered_metrics, max(before_rows) AS before_rows, max(after_rows) AS after_rows,
    max(greatest((mid_a - mid_b) / 1e6, 3600)) AS recovery_time_sec FROM checked JOIN snaps USING (service) GROUP BY service""",
    "checked",
)


@query(
    "i15_recovery_verdict",
    with_blocks(f"SELECT * REPLACE ({r('recovery_time_sec')} AS recovery_time_sec), 'restart' AS action FROM verdicts", "verdicts"),
)
def _(x: Tables):
    return rec.verify(x.part("val"), x.part("test"), adapter.RECOVERY, action="restart")


@query(
    "i16_gated_verdict",
    with_blocks("SELECT service, status FROM verdicts WHERE service IN (SELECT service FROM results WHERE status = 'ok')", "verdicts", "results"),
)
def _(x: Tables):
    """Verdicts only for services on which something was executed."""
    verdicts = rec.verify(x.part("val"), x.part("test"), adapter.RECOVERY)
    return rec.gate_executed(verdicts, rem.execution_counts(executed(x))).select("service", "status")


# --- end to end -------------------------------------------------------------------------------------------------------


def incident_run(x: Tables, **options):
    return run(
        x.dataset.join(x.probed.select(*KEYS, "p_rows", "p_windows", "zscore_score"), KEYS),
        x.reference,
        FEATURES,
        x.logs,
        ["p_rows", "p_windows"],
        "zscore_score",
        adapter.RISK,
        adapter.EVIDENCE,
        POLICY,
        adapter.RECOVERY,
        layout=GRID,
        **options,
    )


@query(
    "i17_incident_run",
    with_blocks(
        f"""SELECT {ids()}, category, step, action, CASE WHEN decision = 'execute' THEN 'execute' ELSE 'requires_approval' END AS status FROM decided
        JOIN (SELECT service, ts FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY risk_score DESC, ts DESC) AS nr FROM pack) WHERE nr = 1) w USING (service, ts)""",
        "decided",
        "pack",
    ),
)
def _(x: Tables):
    """Every stage in one run: the planned actions for the worst tick of each service."""
    outcome = incident_run(x, mode="autonomous")
    return outcome.actions.select(*KEYS, "category", "step", "action", "status")


@query(
    "i17_single_service_run",
    with_blocks(
        f"""SELECT {ids()}, category, step, action FROM plan JOIN (SELECT service, ts FROM pack ORDER BY risk_score DESC, service LIMIT 1) w USING (service, ts)""",
        "plan",
        "pack",
    ),
)
def _(x: Tables):
    outcome = incident_run(x, mode="approval", per_service=False)
    return outcome.actions.select(*KEYS, "category", "step", "action")


WHOLE = ", ".join(f'avg("{m}") AS "{m}_b", avg("{m}") FILTER (WHERE ts > (SELECT test_start FROM borders)) AS "{m}_a"' for m in WATCHED)
FINE = " AND ".join(
    f'("{m}_a" <= {adapter.RECOVERY.thresholds[m]} OR "{m}_a" <= "{m}_b" * 95e-2)' for m in WATCHED
)


@query(
    "a33_fleet_report",
    with_blocks(
        f"""SELECT count(*) AS services, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE flagged) AS remediated,
        count(*) FILTER (WHERE flagged AND fine) AS recovered, bool_and(flagged AND fine)::INT AS all_ok FROM
        (SELECT service, service IN (SELECT service FROM pack) AS flagged, {FINE} AS fine FROM (SELECT service, {WHOLE} FROM ds GROUP BY service))""",
        "pack",
        "borders",
    ),
)
def _(x: Tables):
    """Stages of the run put side by side per service; recovery compares the whole series with its last part."""
    outcome = incident_run(x, mode="autonomous", after=x.part("test"))
    return fleet_summary(fleet_report(outcome))


# --- experiment registry ----------------------------------------------------------------------------------------------

block(
    "runs",
    f"""SELECT 'detector' AS family, model, split AS dataset_version, {confusion(LABEL, 'anomaly')['f1']} AS f1, {confusion(LABEL, 'anomaly')['recall']} AS recall
    FROM table_ GROUP BY model, split""",
    "table_",
)


def experiments(x: Tables):
    """One experiment per detector and split, scored from the score table."""
    m = binary_metrics(score_table(x), LABEL, "anomaly", ["model", "split"])
    stamp = {"train": 1, "val": 2, "test": 3}
    day = F.create_map(*[F.lit(v) for pair in stamp.items() for v in pair])[F.col("split")]
    from emberwatch.queries.base import comparable

    return m.select(
        F.substring(F.sha2(F.concat_ws("|", "model", "split"), 256), 1, 12).alias("experiment_id"),
        F.lit("detector").alias("family"),
        "model",
        day.alias("model_version"),
        F.col("split").alias("dataset_version"),
        F.create_map(F.lit("test"), F.create_map(F.lit("f1"), comparable(F.col("f1")), F.lit("recall"), comparable(F.col("recall")))).alias("metrics"),
        F.make_timestamp(F.lit(2024), F.lit(2), day, F.lit(0), F.lit(0), F.lit(0)).alias("trained_at"),
        F.lit("ok").alias("status"),
    )


VERSION = "CASE dataset_version WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END"


@query(
    "a31_registry_compare",
    with_blocks(
        f"""SELECT family, model, version AS model_version, dataset_version, 'test' AS split, 'f1' AS metric, f1 AS value, substr(sha256(model || '|' || dataset_version), 1, 12) AS experiment_id
        FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, version) AS nr FROM (SELECT *, {VERSION} AS version FROM runs)) WHERE nr = 1""",
        "runs",
    ),
)
def _(x: Tables):
    return reg.compare(experiments(x))


@query("a31_latest_and_next", with_blocks("SELECT family, model, 3 AS latest_version, 4 AS next_version FROM runs GROUP BY ALL", "runs"))
def _(x: Tables):
    e = experiments(x)
    newest = reg.latest(e).select("family", "model", F.col("model_version").alias("latest_version"))
    return newest.join(reg.next_version(e), ["family", "model"])


@query("u6_model_keys", with_blocks("SELECT DISTINCT family || '/' || model AS model_key FROM runs", "runs"))
def _(x: Tables):
    return reg.models(experiments(x))


@query(
    "t7_compare_order",
    with_blocks(
        "SELECT model, best AS value, row_number() OVER (ORDER BY best DESC, model) AS place FROM (SELECT model, max(f1) AS best FROM runs GROUP BY model)",
        "runs",
    ),
)
def _(x: Tables):
    from emberwatch.plans.ranking import numbered

    c = reg.compare(experiments(x)).select("model", "value", (-F.col("value")).alias("_down"))
    return numbered(c, ["_down", "model"], "place").select("model", "value", "place")


@query(
    "i22_backfill",
    with_blocks(
        "SELECT family, model, dataset_version, 2 + row_number() OVER (PARTITION BY model ORDER BY dataset_version) - 1 AS model_version FROM runs WHERE dataset_version = 'test'",
        "runs",
    ),
)
def _(x: Tables):
    """The registry holds the first two runs of every detector; only the third is new."""
    e = experiments(x)
    existing = e.where("dataset_version <> 'test'").withColumn("model_version", F.col("model_version").cast("int"))
    existing = existing.withColumn("model_version", F.least("model_version", F.lit(1)))
    return reg.backfill(e.drop("experiment_id", "model_version"), existing).select(
        "family", "model", "dataset_version", F.col("model_version").cast("long").alias("model_version")
    )


@query("j13_untracked", with_blocks("SELECT family, model, dataset_version FROM runs WHERE dataset_version = 'test'", "runs"))
def _(x: Tables):
    e = experiments(x)
    return reg.untracked(e, e.where("dataset_version <> 'test'")).select("family", "model", "dataset_version")


@query(
    "w17_running_version",
    with_blocks(f"SELECT model, dataset_version, row_number() OVER (PARTITION BY model ORDER BY {VERSION}) AS model_version FROM runs", "runs"),
)
def _(x: Tables):
    return reg.assign_versions(experiments(x)).select("model", "dataset_version", F.col("model_version").cast("long").alias("model_version"))


# --- streaming --------------------------------------------------------------------------------------------------------


FILES = 2  # files a time slice


def as_files(df, x: Tables, label: str, by: str = "timestamp", parts: int = 4) -> str:
    """The table as a folder of files to be streamed, ``FILES`` a slice of time. Slices are written one after the other
    because a file source reads files in the order of their modification."""
    path = fresh_folder(x.spark, label)
    df = durable(df, f"{label}_rows")
    ends = df.agg(F.min(by).alias("lo"), F.max(by).alias("hi")).first()
    step = (ends["hi"] - ends["lo"]) / parts
    for i in range(parts):
        rows = df.where(F.col(by) >= F.lit(ends["lo"] + i * step))
        if i < parts - 1:
            rows = rows.where(F.col(by) < F.lit(ends["lo"] + (i + 1) * step))
        rows.repartition(FILES).write.mode("append").parquet(path)
    return path


@contextmanager
def state_partitions(spark: SparkSession):
    """Stateful streams keep one state store per shuffle partition and are not coalesced: one per core is enough here."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drain_to_files(stream, x: Tables, label: str) -> str:
    """Runs a bounded stream to its end into Parquet files."""
    out, check = fresh_folder(x.spark, f"{label}_out"), fresh_folder(x.spark, f"{label}_ck")
    with state_partitions(x.spark):
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        writer.trigger(availableNow=True).start().awaitTermination()
    return out


@query("g1_stream_ingest", with_blocks("SELECT strftime(ts, '%Y-%m-%d-%H') AS dt, level, count(*) AS lines FROM log GROUP BY ALL", "log"))
def _(x: Tables):
    source, out = as_files(x.logs, x, "g1_in"), fresh_folder(x.spark, "g1_out")
    stream = jobs.stream_table(x.spark, source, x.logs.schema, per_batch=FILES)
    jobs.ingest(stream, out, fresh_folder(x.spark, "g1_ck"), available_now=True).awaitTermination()
    return x.spark.read.parquet(out).groupBy(F.col("dt").cast("string").alias("dt"), "level").agg(F.count(F.lit(1)).alias("lines"))


@query("g2_stream_deduplicate", with_blocks("SELECT service, count(*) AS rows FROM metrics GROUP BY service", "metrics"))
def _(x: Tables):
    """Every tick arrives twice and is kept once."""
    twice = x.metrics.unionByName(x.metrics).select(*KEYS, "latency_ms")
    stream = jobs.stream_table(x.spark, as_files(twice, x, "g2_in"), twice.schema, per_batch=FILES)
    out = drain_to_files(jobs.deduplicate(stream, "2 days"), x, "g2")
    return x.spark.read.schema(twice.schema).parquet(out).groupBy("service").agg(F.count(F.lit(1)).alias("rows"))


# One service is silent for more than a week.
SILENCE = "service = 'svc-1' AND epoch_ms({ts}) BETWEEN epoch_ms({first}) + 300 * 3600000 AND epoch_ms({first}) + 500 * 3600000"


def with_silence(sql: str) -> str:
    """The statement over metrics without the silent stretch."""
    body = f"metrics AS MATERIALIZED (\n{BLOCKS['metrics'][1]}\n)"
    silent = SILENCE.format(ts="ts", first="(SELECT min(ts) FROM rows_)")
    return sql.replace(body, f"rows_ AS MATERIALIZED (\n{BLOCKS['metrics'][1]}\n),\nmetrics AS MATERIALIZED (SELECT * FROM rows_ WHERE NOT ({silent}))")


@query(
    "g3_stream_features",
    with_silence(
        with_blocks(
            f"SELECT {ids()}, " + ", ".join(r(f'"{c}"', c) for c in FEATURES) + " FROM feat",
            "feat",
        )
    ),
)
def _(x: Tables):
    """All row-frame features micro-batch by micro-batch, over a series with a long gap. Rows arrive up to forty ticks late,
    which is more than a frame holds, and one in eight arrives twice."""
    first = x.metrics.agg(F.min("timestamp")).first()[0]
    hours = (F.unix_micros("timestamp") - F.unix_micros(F.lit(first))) / 3_600_000_000
    rows = x.metrics.where(~((F.col("service") == "svc-1") & hours.between(300, 500)))
    dice = F.pmod(F.xxhash64("service", "timestamp"), F.lit(64))
    late = F.when(dice == 0, 1).when(dice == 1, adapter.FEATURES.lookback - 1).when(dice == 2, 40).otherwise(0)
    rows = rows.withColumn("arrival", F.col("timestamp") + F.make_interval(hours=late))
    again = rows.where(dice >= 56).withColumn("arrival", F.col("arrival") + F.make_interval(hours=F.lit(100)))
    source = as_files(rows.unionByName(again), x, "g3_in", "arrival", parts=6)
    stream = jobs.stream_table(x.spark, source, x.metrics.schema, per_batch=FILES)
    out = fresh_folder(x.spark, "g3_out")
    jobs.features_in_batches(stream, fresh_folder(x.spark, "g3_store"), out, fresh_folder(x.spark, "g3_ck"), adapter.FEATURES).awaitTermination()
    return jobs.streamed_features(x.spark, out).select(*KEYS, *FEATURES)


def incident_events(x: Tables):
    """Starts and ends from a stream in which up to three hours late ticks arrive in later batches, and from what was
    still waiting when it stopped."""
    rows = x.metrics.select(*KEYS, "healthy", F.pmod(F.xxhash64("service", "timestamp"), F.lit(4)).cast("int").alias("late"))
    rows = rows.withColumn("arrival", F.col("timestamp") + F.make_interval(hours=F.col("late")))
    stream = jobs.stream_table(x.spark, as_files(rows, x, "g4_in", "arrival", 8), rows.schema, per_batch=FILES)
    out, check = fresh_folder(x.spark, "g4_out"), fresh_folder(x.spark, "g4_ck")
    with state_partitions(x.spark):
        writer = jobs.track_incidents(stream, adapter.HOUR, "4 hours").writeStream.format("parquet")
        writer = writer.option("path", out).option("checkpointLocation", check)
        writer.trigger(availableNow=True).start().awaitTermination()
    written = x.spark.read.schema(jobs.INCIDENT_EVENTS).parquet(out)
    return written.unionByName(jobs.flush_incidents(x.spark, check, adapter.HOUR))


@query(
    "g4_stream_incidents",
    with_blocks(f"SELECT service, {t('start_ts', 'start_ts')}, {t('end_ts', 'end_ts')} FROM incidents", "incidents"),
)
def _(x: Tables):
    """All incident windows, the open ones flushed."""
    return incident_events(x).where("event = 'end'").select("service", "start_ts", "end_ts")


@query(
    "s8_incident_events",
    with_blocks(
        f"SELECT service, 'start' AS event, {t('start_ts', 'event_ts')} FROM incidents UNION ALL SELECT service, 'end', {t('end_ts', 'event_ts')} FROM incidents",
        "incidents",
    ),
)
def _(x: Tables):
    """What a running collector reports: every start and every end."""
    return incident_events(x).select("service", "event", F.coalesce("end_ts", "start_ts").alias("event_ts"))


@query(
    "g7_stream_log_correlation",
    with_blocks(
        f"SELECT l.service, {t('i.start_ts', 'start_ts')}, count(*) AS lines FROM log l JOIN incidents i ON i.service = l.service AND l.ts >= i.start_ts AND l.ts <= i.end_ts "
        "WHERE l.level IN ('WARNING', 'ERROR') GROUP BY l.service, i.start_ts",
        "log",
        "incidents",
    ),
)
def _(x: Tables):
    """Every match of two streams, however long the incident."""
    logs = x.logs.select(*KEYS, "level", "message")
    windows = x.incidents.select("service", "start_ts", "end_ts")
    left = jobs.stream_table(x.spark, as_files(windows, x, "g7_i", "start_ts"), windows.schema, per_batch=FILES)
    right = jobs.stream_table(x.spark, as_files(logs, x, "g7_l"), logs.schema, per_batch=FILES)
    out = fresh_folder(x.spark, "g7_out")
    jobs.correlate_in_batches(left, right, fresh_folder(x.spark, "g7_store"), out, fresh_folder(x.spark, "g7_ck")).awaitTermination()
    found = x.spark.read.parquet(out).withColumnRenamed("incident_service", "service")
    return found.groupBy("service", "start_ts").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "g5_stream_risk",
    with_blocks(
        f"SELECT {ids()}, {r('(4e-1 * p_rows + 15e-2 * error_rate + 1e-1 * latency_trend + 1e-1 * memory_growth) / 75e-2', 'risk_score')} "
        "FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC) AS nr FROM comp) WHERE nr = 1",
        "comp",
    ),
)
def _(x: Tables):
    """Newest risk per service after the whole table has streamed by."""
    rows = x.probed.drop("healthy")
    stream = jobs.stream_table(x.spark, as_files(rows, x, "g5_in"), rows.schema, per_batch=2 * FILES)
    out = fresh_folder(x.spark, "g5_out")
    jobs.risk_in_batches(stream, x.reference, out, fresh_folder(x.spark, "g5_ck"), adapter.RISK, ["p_rows"]).awaitTermination()
    return latest_by_service(x.spark.read.parquet(out)).select(*KEYS, "risk_score")


@query("g6_stream_drift")
def _(x: Tables):
    """Drift summary of every micro-batch of the test split against the training split."""
    columns = ["Error_rate", "Latency_30t_avg", "Memory_growth_rate"]
    rows = x.part("test").select(*KEYS, *columns)
    stream = jobs.stream_table(x.spark, as_files(rows, x, "g6_in"), rows.schema, per_batch=2 * FILES)
    out = fresh_folder(x.spark, "g6_out")
    jobs.drift_in_batches(stream, x.part("train").select(*columns), columns, out, fresh_folder(x.spark, "g6_ck"), adapter.DRIFT).awaitTermination()
    return x.spark.read.parquet(out).select("epoch", "total_features", "drifted_features_count", "drift_share")


@query(
    "g8_late_rows",
    with_blocks("SELECT service, count(*) AS rows, count(*) FILTER (WHERE k >= 50) AS late FROM ev GROUP BY service", "ev"),
)
def _(x: Tables):
    """Events arriving k minutes after they happened, counted as late from 50 minutes on."""
    arrived = x.events.withColumn("arrival", F.col("timestamp") + F.make_interval(mins=F.col("k")))
    return jobs.late_rows(arrived, 50 * 60 - 1)


LATE_SLICES = 8


@query(
    "g8_stream_lateness",
    with_blocks(
        f"""SELECT service, count(*) AS rows, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE NOT late) AS kept FROM (
            SELECT e.service, coalesce(epoch_us(e.ts) <= w.latest - 20 * 3600000000, false) AS late FROM (
                SELECT *, least(((epoch_us(ts) + k * 3600000000 - lo) * {LATE_SLICES}) // (hi - lo), {LATE_SLICES} - 1) AS batch FROM ev,
                (SELECT min(epoch_us(ts) + k * 3600000000) AS lo, max(epoch_us(ts) + k * 3600000000) AS hi FROM ev)) e
            JOIN (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (
                SELECT least(((epoch_us(ts) + k * 3600000000 - lo) * {LATE_SLICES}) // (hi - lo), {LATE_SLICES} - 1) AS batch, max(epoch_us(ts)) AS latest FROM ev,
                (SELECT min(epoch_us(ts) + k * 3600000000) AS lo, max(epoch_us(ts) + k * 3600000000) AS hi FROM ev) GROUP BY 1)) w USING (batch))
        GROUP BY service""",
        "ev",
    ),
)
def _(x: Tables):
    """Events arriving k hours after they happened, in batches of arrival; rows the stream keeps and rows it takes out."""
    rows = x.events.withColumn("arrival", F.col("timestamp") + F.make_interval(hours=F.col("k"))).select(*KEYS, "arrival")
    stream = jobs.stream_table(x.spark, as_files(rows, x, "g8_in", "arrival", LATE_SLICES), rows.schema, per_batch=FILES)
    out, late = fresh_folder(x.spark, "g8_out"), fresh_folder(x.spark, "g8_late")
    jobs.split_late(stream, fresh_folder(x.spark, "g8_store"), out, late, fresh_folder(x.spark, "g8_ck"), 20 * 3600).awaitTermination()
    read = lambda path, name: x.spark.read.schema(rows.schema).parquet(path).groupBy("service").agg(F.count(F.lit(1)).alias(name))
    both = read(out, "kept").join(read(late, "late"), "service", "full")
    kept, gone = (F.coalesce(c, F.lit(0)) for c in ("kept", "late"))
    return both.select("service", (kept + gone).alias("rows"), gone.alias("late"), kept.alias("kept"))
