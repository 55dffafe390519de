import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.config import EvidenceConfig, PolicyConfig, RecoveryConfig, RiskConfig, SeriesLayout
from emberwatch.operators import evidence as evd
from emberwatch.operators import quality as q
from emberwatch.operators import recovery as rec
from emberwatch.operators import registry as reg
from emberwatch.operators import remediation as rem
from emberwatch.operators import risk as rk
from emberwatch.operators import rootcause as rca
from emberwatch.operators.endtoend import fleet_report, fleet_summary, run
from emberwatch.operators.intervals import points_in_intervals
from emberwatch.schemas import INCIDENT_TABLE, LOG_TABLE
from tests.frames import START, metrics, series_frame, tick

# --- risk -------------------------------------------------------------------------------------------------------------


def ramp(spark, ticks=20, services=("a", "b")):
    rows = [(tick(i), s, 0.001 * i, 100.0 + i, 0.01 * i) for s in services for i in range(ticks)]
    return spark.createDataFrame(
        rows, "timestamp timestamp, service string, Error_rate double, Latency_15min_avg double, Memory_growth_rate double"
    )


def test_levels_include_their_cut(spark):
    df = spark.createDataFrame([(0.39,), (0.40,), (0.65,), (0.85,)], "s double")
    levels = [r[0] for r in df.select(rk.risk_level(F.col("s"), RiskConfig().cuts)).collect()]
    assert levels == ["NORMAL", "WARNING", "ANOMALOUS", "CRITICAL"]
    text = spark.range(1).select(rk.risk_text(F.lit(0.91), F.lit("CRITICAL"))).first()[0]
    assert text == "INCIDENT RISK 91% — CRITICAL"


def test_weights_are_scaled_to_what_is_there():
    weights = rk.effective_weights(RiskConfig(), ["failure_probability", "error_rate", "latency_trend", "memory_growth"])
    assert sum(weights.values()) == pytest.approx(1.0) and weights["failure_probability"] == pytest.approx(0.40 / 0.75)


def test_missing_component_leaves_the_mean(spark):
    df = spark.createDataFrame([(0.8, None), (None, None), (0.2, 0.6)], "a double, b double")
    scores = [r[0] for r in df.select(rk.fused({"a": 0.5, "b": 0.5})).collect()]
    assert scores == pytest.approx([0.8, 0.0, 0.4])


def test_scores_rise_with_the_signals(spark):
    df = ramp(spark)
    scored = rk.score_risk(df, rk.calibration(df))
    values = [r["risk_score"] for r in scored.where("service = 'a'").orderBy("timestamp").collect()]
    assert values == sorted(values) and values[-1] == 1.0 and scored.count() == 40
    newest = rk.latest_by_service(scored).collect()
    assert {r["service"] for r in newest} == {"a", "b"} and all(r["timestamp"] == tick(19) for r in newest)
    summary = rk.fleet_summary(rk.latest_by_service(scored)).first()
    assert (summary["services"], summary["flagged"], summary["as_of"]) == (2, 2, tick(19))


def test_trailing_window(spark):
    assert rk.trailing(ramp(spark), 2).count() == 10


# --- evidence and root cause ------------------------------------------------------------------------------------------


def jumpy(spark, ticks=80):
    rng = np.random.default_rng(2)
    rows = [
        (tick(i), "a", float(rng.normal(0.02, 0.001)) + (0.5 if i == 70 else 0.0), float(rng.normal(100, 5)), 0.0, 0.0)
        for i in range(ticks)
    ]
    return spark.createDataFrame(
        rows,
        "timestamp timestamp, service string, Error_rate double, Latency_15min_avg double, Memory_growth_rate double, flat double",
    )


NAMES = ["Error_rate", "Latency_15min_avg", "flat"]


def test_trailing_z_scores_and_deltas(spark):
    df = jumpy(spark)
    rows = {r["timestamp"]: r for r in evd.describe_ticks(df, NAMES).collect()}
    top = rows[tick(70)]["top_anomalous_features"][0]
    errors = [r["Error_rate"] for r in df.orderBy("timestamp").collect()]
    history = np.array(errors[11:70])
    assert top["feature"] == "Error_rate" and top["direction"] == "up"
    assert top["zscore"] == pytest.approx((errors[70] - history.mean()) / (history.std() + 1e-6), abs=0.01)
    assert rows[tick(8)]["top_anomalous_features"] == []
    assert rows[tick(70)]["metrics_deltas"]["Error_rate"] == pytest.approx((errors[70] - errors[51]) / errors[51] * 100, abs=0.06)
    assert rows[tick(70)]["metrics_deltas"]["Memory_growth_rate"] == 0.0 and rows[tick(18)]["metrics_deltas"] == {}
    blocked = {r["timestamp"]: r for r in evd.describe_ticks(df, NAMES, layout=SeriesLayout(600, 64)).collect()}
    assert blocked == rows


def log_rows(spark, *rows):
    return spark.createDataFrame([(t, s, level, m) for t, s, level, m in rows], LOG_TABLE)


def test_correlated_logs_take_the_last_serious_lines(spark):
    at = tick(70)
    rows = [(at - dt.timedelta(seconds=i), "a", "ERROR", f"m{i}") for i in range(1, 8)]
    rows += [(at, "a", "INFO", "noise"), (at, "b", "ERROR", "other"), (at + dt.timedelta(seconds=1), "a", "ERROR", "later")]
    rows += [(at - dt.timedelta(minutes=11), "a", "ERROR", "old")]
    flagged = jumpy(spark).where(F.col("timestamp") == F.lit(at))
    found = evd.correlated_logs(flagged, log_rows(spark, *rows)).first()["correlated_logs"]
    assert [e["message"] for e in found] == ["m1", "m2", "m3"]


def test_logs_before_a_tick_off_the_grid(spark):
    """Lines between the last border and the tick count, later ones in its interval do not crowd them out."""
    at = START + dt.timedelta(hours=10, seconds=75)
    rows = [(at - dt.timedelta(seconds=s), "a", "ERROR", f"m{s}") for s in (0, 5, 35, 599, 600, 601)]
    rows += [(at + dt.timedelta(seconds=s), "a", "ERROR", "after") for s in (1, 2, 3, 4)]
    ticks = spark.createDataFrame([(at, "a"), (at, "b")], "timestamp timestamp, service string")
    found = evd.correlated_logs(ticks, log_rows(spark, *rows), EvidenceConfig(log_limit=10)).collect()
    assert [(r["service"], [e["message"] for e in r["correlated_logs"]]) for r in found] == [("a", ["m0", "m5", "m35", "m599", "m600"])]
    few = evd.correlated_logs(ticks, log_rows(spark, *rows)).first()["correlated_logs"]
    assert [e["message"] for e in few] == ["m0", "m5", "m35"]


def test_log_correlation_makes_no_pairs(spark, many_slices):
    """Ticks and lines are sorted together and never joined; carries reach over empty slices, copies of lines count."""
    rng = np.random.default_rng(5)
    at = [START + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 1500, 400)]
    level = rng.choice(["ERROR", "WARNING", "INFO"], 400)
    rows = [(t, "ab"[i % 2], str(level[i]), None if i % 50 == 0 else f"m{i % 7}", i % 90) for i, t in enumerate(at)]
    rows += rows[:60] + [(START, "c", "ERROR", "lone", 1), (None, "a", "ERROR", "x", 2), (at[0], None, "ERROR", "x", 3)]
    logs = spark.createDataFrame(rows, "timestamp timestamp, service string, level string, message string, event_id long")
    asked = [(t, s) for t in at[::3] for s in "abcd"] + [(at[0], "a"), (None, "a"), (at[0], None)]
    ticks = spark.createDataFrame(asked, "timestamp timestamp, service string")
    found = evd.correlated_logs(ticks, logs)
    assert "Join" not in found._jdf.queryExecution().toString()
    expected = {}
    for t, s in {x for x in asked if None not in x}:
        seen = [r for r in rows if r[0] and r[1] == s and r[2] != "INFO" and t - dt.timedelta(minutes=10) <= r[0] <= t]
        best = sorted(seen, key=lambda r: (START - r[0], r[2], r[3] or "", r[4]))[:3]
        if best:
            expected[(t, s)] = sorted([(r[0], r[2], r[3]) for r in best], key=lambda r: (r[0], r[1], r[2] or ""), reverse=True)
    got = found.collect()
    assert len(got) == len(expected) and ("c" in {s for _, s in expected})
    assert {(r["timestamp"], r["service"]): [tuple(e) for e in r["correlated_logs"]] for r in got} == expected


def test_assembled_package(spark):
    df = jumpy(spark)
    scored = df.select("timestamp", "service").withColumns(
        {
            "risk_score": F.when(F.col("timestamp") == F.lit(tick(70)), 0.9).otherwise(0.1),
            "risk_level": F.lit("CRITICAL"),
            "failure_probability": F.lit(0.8),
            "error_rate": F.lit(0.9),
            "latency_trend": F.lit(0.1),
            "memory_growth": F.lit(0.1),
        }
    )
    logs = log_rows(spark, (tick(69), "a", "ERROR", "connection pool exhausted, jdbc acquire failed"))
    package = evd.assemble(df, scored, NAMES, logs)
    assert package.count() == 1
    row = rca.classify(package).first()
    assert row["root_cause_category"] == "connection_pool_exhaustion"
    assert row["recommended_actions"][:3] == [
        "Escalate to on-call: high failure probability detected",
        "Check downstream dependencies and circuit breakers",
        "Review recent deployments for regression",
    ]
    assert "Analyze Error_rate - correlate with upstream errors" in row["recommended_actions"]
    assert row["evidence"][0] == "component failure_probability = 0.800" and len(row["evidence"]) <= 8
    assert rca.prompts(package).first()["prompt"].endswith("}")
    assert rca.classify(package, "full_json").first()["root_cause_category"] != "unknown"
    bare = evd.assemble(df, scored, NAMES)
    assert bare.first()["correlated_logs"] == []


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("GC overhead, heap nearly full, OOM", "memory_leak"),
        ("Connection pool exhausted; JDBC acquire", "connection_pool_exhaustion"),
        ("p99 latency up, request timeout", "latency_spike"),
        ("host unreachable: connection refused, no route", "network_partition"),
        ("no space left on device /var", "disk_fill"),
        ("all good", "unknown"),
    ],
)
def test_keyword_categories(spark, text, category):
    row = rca.classify_text(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row["root_cause_category"] == category
    assert row["confidence_score"] == 0.3 if category == "unknown" else 0.3 < row["confidence_score"] <= 0.98


def test_answers_are_validated(spark):
    good = '```json\n{"probable_root_cause": "leak", "confidence_score": 0.7, "recommended_action": "restart", "root_cause_category": "memory_leak"}\n```'
    rows = [
        (1, good, ""),
        (2, good.replace("memory_leak", "gremlins"), ""),
        (3, good.replace("0.7", "1.7"), "disk full: no space left"),
        (4, "I do not know", "disk full: no space left"),
        (5, good.replace('"leak"', '" "'), ""),
        (6, '{"probable_root_cause": "x"}', ""),
    ]
    df = rca.parse_answers(spark.createDataFrame(rows, "id int, answer string, logs string"), "answer", "logs")
    got = {r["id"]: (r["status"], r["root_cause_category"], r["confidence_score"]) for r in df.collect()}
    assert got[1] == ("ok", "memory_leak", 0.7) and got[2] == ("ok", "unknown", 0.7)
    assert got[3][:2] == got[4][:2] == ("fallback_heuristic", "disk_fill")
    assert got[5][:2] == got[6][:2] == ("fallback_heuristic", "unknown")


# --- remediation ------------------------------------------------------------------------------------------------------


def diagnosis(spark, *categories):
    rows = [(f"s{i}", START, c, 2) for i, c in enumerate(categories)]
    return spark.createDataFrame(rows, "service string, timestamp timestamp, root_cause_category string, replicas int")


def test_plan_order_and_parameters(spark):
    plan = rem.build_plans(diagnosis(spark, "latency_spike"), replicas="replicas").orderBy("step").collect()
    assert [r["action"] for r in plan] == ["scale_replicas", "clear_cache", "create_incident_ticket"]
    assert plan[0]["params"] == {"service": "s0", "count": "4"}
    assert plan[2]["params"] == {"service": "s0", "category": "latency_spike", "summary": "[s0] latency spike detected"}
    leak = rem.build_plans(diagnosis(spark, "memory_leak")).orderBy("step").first()
    assert leak["params"] == {"container": "s0"} and leak["action_risk"] == "medium"
    assert [r["action"] for r in rem.build_plans(diagnosis(spark, "nonsense")).collect()] == ["create_incident_ticket"]


def test_policy_gates_and_cap(spark):
    plan = rem.build_plans(diagnosis(spark, "disk_fill"))
    by_action = {r["action"]: r for r in rem.decide_actions(plan, True).collect()}
    assert by_action["clear_cache"]["decision"] == "execute"
    assert "not in autonomous whitelist" in by_action["restart_container"]["reason"]
    open_policy = PolicyConfig(("clear_cache", "restart_container"), "low", 4)
    assert "exceeds autonomous limit" in {r["action"]: r["reason"] for r in rem.decide_actions(plan, True, open_policy).collect()}["restart_container"]
    wide = PolicyConfig(("clear_cache", "restart_container", "create_incident_ticket"), "high", 1)
    decisions = [r["decision"] for r in rem.decide_actions(plan, True, wide).orderBy("step").collect()]
    assert decisions == ["execute", "propose", "propose"]
    assert {r["decision"] for r in rem.decide_actions(plan, False).collect()} == {"propose"}


def test_modes_rollback_and_counts(spark):
    decided = rem.decide_actions(rem.build_plans(diagnosis(spark, "disk_fill")), True)
    statuses = lambda *a: [r["status"] for r in rem.planned_status(decided, *a).orderBy("step").collect()]
    assert statuses("advisory") == statuses("approval") == ["planned"] * 3
    assert statuses("approval", True) == ["execute"] * 3
    assert statuses("autonomous") == ["execute", "requires_approval", "requires_approval"]
    with pytest.raises(ValueError, match="unknown mode"):
        rem.planned_status(decided, "yolo")
    done = decided.withColumn("status", F.lit("ok"))
    rolled = {r["action"]: (r["rollback_status"], r["rollback_arguments"]) for r in rem.rollback_plan(done).collect()}
    assert rolled["clear_cache"] == ("rollback", {"service": "s0"})
    assert rolled["restart_container"] == ("rollback", {"container": "s0"})
    assert rolled["create_incident_ticket"][0] == "skipped"
    counts = rem.execution_counts(done).first()
    assert (counts["executed"], counts["pending"], counts["all_ok"]) == (3, 0, True)


def test_approvals_expire_and_are_taken_once(spark):
    plan = rem.build_plans(diagnosis(spark, "disk_fill", "memory_leak", "unknown"))
    created = rem.approval_requests(plan, F.col("timestamp"))
    again = rem.approval_requests(plan, F.col("timestamp"))
    assert {r["approval_id"] for r in created.collect()} == {r["approval_id"] for r in again.collect()}
    taken = created.where("service = 's1'").withColumn("event", F.lit("taken")).withColumn("event_ts", F.lit(tick(2)))
    events = created.unionByName(taken)
    pending = [r["service"] for r in rem.pending_approvals(events, F.lit(tick(10)), 60).collect()]
    assert sorted(pending) == ["s0", "s2"]
    assert rem.pending_approvals(events, F.lit(START + dt.timedelta(hours=2)), 60).count() == 0


# --- recovery ---------------------------------------------------------------------------------------------------------

WATCHED = ("Error_rate", "Latency_15min_avg", "Memory_growth_rate")


def readings(spark, service, start, *values):
    """One row every three minutes from minute ``start`` on."""
    rows = [(START + dt.timedelta(minutes=start + 3 * i), service, *v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "timestamp timestamp, service string, " + ", ".join(f"{m} double" for m in WATCHED))


def outcomes(before, after):
    checked = rec.check_metrics(rec.snapshot(before), rec.snapshot(after)).collect()
    return {(r["service"], r["metric"]): r["status"] for r in checked}


def test_each_metric_is_judged_by_limit_then_by_change(spark):
    before = readings(spark, "shop", 0, (0.3, 900.0, 0.2), (0.5, 700.0, 0.4))  # means 0.4, 800, 0.3
    after = readings(spark, "shop", 11, (0.02, 770.0, 0.31))
    assert outcomes(before, after) == {
        ("shop", "Error_rate"): "healthy",  # the limit itself is healthy
        ("shop", "Latency_15min_avg"): "unchanged",  # less than five percent better
        ("shop", "Memory_growth_rate"): "unchanged",
    }
    after = readings(spark, "shop", 11, (0.5, 750.0, 0.32))
    assert list(outcomes(before, after).values()).count("worsened") == 2
    assert outcomes(before, after)[("shop", "Latency_15min_avg")] == "improved"


def test_recovery_needs_every_metric_and_measures_time_between_medians(spark):
    ill = [(0.3, 900.0, 0.2), (0.5, 700.0, 0.4), (0.4, 800.0, 0.3)]
    before = readings(spark, "shop", 0, *ill).unionByName(readings(spark, "mail", 0, *ill))
    after = readings(spark, "shop", 30, (0.1, 280.0, 0.01), (0.1, 600.0, 0.02))
    after = after.unionByName(readings(spark, "mail", 0, (0.01, 1000.0, 0.0)))
    verdicts = {r["service"]: r for r in rec.verify(before, after, action="restart").collect()}
    shop, mail = verdicts["shop"], verdicts["mail"]
    assert (shop["status"], shop["checked"], shop["recovered_metrics"]) == ("SUCCESS", 3, 3)
    assert (shop["before_rows"], shop["after_rows"], shop["action"]) == (3, 2, "restart")
    assert shop["recovery_time_sec"] == pytest.approx((31.5 - 3) * 60)
    assert (mail["status"], mail["recovered_metrics"]) == ("FAILURE", 2)
    assert mail["recovery_time_sec"] == RecoveryConfig().cooldown_sec  # never less than the cool-down


def test_snapshot_is_a_mean_and_needs_a_metric(spark):
    rows = readings(spark, "shop", 0, (0.25, 1.0, 0.0), (0.5, 3.0, 0.0), (0.75, 8.0, 0.0))
    snap = rec.snapshot(rows).first()
    assert (snap["rows"], snap["Error_rate"], snap["Latency_15min_avg"]) == (3, 0.5, 4.0)
    with pytest.raises(ValueError, match="none of the configured metrics"):
        rec.snapshot(rows, RecoveryConfig(metrics=("nope",)))


def test_only_executed_services_are_verified(spark):
    rows = readings(spark, "shop", 0, (0.3, 900.0, 0.2))
    verdicts = rec.verify(rows, rows.unionByName(readings(spark, "mail", 0, (0.3, 900.0, 0.2))))
    counts = spark.createDataFrame([("shop", 0), ("mail", 4)], "service string, executed int")
    assert rec.gate_executed(verdicts, counts).count() == 0
    assert rec.gate_executed(verdicts, counts.withColumn("executed", F.lit(1))).count() == 1


# --- registry ---------------------------------------------------------------------------------------------------------


def experiments(spark, *rows):
    data = [(f"e{i}", f, m, v, ds, {"test": {"f1": f1}}, tick(i), st) for i, (f, m, v, ds, f1, st) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "experiment_id string, family string, model string, model_version int, dataset_version string, "
        "metrics map<string,map<string,double>>, trained_at timestamp, status string",
    )


def test_registry_queries(spark):
    df = experiments(
        spark,
        ("b", "lr", 1, "d1", 0.7, "ok"),
        ("b", "lr", 2, "d2", 0.9, "failed"),
        ("b", "rf", 1, "d1", 0.8, "ok"),
        ("b", "rf", 2, "d2", 0.8, "ok"),
    )
    assert {r["model"]: r["next_version"] for r in reg.next_version(df).collect()} == {"lr": 3, "rf": 3}
    assert {r["model"]: r["experiment_id"] for r in reg.best(df).collect()} == {"lr": "e0", "rf": "e2"}
    assert {r["model"]: r["experiment_id"] for r in reg.latest(df).collect()} == {"lr": "e1", "rf": "e3"}
    assert [r["model"] for r in reg.compare(df).collect()] == ["rf", "lr"]
    assert [r[0] for r in reg.models(df).collect()] == ["b/lr", "b/rf"]
    assert reg.get(df, "e3").first()["model_version"] == 2


def test_backfill_is_idempotent(spark):
    existing = experiments(spark, ("b", "lr", 4, "d1", 0.7, "ok"))
    wanted = experiments(spark, ("b", "lr", 0, "d1", 0.7, "ok"), ("b", "lr", 0, "d2", 0.7, "ok"), ("b", "rf", 0, "d2", 0.7, "ok"))
    added = reg.backfill(wanted, existing)
    assert {(r["model"], r["dataset_version"], r["model_version"]) for r in added.collect()} == {("lr", "d2", 5), ("rf", "d2", 1)}
    assert reg.backfill(wanted, existing.unionByName(added, allowMissingColumns=True)).count() == 0


def test_fingerprint_follows_content_not_order(spark):
    df = series_frame(spark, 20)
    version = lambda d: reg.dataset_version(d).first()["dataset_version"]
    assert version(df) == version(df.orderBy("f1")) != version(df.where("f1 > -100").limit(39))
    assert version(df).startswith("ds-") and len(version(df)) == 15


# --- quality ----------------------------------------------------------------------------------------------------------


def healthy_world(spark, **more):
    bad = range(20, 30)
    rates = {"http_4xx_rate": 0.01, "http_5xx_rate": 0.02}
    grid = metrics(spark, 60, change=lambda s, i: {"healthy": not (s == "a" and i in bad)} | rates | more)
    inc = spark.createDataFrame([(1, "a", "memory_leak", tick(20), tick(29))], INCIDENT_TABLE)
    logs = log_rows(spark, (tick(22), "a", "ERROR", "x"), (tick(1), "b", "INFO", "y"))
    return grid, logs, inc


def status_of(report) -> dict:
    return {r["name"]: r["status"] for r in report.collect()}


def test_clean_data_passes(spark):
    status = status_of(q.validate(*healthy_world(spark), 30))
    assert status["overall"] == "PASS" and len(status) >= 22
    assert status["per_service_failures"] == "INFO" and "FAIL" not in status.values()


def test_bad_data_is_named(spark):
    grid, logs, inc = healthy_world(spark, cpu_util_pct=150.0, latency_ms=float("nan"))
    grid = grid.where(~((F.col("service") == "b") & (F.col("timestamp") == F.lit(tick(5)))))
    logs = logs.unionByName(log_rows(spark, (tick(500), "a", "PANIC", "z")))
    extra = spark.createDataFrame([(2, "a", "disk_fill", tick(25), tick(24))], INCIDENT_TABLE)
    status = status_of(q.validate(grid, logs, inc.unionByName(extra), 30))
    for name in ("per_service_ticks", "timestamp_alignment", "missing_values", "metric_bounds", "log_levels", "incident_duration", "overall"):
        assert status[name] == "FAIL", name
    for name in ("uniform_spacing", "log_time_range", "incident_overlap"):
        assert status[name] == "WARN", name


def test_negative_values_break_the_lower_bound(spark):
    grid = metrics(spark, 5, ("a",), lambda s, i: {"latency_ms": -1.0})
    assert {r["metric"]: r["outside"] for r in q.out_of_bounds(grid).collect()}["latency_ms"] == 5


def test_recovery_window(spark):
    grid, _, inc = healthy_world(spark)
    late = spark.createDataFrame([(2, "a", "x", tick(40), tick(59)), (3, "a", "x", tick(10), tick(22))], INCIDENT_TABLE)
    got = {r["incident_id"]: r["recovered"] for r in q.recovery_after(grid, inc.unionByName(late)).collect()}
    assert got == {1: True, 2: None, 3: False}


def test_points_meet_intervals_once_across_buckets(spark):
    points = spark.createDataFrame([(tick(i), "a") for i in range(100)], "timestamp timestamp, service string")
    spans = spark.createDataFrame([(1, "a", tick(3), tick(90)), (2, "b", tick(3), tick(90))], "id int, service string, s timestamp, e timestamp")
    assert points_in_intervals(points, spans, ["service"], "s", "e", bucket_sec=60).count() == 87
    assert points_in_intervals(points, spans, ["service"], "s", "e", bucket_sec=60, closed=True).count() == 88


# --- the whole run ----------------------------------------------------------------------------------------------------


def test_end_to_end_isolates_the_sick_service(spark):
    quiet = ramp(spark, 60, ("b",)).withColumns({"Error_rate": F.lit(0.001), "Latency_15min_avg": F.lit(90.0), "Memory_growth_rate": F.lit(0.0)})
    noise = F.rand(1) * 1e-4
    train = quiet.withColumn("service", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumns(
        {c: F.col(c) + noise for c in ("Error_rate", "Latency_15min_avg", "Memory_growth_rate")}
    )
    ill = (F.col("service") == "a") & (F.col("timestamp") >= F.lit(tick(50)))
    now = train.withColumn("Error_rate", F.when(ill, 0.4).otherwise(F.lit(0.0))).withColumn(
        "Latency_15min_avg", F.when(ill, 900.0).otherwise(F.lit(80.0))
    ).withColumn("Memory_growth_rate", F.when(ill, 0.9).otherwise(F.lit(-1.0)))
    logs = log_rows(spark, (tick(55), "a", "ERROR", "heap full, gc thrashing, memory leak"))
    outcome = run(
        now, rk.calibration(train), ["Error_rate", "Latency_15min_avg", "Memory_growth_rate"], logs,
        evidence=EvidenceConfig(), after=train.withColumn("timestamp", F.col("timestamp") + F.expr("interval 1 hour")),
    )
    assert [r["service"] for r in outcome.evidence.collect()] == ["a"]
    assert outcome.diagnoses.first()["root_cause_category"] == "memory_leak"
    assert [r["action"] for r in outcome.actions.orderBy("step").collect()] == ["restart_container", "create_incident_ticket"]
    assert {r["status"] for r in outcome.actions.collect()} == {"planned"}
    report = {r["service"]: r for r in fleet_report(outcome).collect()}
    assert report["a"]["ok"] and report["a"]["recovery"] == "SUCCESS" and report["b"]["root_cause_category"] is None
    assert fleet_summary(fleet_report(outcome)).first()["flagged"] == 1
