"""Order statistics, metrics and drift against brute force."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberwatch.config import DriftConfig
from emberwatch.operators import drift as dr
from emberwatch.operators import evaluation as ev
from emberwatch.operators.quality import correlated_incidents
from emberwatch.operators.registry import content_hash, dataset_version, merge_content
from emberwatch.plans.asof import counts_up_to
from emberwatch.plans.quantiles import column_quantiles, merged, quantiles, sketches
from emberwatch.plans.ranking import exact_quantiles, numbered, percentile_ranks, running_totals
from tests.frames import tick

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = st.lists(st.integers(-5, 5).map(lambda v: v / 2), min_size=3, max_size=40)


def column(spark, values, key="k"):
    return spark.createDataFrame([(key, float(v)) for v in values], "k string, v double")


@FEW
@given(VALUES)
def test_quantiles_equal_numpy(spark, many_slices, values):
    row = exact_quantiles(column(spark, values), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.9])))


def numbers(spark):
    """Two keys and NULL, 12,000 rows: spread values, a value of a third of all rows, gaps and an empty column."""
    nr = F.col("id")
    key = F.when(nr % 7 == 0, "b").when(nr % 1000 != 1, "a")
    hot = F.when(nr % 3 == 0, 5.0).when(nr % 11 == 0, F.lit(float("nan"))).when(nr % 13 != 0, (nr * 37 % 997) / 8)
    return spark.range(12_000).select(
        key.alias("k"), (nr * 7919 % 12_007).alias("spread"), hot.alias("hot"), F.lit(None).cast("double").alias("void")
    )


PROBS = {"least": 0.0, "q1": 0.25, "mid": 0.5, "high": 0.975, "most": 1.0}


def by_hand(rows, key, column):
    values = [r[column] for r in rows if key in (..., r["k"]) and r[column] is not None and not math.isnan(r[column])]
    return pytest.approx(list(np.quantile(values, list(PROBS.values()))))


@pytest.mark.parametrize("margin, size", [(0.01, 1000), (0.0, 8)])
def test_bracketed_quantiles_equal_numpy(spark, many_slices, margin, size):
    """Also when poor sketches without margin miss: those keys are ranked over all values."""
    df, columns = numbers(spark), ["spread", "hot", "void"]
    rows = df.collect()
    sketched = sketches(df.where("k is not null"), ["k"], columns, size)
    found = quantiles(df, ["k"], columns, PROBS, sketched, margin).collect()
    assert sorted((r["k"], r["feature"]) for r in found) == [(k, c) for k in "ab" for c in ("hot", "spread")]
    for r in found:
        assert [r[name] for name in PROBS] == by_hand(rows, r["k"], r["feature"])
    everywhere = quantiles(df, [], columns, PROBS, merged(sketches(df, ["k"], columns, size), columns), margin).collect()
    assert sorted(r["feature"] for r in everywhere) == ["hot", "spread"]
    for r in everywhere:
        assert [r[name] for name in PROBS] == by_hand(rows, ..., r["feature"])


def test_quantiles_without_values(spark):
    empty = numbers(spark).limit(0)
    assert quantiles(empty, ["k"], ["spread", "hot"], PROBS).collect() == []
    assert column_quantiles(empty, [], "hot", {"mid": 0.5}).collect() == [(None,)]


@FEW
@given(VALUES, VALUES)
def test_percentile_ranks_equal_searchsorted(spark, many_slices, reference, queries):
    ranked = percentile_ranks(column(spark, queries), column(spark, reference), ["k"], "v").collect()
    expected = np.searchsorted(np.sort(reference), queries, side="right") / len(reference)
    assert sorted((r["v"], round(r["percentile"], 9)) for r in ranked) == sorted(
        zip(map(float, queries), [round(e, 9) for e in expected], strict=True)
    )


def test_percentile_without_reference_is_null(spark):
    empty = column(spark, []).limit(0)
    assert percentile_ranks(column(spark, [1.0]), empty, ["k"], "v").first()["percentile"] is None


def test_slices_carry_totals_across_a_hot_value(spark, many_slices):
    """A third of the rows share one value; running sums still cover every row once."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("v"), F.lit("hot").alias("k")
    )
    totals = running_totals(df, ["k"], "v", {"n": F.lit(1)}).orderBy("v").collect()
    assert totals[-1]["cum_n"] == 9000 == totals[0]["total_n"]
    running = 0
    for row in totals:
        running += row["n"]
        assert row["cum_n"] == running


def test_numbering(spark, many_slices):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    rows = numbered(df, ["x"], "nr").orderBy("x").collect()
    assert [r["nr"] for r in rows] == list(range(1, 501))


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    return float(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def brute_ap(y, s):
    if y.min() == y.max():
        return None
    total, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        flag = s >= t
        recall = y[flag].sum() / y.sum()
        total += (recall - before) * y[flag].mean()
        before = recall
    return total


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=40))
def test_ranking_metrics(spark, many_slices, pairs):
    df = spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, s double")
    y, s = np.array([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs])
    row = ev.ranking_metrics(df.withColumn("k", F.lit(1)), "y", "s", ["k"]).first()
    for got, want in ((row["roc_auc"], brute_auc(y, s)), (row["pr_auc"], brute_ap(y, s))):
        assert got is None if want is None else got == pytest.approx(want)


def test_best_threshold_prefers_the_lowest(spark):
    rows = [(0, 0.1), (1, 0.4), (0, 0.5), (1, 0.8), (1, 0.9)]
    df = spark.createDataFrame(rows, "y int, s double")
    row = ev.best_threshold(df, "y", "s").first()
    f1 = {t: 2 * sum(y for y, s in rows if s >= t) / (3 + sum(s >= t for _, s in rows)) for _, t in rows}
    assert row["threshold"] == min(t for t in f1 if math.isclose(f1[t], max(f1.values())))


def test_binary_metrics_and_zero_division(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (1, 0), (0, 0)], "y int, p int")
    row = ev.binary_metrics(df, "y", "p").first()
    assert (row["precision"], row["recall"], round(row["f1"], 4), row["accuracy"]) == (1.0, 0.75, 0.8571, 0.8)
    none = ev.binary_metrics(df.withColumn("p", F.lit(0)), "y", "p").first()
    assert none["precision"] == none["recall"] == none["f1"] == 0.0


def test_decisions_at_the_threshold(spark):
    df = spark.createDataFrame([(0.5,)], "s double")
    row = df.select(ev.decide("s", F.lit(0.5), False).alias("a"), ev.decide("s", F.lit(0.5), True).alias("b")).first()
    assert (row["a"], row["b"]) == (0, 1)


def brute_psi(ref, tgt, bins=10, eps=1e-4):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, bins + 1)))
    edges[0], edges[-1] = -np.inf, np.inf
    k = len(edges) - 1
    p = (np.histogram(ref, edges)[0] + eps) / (len(ref) + eps * k)
    q = (np.histogram(tgt, edges)[0] + eps) / (len(tgt) + eps * k)
    return max(0.0, float(np.sum((q - p) * np.log(q / p))))


def brute_ks(a, b):
    points = np.unique(np.concatenate([a, b]))
    return float(np.max(np.abs(
        np.searchsorted(np.sort(a), points, side="right") / len(a) - np.searchsorted(np.sort(b), points, side="right") / len(b)
    )))


def drift_of(spark, **columns):
    """columns: name -> (reference values, target values)"""
    ref = spark.createDataFrame(list(zip(*[[float(v) for v in c[0]] for c in columns.values()], strict=True)), list(columns))
    tgt = spark.createDataFrame(list(zip(*[[float(v) for v in c[1]] for c in columns.values()], strict=True)), list(columns))
    return {r["feature"]: r for r in dr.feature_drift(ref, tgt).collect()}, ref, tgt


def test_drift_against_numpy(spark, many_slices):
    rng = np.random.default_rng(3)
    n = 600
    same, base = rng.normal(0, 1, n), rng.normal(0, 1, n)
    steps = rng.integers(0, 4, n)
    cases = {
        "same": (same, same),
        "shifted": (base, rng.normal(1.5, 1, n)),
        "steps": (steps, np.clip(steps + rng.integers(0, 2, n), 0, 4)),
        "flat": (np.full(n, 5.0), np.full(n, 5.0)),
        "moved_flat": (np.full(n, 5.0), np.full(n, 9.0)),
    }
    got, ref, tgt = drift_of(spark, **cases)
    for name in ("same", "shifted", "steps"):
        assert got[name]["psi"] == pytest.approx(brute_psi(*cases[name]))
        assert got[name]["ks_statistic"] == pytest.approx(brute_ks(*cases[name]))
        assert got[name]["ref_std"] == pytest.approx(np.std(cases[name][0]))
    assert got["same"]["psi"] < 0.01 and got["shifted"]["psi"] > 0.25
    assert got["same"]["ks_pvalue"] == 1.0 and got["shifted"]["ks_pvalue"] < 0.001
    assert (got["flat"]["psi"], got["flat"]["ks_statistic"], got["flat"]["ks_pvalue"]) == (0.0, 0.0, 1.0)
    assert (got["moved_flat"]["psi"], got["moved_flat"]["ks_statistic"], got["moved_flat"]["ks_pvalue"]) == (1.0, 1.0, 0.0)
    summary = dr.dataset_drift(dr.feature_drift(ref, tgt)).first()
    assert summary["drifted_features_count"] == 2 + (got["steps"]["drift_level"] == "significant")
    assert summary["dataset_drift"] and "shifted" in summary["drifted_features"]


def test_drift_ignores_missing_values(spark):
    got, _, _ = drift_of(spark, x=([1.0, 2.0, 3.0, float("nan")], [1.0, float("nan"), 2.0, 3.0]))
    assert got["x"]["psi"] < 0.01 and got["x"]["ref_mean"] == 2.0


def test_comparable_columns_leave_out_flags_and_labels(spark):
    df = spark.createDataFrame([(1.0, True, 1, 2)], "f double, healthy boolean, in_failure int, failure_in_next_10min int")
    assert dr.comparable_columns(df, df) == ["f"]


def labelled(spark, tp, fp, fn, tn):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
    return spark.createDataFrame(rows, "y int, p int")


def test_performance_verdicts(spark):
    assert dr.performance(labelled(spark, 3, 0, 1, 4), "y", "p").first()["status"] == "insufficient_data"
    good = labelled(spark, 30, 0, 10, 40)
    ok = dr.performance(good, "y", "p", 0.86).first()
    assert (ok["status"], ok["f1"], ok["f1_drop"]) == ("ok", 0.8571, 0.0029)
    assert dr.performance(labelled(spark, 10, 30, 30, 30), "y", "p").first()["status"] == "degraded"
    assert dr.performance(good, "y", "p", 1.01).first()["degraded"]


def decision(spark, levels: dict, perf):
    df = spark.createDataFrame(list(levels.items()), "feature string, drift_level string")
    return dr.retraining(df, perf, DriftConfig()).first()


def test_retraining_reasons(spark):
    fine = dr.performance(labelled(spark, 30, 0, 10, 40), "y", "p", 0.86)
    poor = dr.performance(labelled(spark, 10, 30, 30, 30), "y", "p", 0.86)
    quiet = {"a": "none", "b": "none", "c": "moderate", "Error_rate": "none"}
    calm = decision(spark, quiet, fine)
    assert not calm["retraining_required"] and calm["severity"] == "normal" and len(calm["recommendations"]) == 1
    critical = decision(spark, quiet | {"Error_rate": "significant"}, fine)
    assert critical["severity"] == "warning" and critical["critical_drifted"] == ["Error_rate"]
    wide = decision(spark, {"a": "significant", "b": "significant", "c": "none"}, fine)
    assert wide["trigger_reasons"] == [
        "Dataset drift threshold breached: 2/3 features (66.7%) exhibit significant drift (threshold: 30%)."
    ]
    worst = decision(spark, quiet, poor)
    assert worst["severity"] == "critical" and "dropped by" in worst["trigger_reasons"][0]


def test_drift_report_without_predictions(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=100)], "f double")
    report = dr.drift_report(df, df)
    assert report["performance"].first()["status"] == "insufficient_data"
    assert not report["retraining"].first()["retraining_required"]


def test_level_distribution_lists_every_level(spark):
    df = spark.createDataFrame([("NORMAL",), ("CRITICAL",), ("NORMAL",)], "level string")
    rows = {r["level"]: (r["count"], r["share"]) for r in ev.level_distribution(df, "level").collect()}
    assert rows == {"NORMAL": (2, 0.6667), "WARNING": (0, 0.0), "ANOMALOUS": (0, 0.0), "CRITICAL": (1, 0.3333)}


def test_class_weights(spark):
    row = ev.class_weights(spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int"), "y").first()
    assert (row["positive_weight"], row["balanced_0"], row["balanced_1"]) == (3.0, 8 / 12, 2.0)


def test_counts_up_to_equal_counting(spark, many_slices):
    rng = np.random.default_rng(3)
    keys, times = ["a", "b", None], [tick(int(k)) for k in rng.integers(0, 40, 120)]
    points = [(keys[k % 3 if k % 7 else 0], times[k]) for k in range(120)]
    asked = [(k, keys[k % 2], times[(k * 7) % 120] if k % 9 else None, bool(k % 4 < 2)) for k in range(100)] + [(100, "c", tick(3), True)]
    p = spark.createDataFrame(points, "service string, at timestamp")
    q = spark.createDataFrame(asked, "id int, service string, at timestamp, inclusive boolean")
    for by in (["service"], []):
        got = {r.id: r.n_before for r in counts_up_to(p, q, by).collect()}
        same = lambda a, b: a == b or not by
        want = {
            i: sum(same(s, service) and (t < at or (t == at and upto)) for s, t in points) for i, service, at, upto in asked if at is not None
        }
        assert got == want
    assert counts_up_to(p.limit(0), q, ["service"]).agg({"n_before": "max"}).first()[0] == 0
    assert counts_up_to(p, q.limit(0), []).count() == 0


def test_log_correlation_counts_borders_and_open_incidents(spark):
    logs = spark.createDataFrame([(tick(5), "a", "ERROR"), (tick(9), "a", "INFO"), (tick(20), "b", "WARNING")], "timestamp timestamp, service string, level string")
    rows = [(1, "a", tick(5), tick(6)), (2, "a", tick(3), tick(5)), (3, "a", tick(6), tick(30)), (4, "b", tick(0), None), (5, "b", tick(6), tick(30))]
    incidents = spark.createDataFrame(rows, "incident_id int, service string, start_ts timestamp, end_ts timestamp")
    ids = lambda df: sorted(r.incident_id for r in df.collect())
    assert ids(correlated_incidents(logs, incidents)) == [1, 2, 5] and ids(correlated_incidents(logs, incidents, False)) == [1, 2, 3, 5]
    plan = correlated_incidents(logs, incidents, False)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_content_hash_adds_up(spark):
    rows = [("a", k * 0.1, None if k % 3 else k, tick(k)) for k in range(50)] + [("b", float("nan"), 1, None), (None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "s string, v double, n int, t timestamp")
    whole = content_hash(df).first()
    assert content_hash(df.repartition(7)).first() == whole and whole.rows == 54
    parts = content_hash(df.where("n is null")).unionByName(content_hash(df.where("n is not null")))
    assert merge_content(parts).first() == whole
    signed = content_hash(df).withColumn("sign", F.lit(1)).unionByName(content_hash(df.where("s = 'b'")).withColumn("sign", F.lit(-1)))
    assert merge_content(signed).first() == content_hash(df.where("s is distinct from 'b'")).first()
    assert content_hash(df.dropDuplicates()).first() != whole and content_hash(df.limit(0)).first().rows == 0
    swapped = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    one, two = (dataset_version(swapped.where(w)).first()[0] for w in ("x = 'ab'", "x = 'a'"))
    assert one != two
