import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberwatch.config import AnomalyConfig, SeriesLayout
from emberwatch.operators import detectors as d
from emberwatch.operators import forest, models, reconstruction
from emberwatch.operators.evaluation import ranking_metrics
from emberwatch.operators.sequences import build_sequences, window_counts
from tests.frames import series_frame, tick

FEATURES = ["f1", "f2", "f3"]
LABELS = ("in_failure", "failure_in_next_10min")


def planted(spark, ticks=120, at=60):
    df = series_frame(spark, ticks)
    hit = (F.col("service") == "a") & (F.col("timestamp") == F.lit(tick(at)))
    return df.withColumn("f2", F.when(hit, 500.0).otherwise(F.col("f2")))


def worst(df):
    row = df.orderBy(F.col("score").desc()).first()
    return row["service"], row["timestamp"]


def test_planted_outlier_ranks_first(spark):
    train, df = series_frame(spark, 120), planted(spark)
    assert worst(d.score_zscore(df, d.fit_zscore(train, FEATURES), FEATURES)) == ("a", tick(60))
    assert worst(d.score_iqr(df, d.fit_iqr(train, FEATURES), FEATURES)) == ("a", tick(60))
    assert worst(d.score_rolling_iqr(df, FEATURES)) == ("a", tick(60))


def test_rolling_iqr_blocks_equal_whole_series(spark):
    df = planted(spark, 150)
    config = AnomalyConfig(rolling_iqr_window_min=10)
    plain = d.score_rolling_iqr(df, FEATURES, config).orderBy("service", "timestamp").toPandas()
    blocked = d.score_rolling_iqr(df, FEATURES, config, SeriesLayout(600, 30)).orderBy("service", "timestamp").toPandas()
    pd.testing.assert_frame_equal(plain, blocked)
    values = plain[plain.service == "a"]["f2"].to_numpy()
    q1, q3 = np.quantile(values[81:101], [0.25, 0.75])
    expected = max(max(q1 - values[100], values[100] - q3, 0) / (q3 - q1) for _ in [0])
    assert plain[plain.service == "a"]["score"].to_numpy()[100] >= expected - 1e-9


def test_unknown_service_uses_overall_statistics(spark):
    train = series_frame(spark, 60)
    other = series_frame(spark, 20, ("new",), seed=1)
    for fit, score in ((d.fit_zscore, d.score_zscore), (d.fit_iqr, d.score_iqr)):
        assert score(other, fit(train, FEATURES), FEATURES).where("score is null").count() == 0


def test_severity_and_legacy_levels(spark):
    df = spark.createDataFrame([(0.1,), (0.55,), (0.97,), (0.999,)], "s double")
    cuts = {"median": 0.5, "threshold": 0.95, "upper": 0.975, "warning": 0.5, "anomalous": 0.9, "critical": 0.98}
    legacy = [r[0] for r in df.select(d.legacy_level(F.col("s"), cuts)).collect()]
    assert legacy == ["NORMAL", "WARNING", "ANOMALOUS", "CRITICAL"]
    exact = spark.createDataFrame([(0.5,)], "s double").select(d.severity(F.col("s"), cuts)).first()[0]
    assert exact == "NORMAL"


def test_cuts_increase_strictly(spark):
    flat = spark.createDataFrame([("m", 1.0)] * 20, "model string, score double")
    row = d.calibrate(flat).first()
    assert row["warning"] < row["anomalous"] < row["critical"]


def test_suite_flags_the_outlier(spark):
    train = series_frame(spark, 150, in_failure=lambda i: 0, failure_in_next_10min=lambda i: 0)
    suite = d.fit_suite(train, FEATURES, AnomalyConfig(rolling_iqr_window_min=15))
    scored = d.score_suite(planted(spark), suite)
    row = scored.where((F.col("service") == "a") & (F.col("timestamp") == F.lit(tick(60)))).first()
    assert row["anomaly"] == 1 and row["anomaly_level"] == "CRITICAL"
    assert scored.where("anomaly = 1").count() < 60


def test_rank_fusion_weights(spark):
    train = spark.createDataFrame([(float(i), float(i)) for i in range(1, 11)], "a_score double, b_score double")
    row = spark.createDataFrame([(tick(0), "s", 5.0, 10.0)], "timestamp timestamp, service string, a_score double, b_score double")
    fused = d.fuse_mean_rank(row, train, ["a", "b"], {"a": 3.0, "b": 1.0}).first()["ensemble_score"]
    assert fused == pytest.approx((3 * 0.5 + 1.0) / 4)


def test_normal_rows(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1)], "in_failure int, failure_in_next_10min int")
    assert d.normal_rows(df, LABELS).count() == 1 and d.normal_rows(df.drop("in_failure"), LABELS).count() == 2


def test_sequences_do_not_cross_services(spark):
    df = series_frame(spark, 30, ("a", "b"), y=lambda i: int(i >= 20)).unionByName(series_frame(spark, 12, ("c",), y=lambda i: 0))
    short = series_frame(spark, 3, ("d",), y=lambda i: 0)
    windows = build_sequences(df.unionByName(short), FEATURES, "y", 5)
    counts = {r["service"]: r["windows"] for r in window_counts(windows).collect()}
    assert counts == {"a": 26, "b": 26, "c": 8}
    last = windows.where("service = 'a'").orderBy("timestamp").collect()
    assert [r["y"] for r in last] == [0] * 16 + [1] * 10 and len(last[0]["window"]) == 15
    values = df.where("service = 'a'").orderBy("timestamp").select(*FEATURES).collect()
    assert last[0]["window"][:3] == list(values[0]) and last[0]["window"][-3:] == list(values[4])
    blocked = build_sequences(df, FEATURES, "y", 5, SeriesLayout(300, 10)).orderBy("service", "timestamp").collect()
    assert blocked == build_sequences(df, FEATURES, "y", 5).orderBy("service", "timestamp").collect()


def test_isolation_forest(spark):
    trees = forest.fit_forest(planted(spark), FEATURES, trees=30)
    scored = forest.score_forest(planted(spark), trees, FEATURES)
    assert worst(scored) == ("a", tick(60))
    assert scored.where("score <= 0 or score >= 1").count() == 0 and scored.count() == 240
    stranger = forest.score_forest(series_frame(spark, 20, ("new",)), trees, FEATURES)
    assert stranger.where("score is null").count() == 0
    split = forest.score_forest(planted(spark), trees, FEATURES, chunk=25).orderBy("service", "timestamp").select("score")
    whole = scored.orderBy("service", "timestamp").select("score")
    assert [r[0] for r in split.collect()] == pytest.approx([r[0] for r in whole.collect()])


def test_forest_samples_are_bounded_and_repeatable(spark):
    big = spark.range(60_000).select(
        F.lit("hot").alias("service"), F.col("id").cast("timestamp").alias("timestamp"), F.rand(1).alias("f1")
    )
    args = (["f1"], 20, 64, 7, ("timestamp", "service"))
    sizes = forest.sample_rows(big, *args).groupBy("service", "tree").count().collect()
    assert len(sizes) == 40 and {r["count"] for r in sizes} == {64}
    again = [sorted(r["x"][0] for r in forest.sample_rows(big, *args).where("tree = 3 and service = 'hot'").collect()) for _ in "ab"]
    assert again[0] == again[1]


def test_reconstruction_error(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 2))
    rows = [(tick(i), "a", float(b[0]), float(b[1]), float(b[0] + b[1]), 0, 0) for i, b in enumerate(base)]
    schema = "timestamp timestamp, service string, f1 double, f2 double, f3 double, in_failure int, failure_in_next_10min int"
    train = spark.createDataFrame(rows, schema)
    net = reconstruction.fit_rows(train, FEATURES, LABELS, k=2)
    odd = spark.createDataFrame([(tick(999), "a", 1.0, 1.0, -6.0, 0, 0)], schema)
    scored = reconstruction.score_rows(train.unionByName(odd), net, FEATURES)
    assert worst(scored) == ("a", tick(999)) and net.threshold < 1e-9


def test_sequence_reconstruction_warm_up(spark):
    df = series_frame(spark, 60, in_failure=lambda i: int(i == 30), failure_in_next_10min=lambda i: 0)
    net = reconstruction.fit_windows(df, FEATURES, LABELS, seq_len=5, k=4)
    scored = reconstruction.score_windows(df, net, FEATURES, "in_failure", 5).where("service = 'a'").orderBy("timestamp")
    scores = [r["score"] for r in scored.collect()]
    assert scores[:4] == [scores[4]] * 4 and len(set(scores[4:])) > 10
    lonely = reconstruction.score_windows(series_frame(spark, 3, in_failure=lambda i: 0), net, FEATURES, "in_failure", 5)
    assert {r["score"] for r in lonely.collect()} == {0.0}


def learnable(spark, ticks=300):
    df = series_frame(spark, ticks, seed=5)
    return df.withColumn("y", (F.col("f1") + F.rand(3) * 0.2 > 1.0).cast("int"))


@pytest.mark.parametrize(
    ("name", "params"),
    [("logistic_regression", {}), ("random_forest", {"numTrees": 10, "maxDepth": 4}), ("gradient_boosting", {"maxIter": 5, "maxDepth": 3}), ("histogram_boosting", {"rounds": 40, "depth": 3})],
)
def test_classifiers_learn_and_persist(spark, tmp_path, name, params):
    df = learnable(spark)
    trained = models.train(df, df, FEATURES, "y", name, params)
    metrics = models.evaluate(trained, df, "y").first()
    assert metrics["roc_auc"] > 0.9 and 0.0 <= metrics["f1"] <= 1.0 and metrics["f1"] > 0.8
    assert models.importance(trained, spark).first()["feature"] == "f1"
    models.save(trained, str(tmp_path / "m"), spark)
    again = models.load(str(tmp_path / "m"), spark)
    assert again.threshold == trained.threshold
    assert models.evaluate(again, df, "y").first() == metrics


def test_missing_features_take_the_training_mean(spark):
    """A missing value spoils neither the fit nor the scores of other rows."""
    df = learnable(spark).withColumn("f2", F.when(F.col("f2") > 12, None).when(F.col("f2") > 11.5, float("nan")).otherwise(F.col("f2")))
    df = df.withColumn("f3", F.lit(None).cast("double"))
    trained = models.train(df, df, FEATURES, "y", "logistic_regression")
    assert models.evaluate(trained, df, "y").first()["roc_auc"] > 0.9
    scores = [r.probability for r in models.predict(trained.model, df).collect()]
    assert len(scores) == df.count() and all(0 <= s <= 1 for s in scores)


def test_folds_are_stratified(spark):
    folds = models.stratified_folds(learnable(spark), "y", 3, ["service", "timestamp"])
    rates = [r["r"] for r in folds.groupBy("fold").agg(F.avg("y").alias("r")).collect()]
    assert len(rates) == 3 and max(rates) - min(rates) < 0.01


def test_draws_are_distinct_and_repeatable():
    a = models.draws(models.SPACE, 30)
    assert a == models.draws(models.SPACE, 30) and len({tuple(c.items()) for c in a}) == 30
    assert len(models.draws({"x": [1, 2]}, 30)) == 2


def test_sequence_classifier_and_length_choice(spark):
    df = learnable(spark, 200)
    best, seq_len, results = models.tune_sequences(df, df, FEATURES, "y", [2, 4])
    assert seq_len in (2, 4) and len(results) == 2
    scored = models.predict_sequences(best, df, "y", seq_len)
    assert scored.count() == 2 * (200 - seq_len + 1)
    assert ranking_metrics(scored.withColumn("k", F.lit(1)), "y", "probability", ["k"]).first()["roc_auc"] > 0.9


@pytest.mark.parametrize(("name", "called"), [("d12_gradient_boosting", "train"), ("d13_randomised_search", "tune")])
def test_boosting_is_registered_with_the_operators_defaults(monkeypatch, name, called):
    """Neither fewer rounds nor fewer draws: what is not given takes its default."""
    from types import SimpleNamespace

    from emberwatch.queries.base import REGISTRY
    from emberwatch.queries.detection import FEATURES as columns

    calls = []

    def record(*args, **named):
        calls.append((args, named))
        raise InterruptedError

    monkeypatch.setattr(models, called, record)
    import emberwatch.queries.detection as registered

    with pytest.raises(InterruptedError):
        REGISTRY[name].build(SimpleNamespace(part=lambda p: p, split="split", spark=None))
    given = ("train", "val", columns, registered.LABEL)
    assert calls == [((*given, "histogram_boosting", None) if called == "train" else given, {})]


def test_boosting_names_a_checkpoint_folder(spark):
    models.name_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir().startswith(("file:" + spark.conf.get("spark.checkpoint.dir")))
