"""Histogram boosting against a plain booster that tries every split, and the search over draws and folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.operators import boosting as bo
from emberwatch.operators import models
from tests.frames import series_frame

FEATURES = ["f1", "f2", "f3"]


def plain_boost(x, y, w, s):
    """Margins of ``s.rounds`` trees that try every cut between distinct values, missing values on either side."""
    margin = np.zeros(len(y))

    def soft(a):
        return np.sign(a) * max(abs(a) - s.reg_alpha, 0.0)

    def score(g, h):
        return soft(g) ** 2 / (h + s.reg_lambda)

    def grow(rows, depth, g, h, out):
        best = (1e-9, None)
        for f in range(x.shape[1]) if depth < s.depth else ():
            values = np.unique(x[rows, f][~np.isnan(x[rows, f])])
            for cut in (np.unique(x[:, f][~np.isnan(x[:, f])])[:-1] if len(values) else ()):
                for missing_left in (False, True):
                    left = np.where(np.isnan(x[rows, f]), missing_left, x[rows, f] <= cut)
                    a, b = rows[left], rows[~left]
                    if min(h[a].sum(), h[b].sum()) < s.min_child_weight:
                        continue
                    gain = round(score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[rows].sum(), h[rows].sum()), 9)
                    if gain > best[0]:
                        best = (gain, (a, b))
        if best[1] is None:
            out[rows] = -s.rate * soft(g[rows].sum()) / (h[rows].sum() + s.reg_lambda)
        else:
            for part in best[1]:
                grow(part, depth + 1, g, h, out)

    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0, w * (p - y), w * p * (1 - p), step)
        margin += step
    return margin


@pytest.mark.parametrize("alpha", [0.0, 0.5])
def test_equals_exact_splits(alpha):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(70, 3)), 1)
    x[rng.random(x.shape) < 0.15] = np.nan
    y = ((np.nan_to_num(x[:, 0]) + rng.normal(size=70) * 0.3 > 0.4) | np.isnan(x[:, 2])).astype(int)
    s = bo.Settings(rounds=8, depth=3, rate=0.3, subsample=1.0, colsample=1.0, min_child_weight=1, reg_alpha=alpha)
    cuts = [bo.cut_points(x[:, f]) for f in range(3)]
    codes, w = bo.binned(x, cuts), np.where(y == 1, 1.7, 1.0)
    trees = bo.boost(codes, y, w, s)
    got = sum(bo._leaf_values(t, codes) for t in trees)
    np.testing.assert_allclose(got, plain_boost(x, y, w, s), atol=1e-9)
    assert all(len(t) > 1 for t in trees)


def test_bins():
    assert bo.cut_points(np.array([3.0, 1.0, np.nan, 1.0])).tolist() == [2.0]
    many = bo.cut_points(np.arange(10_000.0))
    assert len(many) == bo.BINS - 1 and np.bincount(np.searchsorted(many, np.arange(10_000.0), side="left")).max() < 100
    codes = bo.binned(np.array([[0.5], [np.nan], [2.0], [9.0]]), [np.array([2.0])])
    assert codes.ravel().tolist() == [0, bo.BINS, 0, 1]
    assert bo.binned(np.array([[np.nan], [np.nan]]), [bo.cut_points(np.array([np.nan, np.nan]))]).ravel().tolist() == [bo.BINS] * 2


def test_area_under_roc():
    y, score = np.array([0, 1, 0, 1, 1]), np.array([0.1, 0.4, 0.4, 0.9, 0.2])
    pairs = [(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]]
    assert bo.area_under_roc(y, score) == pytest.approx(np.mean(pairs))
    assert np.isnan(bo.area_under_roc(np.ones(3, int), score[:3]))


def learnable(spark, ticks=200):
    df = series_frame(spark, ticks, seed=5)
    return df.withColumn("y", (F.col("f1") + F.rand(3) * 0.2 > 1.0).cast("int"))


def test_search_finds_the_best_draw(spark):
    df = learnable(spark)
    space = {"rounds": [1, 30], "depth": [1, 3], "rate": [0.3]}
    trained, results = models.tune(df, df, FEATURES, "y", space, trials=30)
    assert len(results) == 4 and sum("chosen" in r for r in results) == 1
    best = max(results, key=lambda r: (r["roc_auc"], -r["draw"]))
    assert best.get("chosen") and best["rounds"] == 30 and best["roc_auc"] > 0.95
    assert models.evaluate(trained, df, "y").first()["f1"] > 0.9
    assert [r["roc_auc"] for r in models.tune(df.repartition(7), df, FEATURES, "y", space)[1]] == [r["roc_auc"] for r in results]


def test_missing_values_and_empty_tables(spark):
    schema = "service string, timestamp timestamp, f1 double, f2 double, f3 double, y int"
    rows = [("a", None, None if i % 3 else float(i), float("nan"), 1.0, int(i % 3 > 0) if i else None) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    model = bo.fit_boosted(df, FEATURES, "y", ["f1"], {"rounds": 20, "depth": 2, "min_child_weight": 0.1})
    scored = model.predict(df).collect()
    assert all((r.probability > 0.5) == (r.f1 is None) for r in scored) and len(scored) == 40
    nothing = bo.fit_boosted(df.limit(0), FEATURES, "y", ["f1"], {"rounds": 3})
    assert {r.probability for r in nothing.predict(df).collect()} == {0.5}


def test_rows_of_a_fit_are_bounded_and_repeatable(spark):
    df = learnable(spark)
    a = bo.bin_rows(df, FEATURES, "y", models.KEYS, most=50)
    b = bo.bin_rows(df.repartition(9), FEATURES, "y", models.KEYS, most=50)
    assert a.codes.shape == (50, 3) and (a.codes == b.codes).all() and (a.y == b.y).all()
