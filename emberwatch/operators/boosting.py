"""Boosted trees on histograms of pre-binned features.

A fit works on at most ``TRAINING_ROWS`` labelled rows, chosen by the hash of their keys, so that it fits one task; models
are what runs in parallel: every (draw, fold) of a search is a task of its own, over the same binned rows, whose size the
bound and one byte per value limit. Bins are computed once. Scoring reads all rows.

Trees grow level by level. A node's split has the greatest gain of second order (gradients and curvatures of the weighted
logistic loss, both penalties in the leaves); missing values, null or NaN, form a bin of their own that goes to the side
with more gain. Of equal gains the first feature, the lowest cut and missing to the right win.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING_ROWS = 50_000
BINS = 128  # of values; one more for missing ones
NODES = (
    "tree int, node int, feature int, cut double, missing_left boolean, left_node int, right_node int, value double, gain double"
)
COLUMNS = [c.split()[0] for c in NODES.split(", ")]


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: float = 3.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    seed: int = 42


# Search space of the boosted trees.
SPACE = {
    "rounds": [200, 300, 400, 500],
    "depth": [4, 5, 6, 7, 8],
    "rate": [0.01, 0.03, 0.05, 0.08, 0.1],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample": [0.7, 0.8, 0.9, 1.0],
    "min_child_weight": [1, 3, 5, 7],
    "reg_lambda": [0.5, 1.0, 2.0, 5.0],
    "reg_alpha": [0.0, 0.1, 0.5, 1.0],
}


def cut_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Ascending cuts between bins of one feature: between all distinct values, or at quantiles where these are too many."""
    distinct = np.unique(values[~np.isnan(values)])
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values[~np.isnan(values)], np.arange(1, bins) / bins, method="lower"))


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value; missing ones are in bin ``BINS``."""
    codes = np.empty(x.shape, np.uint8)
    for f, edges in enumerate(cuts):
        codes[:, f] = np.where(np.isnan(x[:, f]), BINS, np.searchsorted(edges, x[:, f], side="left"))
    return codes


def _best_splits(codes, at, g, h, nodes: int, used: np.ndarray, s: Settings):
    """Per node: totals, and gain, feature, bin and side of missing values of its best split."""
    width = BINS + 1
    flat = ((at[:, None] * len(used) + np.arange(len(used))) * width + codes[:, used]).ravel()
    shape = (nodes, len(used), width)
    sums = [np.bincount(flat, np.repeat(v, len(used)), nodes * len(used) * width).reshape(shape) for v in (g, h)]
    total = [v[:, 0, :].sum(axis=1) for v in sums]

    def score(a, b):
        return np.maximum(np.abs(a) - s.reg_alpha, 0.0) ** 2 / (b + s.reg_lambda)

    left = [np.cumsum(v[:, :, : BINS - 1], axis=2) for v in sums]
    left = [np.stack([low, low + v[:, :, BINS:]], axis=3) for low, v in zip(left, sums)]
    right = [t[:, None, None, None] - low for t, low in zip(total, left)]
    gain = score(*left) + score(*right) - score(*total)[:, None, None, None]
    gain[(left[1] < s.min_child_weight) | (right[1] < s.min_child_weight)] = -np.inf
    gain = np.round(gain.reshape(nodes, -1), 9)  # sums of one set of rows in another order are equal
    best = gain.argmax(axis=1)
    feature, cut, side = np.unravel_index(best, (len(used), BINS - 1, 2))
    return total, gain[np.arange(nodes), best], used[feature], cut, side == 1


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, s: Settings, rng: np.random.Generator) -> np.ndarray:
    """One tree as rows (feature, bin, missing_left, left, right, value, gain); leaves have feature -1."""
    features = codes.shape[1]
    used = np.sort(rng.permutation(features)[: max(1, round(features * s.colsample))])
    kept = np.flatnonzero(rng.random(len(g)) < s.subsample) if s.subsample < 1 else np.arange(len(g))
    rows = [[-1, 0, 0, -1, -1, 0.0, 0.0]]
    level, at = [0], np.zeros(len(kept), np.int64)  # nodes of this level, and each row's place among them
    for depth in range(s.depth + 1):
        if not level or not len(kept):
            break
        if depth == s.depth:
            total = [np.bincount(at, v[kept], len(level)) for v in (g, h)]
            gain = np.zeros(len(level))
        else:
            total, gain, feature, cut, side = _best_splits(codes[kept], at, g[kept], h[kept], len(level), used, s)
        leaf = -s.rate * np.sign(total[0]) * np.maximum(np.abs(total[0]) - s.reg_alpha, 0.0) / (total[1] + s.reg_lambda)
        split, below = gain > 1e-9, []
        first = np.zeros(len(level), np.int64)
        for k, node in enumerate(level):
            if split[k]:
                first[k] = len(below)
                rows[node][:] = [feature[k], cut[k], side[k], len(rows), len(rows) + 1, 0.0, gain[k]]
                below += [len(rows), len(rows) + 1]
                rows += [[-1, 0, 0, -1, -1, 0.0, 0.0], [-1, 0, 0, -1, -1, 0.0, 0.0]]
            else:
                rows[node][5] = leaf[k]
        if below:
            on = split[at]
            kept, at = kept[on], at[on]
            code = codes[kept, feature[at]]
            goes_left = np.where(code == BINS, side[at], code <= cut[at])
            at = first[at] + ~goes_left
        level = below
    return np.array(rows, float)


def _leaf_values(tree: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.zeros(len(codes), np.int64)
    feature, links = tree[:, 0].astype(np.int64), tree[:, 3:5].astype(np.int64)
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        here = at[inner]
        code = codes[inner, feature[here]]
        goes_left = np.where(code == BINS, tree[here, 2] == 1, code <= tree[here, 1])
        at[inner] = links[here, (~goes_left).astype(int)]
    return tree[at, 5]


def boost(codes: np.ndarray, y: np.ndarray, weight: np.ndarray, s: Settings) -> list[np.ndarray]:
    rng = np.random.default_rng(s.seed)
    margin, trees = np.zeros(len(y)), []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(grow(codes, weight * (p - y), weight * p * (1 - p), s, rng))
        margin += _leaf_values(trees[-1], codes)
    return trees


def area_under_roc(y: np.ndarray, score: np.ndarray) -> float:
    ranks, positive = pd.Series(score).rank().to_numpy(), y == 1
    n1, n0 = positive.sum(), (~positive).sum()
    return float((ranks[positive].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) if n1 and n0 else float("nan")


@dataclass
class Binned:
    """Training rows in bins; ``fold`` is -1 without folds."""

    codes: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    cuts: list[np.ndarray]
    features: list[str]

    def weights(self, chosen: np.ndarray) -> np.ndarray:
        """Positive rows weigh as much as negative ones together."""
        ones = max(int(self.y[chosen].sum()), 1)
        return np.where(self.y == 1, (int(chosen.sum()) - int(self.y[chosen].sum())) / ones, 1.0)


def bin_rows(rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], most: int = TRAINING_ROWS) -> Binned:
    """At most ``most`` labelled rows, those of smallest hash; ``rows`` may have a column ``fold``."""
    fold = F.col("fold") if "fold" in rows.columns else F.lit(-1)
    x = F.array(*[F.col(f).cast("double") for f in features])
    table = rows.where(F.col(label).isNotNull()).select(
        F.xxhash64(*keys).alias("h"), x.alias("x"), F.col(label).cast("int").alias("y"), fold.cast("int").alias("fold")
    )
    table = table.orderBy("h", "x", "y").limit(most).toPandas()
    values = np.array([[np.nan if v is None else v for v in row] for row in table["x"]], float).reshape(len(table), len(features))
    cuts = [cut_points(values[:, f]) for f in range(len(features))]
    return Binned(binned(values, cuts), table["y"].to_numpy(int), table["fold"].to_numpy(int), cuts, list(features))


def fold_scores(spark: SparkSession, data: Binned, settings: Sequence[Settings]) -> DataFrame:
    """``draw, fold, roc_auc`` of every draw on every fold, fitted on the other folds."""
    shared, folds = spark.sparkContext.broadcast(data), sorted(set(data.fold.tolist()))
    jobs = [(k, s, f) for k, s in enumerate(settings) for f in folds]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = shared.value
        for part in parts:
            for draw, s, fold in map(jobs.__getitem__, part["id"]):
                train = d.fold != fold
                trees = boost(d.codes[train], d.y[train], d.weights(train)[train], s)
                margin = sum((_leaf_values(t, d.codes[~train]) for t in trees), np.zeros((~train).sum()))
                auc = area_under_roc(d.y[~train], margin)
                yield pd.DataFrame({"draw": [draw], "fold": [fold], "roc_auc": [auc]})

    tasks = spark.range(0, len(jobs), 1, max(1, len(jobs)))  # one each
    return tasks.mapInPandas(run, "draw int, fold int, roc_auc double")


def fit(spark: SparkSession, data: Binned, settings: Settings) -> DataFrame:
    """Nodes of the trees fitted on all of ``data``; cuts are values of the features."""
    shared = spark.sparkContext.broadcast(data)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in parts:
            d = shared.value
            trees = boost(d.codes, d.y, d.weights(np.ones(len(d.y), bool)), settings)
            for number, t in enumerate(trees):
                f, b = t[:, 0].astype(int), t[:, 1].astype(int)
                # A cut behind the last one sends every value left.
                cut = [d.cuts[i][k] if i >= 0 and k < len(d.cuts[i]) else np.inf if i >= 0 else 0.0 for i, k in zip(f, b)]
                left, right = t[:, 3].astype(int), t[:, 4].astype(int)
                columns = [number, np.arange(len(t)), f, cut, t[:, 2] == 1, left, right, t[:, 5], t[:, 6]]
                yield pd.DataFrame(dict(zip(COLUMNS, columns)))

    return spark.range(0, 1, 1, 1).mapInPandas(run, NODES)


@dataclass
class BoostedTrees:
    """A fitted model: its nodes, of bounded number, and the features they number."""

    nodes: pd.DataFrame
    features: list[str]

    def predict(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Adds the probability of the positive class to all rows."""
        order = self.nodes.sort_values(["tree", "node"])
        size = order.groupby("tree", sort=True).size().to_numpy()
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        base = np.repeat(first, size)
        feature, cut, value = (order[c].to_numpy() for c in ("feature", "cut", "value"))
        missing = order["missing_left"].to_numpy(bool)
        left, right = order["left_node"].to_numpy() + base, order["right_node"].to_numpy() + base

        @F.pandas_udf("double")
        def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.array([[np.nan if v is None else v for v in row] for row in part], float).reshape(len(part), -1)
                margin = np.zeros(len(part))
                for root in first:
                    at = np.full(len(part), root)
                    while (inner := np.flatnonzero(feature[at] >= 0)).size:
                        here = at[inner]
                        v = x[inner, feature[here]]
                        goes_left = np.where(np.isnan(v), missing[here], v <= cut[here])
                        at[inner] = np.where(goes_left, left[here], right[here])
                    margin += value[at]
                yield pd.Series(1 / (1 + np.exp(-margin)))

        x = F.array(*[F.col(f).cast("double") for f in self.features])
        return df.withColumn(name, probability(x))

    def importance(self) -> list[float]:
        """Mean gain of each feature's splits, as a share of their sum."""
        inner = self.nodes[self.nodes["feature"] >= 0]
        mean = inner.groupby("feature")["gain"].mean().reindex(range(len(self.features)), fill_value=0.0)
        return (mean / (mean.sum() or 1.0)).tolist()


def fit_boosted(
    rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], params: dict | None = None
) -> BoostedTrees:
    data = bin_rows(rows, features, label, keys)
    return BoostedTrees(fit(rows.sparkSession, data, Settings(**(params or {}))).toPandas(), list(features))


def search(
    rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], combos: Sequence[dict]
) -> tuple[BoostedTrees, list[dict]]:
    """Best of ``combos`` by mean area under ROC over the folds of ``rows``, fitted on all of them, and all results."""
    spark = rows.sparkSession
    data = bin_rows(rows, features, label, keys)
    settings = [replace(Settings(), **c) for c in combos]
    found = fold_scores(spark, data, settings).groupBy("draw").agg(F.avg("roc_auc").alias("roc_auc")).collect()
    scores = {r["draw"]: r["roc_auc"] for r in found}
    results = [{**c, "draw": k, "roc_auc": scores[k]} for k, c in enumerate(combos)]
    best = max(range(len(combos)), key=lambda k: (scores[k] == scores[k], scores[k], -k))
    results[best]["chosen"] = True
    return BoostedTrees(fit(spark, data, settings[best]).toPandas(), list(features)), results
