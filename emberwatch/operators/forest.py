"""Isolation forest.

Every (service, tree) draws a fixed-size sample by hash rank, trees grow in parallel on those samples only, and rows
are scored batch by batch against the trees of their service.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.plans.durable import durable

EVERYONE = "*"  # service name of the forest over all services
NODES = (
    "service string, tree int, node int, feature int, cut double, left_node int, right_node int, depth double, rows int"
)


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree over ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def sample_rows(
    train: DataFrame, features: Sequence[str], trees: int, sample: int, seed: int, ids: Sequence[str]
) -> DataFrame:
    """(service, tree, rank, x): at most ``sample`` rows per service and tree, and the same over all services.

    The rows with the smallest hashes are a uniform sample without replacement, the same on every run. In a large
    service each row is offered to one tree only and most rows are turned away by their hash before anything is
    shuffled; in a small one each row is offered to as many trees as are needed to fill every sample.
    """
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    rows = train.select("service", F.xxhash64(F.lit(seed), *ids).alias("_key"), x.alias("x"))
    both = rows.withColumn("service", F.explode(F.array("service", F.lit(EVERYONE))))
    # a written table, so Spark broadcasts it only when its measured size allows
    sizes = durable(both.groupBy("service").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    wanted = F.lit(float(4 * sample * trees)) / F.col("_n")
    share = F.pmod(F.col("_key"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    offers = F.least(F.greatest(F.ceil(wanted), F.lit(1)), F.lit(trees)).cast("int")
    first = F.pmod(F.shiftright("_key", 20), F.lit(trees)).cast("int")
    offered = (
        both.join(sizes, "service")
        .where(share <= wanted)
        .withColumn("_offer", F.explode(F.sequence(F.lit(0), offers - 1)))
        .withColumn("tree", F.pmod(first + F.col("_offer"), F.lit(trees)))
        .withColumn("_h", F.xxhash64("tree", "_key"))
    )
    rank = F.row_number().over(W.partitionBy("service", "tree").orderBy("_h", "_key"))
    return offered.withColumn("rank", rank).where(F.col("rank") <= sample).select("service", "tree", "rank", "x")


def grow(group: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One tree over a sample of at most a few hundred rows."""
    service, tree = group["service"].iloc[0], int(group["tree"].iloc[0])
    x = np.stack(group.sort_values("rank")["x"].to_numpy())
    rng = np.random.default_rng([seed, tree, sum(map(ord, service))])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo: list[tuple] = [(x, 0, None)]  # rows, depth, (parent node, column of its child link)
    while todo:
        rows, depth, parent = todo.pop(0)
        number = len(nodes)
        if parent is not None:
            nodes[parent[0]][parent[1]] = number
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append([service, tree, number, -1, 0.0, -1, -1, depth + average_path(len(rows)), len(x)])
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        if cut <= low[feature]:  # neighbouring floats: keep both sides non-empty
            cut = float(high[feature])
        nodes.append([service, tree, number, feature, cut, -1, -1, 0.0, len(x)])
        goes_left = rows[:, feature] < cut
        todo += [(rows[goes_left], depth + 1, (number, 5)), (rows[~goes_left], depth + 1, (number, 6))]
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODES.split(", ")])


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    trees: int = 200,
    sample: int = 256,
    seed: int = 42,
    ids: Sequence[str] = ("timestamp", "service"),
) -> DataFrame:
    """The forest as a table of nodes: ``trees`` per service and over all services, each of at most 2 x sample nodes."""
    samples = sample_rows(train, features, trees, sample, seed, ids)
    # the samples are small but growing trees is work: spread it over all cores whatever the number of bytes
    samples = samples.repartition(train.sparkSession.sparkContext.defaultParallelism, "service", "tree")
    return durable(samples.groupBy("service", "tree").applyInPandas(lambda g: grow(g, seed), NODES), "forest")


def _depths(nodes: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    """Path length of every row of ``x`` through one tree."""
    order = nodes.sort_values("node")
    feature, cut = order["feature"].to_numpy(), order["cut"].to_numpy()
    left, right = order["left_node"].to_numpy(), order["right_node"].to_numpy()
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return order["depth"].to_numpy()[at]
        rows = np.flatnonzero(inner)
        here = at[rows]
        goes_left = x[rows, feature[here]] < cut[here]
        at[rows] = np.where(goes_left, left[here], right[here])


def score_forest(
    df: DataFrame, forest: DataFrame, features: Sequence[str], name: str = "score", chunk: int = 200_000
) -> DataFrame:
    """Adds the anomaly score ``2 ** (-mean depth / expected depth)``; services without trees use those over all.

    Rows are co-grouped with their trees by (service, chunk), so a large service is scored by many tasks and each task
    holds the trees of one service only. No broadcast grows with the number of services.
    """
    kept = df.columns
    known = forest.select("service").distinct().withColumn("_known", F.lit(True))
    sizes = df.groupBy("service").agg(F.count(F.lit(1)).alias("_n"))
    parts = durable(
        sizes.join(known, "service", "left").select(
            "service",
            F.when(F.col("_known"), F.col("service")).otherwise(EVERYONE).alias("_model"),
            F.ceil(F.col("_n") / chunk).cast("int").alias("_parts"),
        ),
        "parts",
    )
    rows = df.join(parts.select("service", "_parts"), "service").withColumn("_part", F.pmod(F.xxhash64(*kept), F.col("_parts")).cast("int"))
    wanted = parts.select(
        "service", "_model", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part")
    )
    trees = wanted.join(forest.withColumnRenamed("service", "_model"), "_model")
    columns = list(features)
    schema = df.select(*kept).schema.add(name, "double")

    def score(part: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(part[columns].to_numpy(dtype="float64"))
        total, count = np.zeros(len(part)), 0
        for _, tree in nodes.groupby("tree"):
            total += _depths(tree, x)
            count += 1
        expected = max(average_path(nodes["rows"].max()), 1e-9) if count else 1.0
        return part[kept].assign(**{name: 2.0 ** (-(total / max(count, 1)) / expected)})

    return rows.groupBy("service", "_part").cogroup(trees.groupBy("service", "_part")).applyInPandas(score, schema)
