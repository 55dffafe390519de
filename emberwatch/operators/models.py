"""Failure classifiers on ``pyspark.ml``: training with class weights, tuning, scoring, persistence."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.columns import null_if_nan
from emberwatch.operators.boosting import NODES, SPACE, BoostedTrees, fit_boosted, search
from emberwatch.operators.evaluation import best_threshold, class_weights, evaluate_at
from emberwatch.operators.sequences import build_sequences, with_vector
from emberwatch.plans.durable import shared_folder
from emberwatch.plans.ranking import numbered

SEED = 42
KEYS = ["service", "timestamp"]

@dataclass
class Trained:
    name: str
    model: PipelineModel | BoostedTrees
    features: list[str]
    threshold: float


def weighted(df: DataFrame, label: str, balanced: bool) -> tuple[DataFrame, dict]:
    """Adds ``weight`` per row from the class counts (balanced, or only the positive class raised to n0/n1)."""
    w = class_weights(df, label).first().asDict()
    positive = w["balanced_1"] if balanced else w["positive_weight"]
    negative = w["balanced_0"] if balanced else 1.0
    return df.withColumn("weight", F.when(F.col(label) == 1, float(positive)).otherwise(float(negative))), w


def total_weight(rows: DataFrame) -> float:
    return rows.agg(F.sum("weight")).first()[0] or 1.0


def classifier(name: str, label: str, total: float, params: dict | None = None):
    """Estimator by name; the ``total`` weight of the rows scales the regularisation of the logistic model to C = 1."""
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    if name == "logistic_regression":
        settings = {"regParam": 1.0 / max(total, 1.0), "maxIter": 1000, "standardization": False, **(params or {})}
        return LogisticRegression(**common, **settings)
    if name == "random_forest":
        settings = {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 4, "seed": SEED, **(params or {})}
        return RandomForestClassifier(**common, **settings)
    if name == "gradient_boosting":
        settings = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": SEED, **(params or {})}
        return GBTClassifier(**common, **settings)
    raise ValueError(f"unknown model: {name}")


def name_checkpoints(spark: SparkSession) -> None:
    """Boosting writes its predictions every ten rounds, and so survives lost executors, if the context names a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def train(
    train_rows: DataFrame,
    val_rows: DataFrame,
    features: Sequence[str],
    label: str,
    name: str = "logistic_regression",
    params: dict | None = None,
) -> Trained:
    """Fit on the training rows and pick the F1-optimal threshold on the validation rows.

    ``histogram_boosting`` is fitted on a bounded choice of rows (see ``boosting``), all others on every row.
    """
    if name == "histogram_boosting":
        return with_threshold(name, fit_boosted(train_rows, features, label, KEYS, params), val_rows, features, label)
    if name == "gradient_boosting":
        name_checkpoints(train_rows.sparkSession)
    rows, _ = weighted(train_rows, label, balanced=name != "gradient_boosting")
    stages = [*filled(rows, features), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]
    model = Pipeline(stages=[*stages, classifier(name, label, total_weight(rows), params)]).fit(rows)
    return with_threshold(name, model, val_rows, features, label)


def filled(rows: DataFrame, features: Sequence[str]) -> list:
    """Stages that put the features into the vector ``raw``, missing ones (null or NaN) as the mean of the training rows, or
    as 0 where no training row has a value."""
    known = rows.agg(*[F.count(null_if_nan(F.col(f).cast("double"))).alias(f) for f in features]).first()
    some = [f for f in features if known[f]]
    imputer = Imputer(inputCols=some, outputCols=[f"{f}__filled" for f in some], strategy="mean")
    none = [f"CAST(0 AS DOUBLE) AS {f}__filled" for f in features if not known[f]]
    zeros = [SQLTransformer(statement=f"SELECT *, {', '.join(none)} FROM __THIS__")] if none else []
    return [*([imputer] if some else []), *zeros, VectorAssembler(inputCols=[f"{f}__filled" for f in features], outputCol="raw")]


def with_threshold(name: str, model, val_rows: DataFrame, features: Sequence[str], label: str) -> Trained:
    threshold = best_threshold(predict(model, val_rows), label, "probability").first()["threshold"]
    return Trained(name, model, list(features), float(threshold))


def predict(model: PipelineModel | BoostedTrees, df: DataFrame, name: str = "probability") -> DataFrame:
    """Rows with the probability of the positive class in ``name``."""
    if isinstance(model, BoostedTrees):
        return model.predict(df, name)
    kept = df.columns
    scored = model.transform(df)
    return scored.select(*kept, vector_to_array(F.col("probability"))[1].alias(name))


def evaluate(trained: Trained, df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return evaluate_at(predict(trained.model, df), label, "probability", trained.threshold, keys)


def importance(trained: Trained, spark: SparkSession) -> DataFrame:
    """Features ranked by absolute coefficient or impurity decrease; one row per feature of the model."""
    if isinstance(trained.model, BoostedTrees):
        values = trained.model.importance()
    else:
        last = trained.model.stages[-1]
        values = (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()
    rows = list(zip(trained.features, [float(v) for v in values], strict=True))
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.abs("importance").desc(), "feature")


def stratified_folds(df: DataFrame, label: str, folds: int, ids: Sequence[str]) -> DataFrame:
    """Adds ``fold``: the rows of each class dealt evenly to the folds in hash order, without sorting a class in one
    task."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(SEED), *ids))
    dealt = numbered(hashed, ["_h", *ids], "_nr", [label])
    return dealt.withColumn("fold", F.pmod("_nr", F.lit(folds)).cast("int")).drop("_h", "_nr")


def draws(space: dict[str, list], n: int, seed: int = SEED) -> list[dict]:
    """``n`` distinct random combinations of the search space."""
    rng = random.Random(seed)
    seen: dict[tuple, dict] = {}
    size = 1
    for values in space.values():
        size *= len(values)
    while len(seen) < min(n, size):
        combo = {k: rng.choice(v) for k, v in space.items()}
        seen[tuple(combo.values())] = combo
    return list(seen.values())


def tune(
    train_rows: DataFrame,
    val_rows: DataFrame,
    features: Sequence[str],
    label: str,
    space: dict[str, list] | None = None,
    trials: int = 30,
    folds: int = 3,
) -> tuple[Trained, list[dict]]:
    """Randomised search for the boosted trees by cross-validated ROC-AUC on stratified folds.

    The results have a row per draw: its settings, ``draw``, mean ``roc_auc``, and ``chosen`` for the best.
    """
    rows = stratified_folds(train_rows, label, folds, KEYS)
    model, results = search(rows, features, label, KEYS, draws(space or SPACE, trials))
    return with_threshold("histogram_boosting", model, val_rows, features, label), results


def train_sequences(
    train_rows: DataFrame,
    val_rows: DataFrame,
    features: Sequence[str],
    label: str,
    seq_len: int = 20,
    params: dict | None = None,
) -> Trained:
    """Classifier over flattened windows of the last ``seq_len`` rows; the recurrent net's place is taken by a linear
    model on the same windows."""
    windows = with_vector(build_sequences(train_rows, features, label, seq_len), name="raw")
    rows, _ = weighted(windows, label, balanced=False)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    settings = {"maxIter": 100, **(params or {})}
    model = Pipeline(stages=[scaler, classifier("logistic_regression", label, total_weight(rows), settings)]).fit(rows)
    val = with_vector(build_sequences(val_rows, features, label, seq_len), name="raw")
    threshold = best_threshold(predict(model, val), label, "probability").first()["threshold"]
    return Trained("sequence_classifier", model, list(features), float(threshold))


def predict_sequences(trained: Trained, df: DataFrame, label: str, seq_len: int, by=("service",)) -> DataFrame:
    """(timestamp, service, label, probability) for every row with a complete window."""
    windows = with_vector(build_sequences(df, trained.features, label, seq_len, by=by), name="raw")
    return predict(trained.model, windows).drop("raw", "window", "all_normal")


def tune_sequences(
    train_rows: DataFrame, val_rows: DataFrame, features: Sequence[str], label: str, lengths: Sequence[int]
) -> tuple[Trained, int, list[dict]]:
    """Window length with the best validation F1."""
    results, best = [], None
    for seq_len in lengths:  # a handful of configured lengths
        trained = train_sequences(train_rows, val_rows, features, label, seq_len)
        scored = predict_sequences(trained, val_rows, label, seq_len)
        f1 = evaluate_at(scored, label, "probability", trained.threshold).first()["f1"]
        results.append({"seq_len": seq_len, "val_f1": f1, "threshold": trained.threshold})
        if best is None or f1 > best[0]:
            best = (f1, trained, seq_len)
    return best[1], best[2], results


def save(trained: Trained, path: str, spark: SparkSession) -> None:
    """Model under ``path/model``, name, threshold and feature columns as a one-row table under ``path/meta``."""
    if isinstance(trained.model, BoostedTrees):
        spark.createDataFrame(trained.model.nodes, NODES).write.mode("overwrite").parquet(f"{path}/model")
    else:
        trained.model.write().overwrite().save(f"{path}/model")
    meta = spark.createDataFrame(
        [(trained.name, trained.threshold, trained.features)], "name string, threshold double, features array<string>"
    )
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load(path: str, spark: SparkSession) -> Trained:
    meta = spark.read.parquet(f"{path}/meta").first()
    features = list(meta["features"])
    if meta["name"] == "histogram_boosting":
        model = BoostedTrees(spark.read.parquet(f"{path}/model").toPandas(), features)
    else:
        model = PipelineModel.load(f"{path}/model")
    return Trained(meta["name"], model, features, meta["threshold"])
