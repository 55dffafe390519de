"""Reconstruction-error detectors: how badly does a linear bottleneck learnt on normal rows rebuild a row or a window?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.detectors import normal_rows
from emberwatch.operators.sequences import assemble_features, build_sequences, with_vector
from emberwatch.plans.durable import durable
from emberwatch.plans.quantiles import column_quantiles

NORMAL_LABELS = ("in_failure", "failure_in_next_10min")


@dataclass
class Bottleneck:
    model: PipelineModel
    size: int
    threshold: float = 0.0


def _fit(rows: DataFrame, size: int, k: int) -> Bottleneck:
    scaler = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True)
    pca = PCA(k=min(k, size), inputCol="z", outputCol="code")
    return Bottleneck(Pipeline(stages=[scaler, pca]).fit(rows), size)


def _error(df: DataFrame, net: Bottleneck, name: str) -> DataFrame:
    """Mean squared error of the rebuilt row. The components are orthonormal, so the squared error is what the code
    does not carry: ``(|z|^2 - |code|^2) / size``."""
    kept = [c for c in df.columns if c != "raw"]
    coded = net.model.transform(df)

    def square(column: str):
        return F.aggregate(vector_to_array(F.col(column)), F.lit(0.0), lambda acc, v: acc + v * v)

    error = F.greatest((square("z") - square("code")) / F.lit(float(net.size)), F.lit(0.0))
    return coded.select(*kept, error.alias(name))


def _threshold(scores: DataFrame, contamination: float) -> float:
    return column_quantiles(durable(scores.select("score"), "errors"), [], "score", {"t": 1.0 - contamination}).first()["t"]


def fit_rows(
    train: DataFrame,
    features: Sequence[str],
    normal_labels: Sequence[str] = NORMAL_LABELS,
    k: int = 8,
    contamination: float = 0.05,
) -> Bottleneck:
    normal = assemble_features(normal_rows(train, normal_labels), features, "raw")
    net = _fit(normal, len(features), k)
    net.threshold = _threshold(_error(normal, net, "score"), contamination)
    return net


def score_rows(df: DataFrame, net: Bottleneck, features: Sequence[str], name: str = "score") -> DataFrame:
    return _error(assemble_features(df, features, "raw"), net, name)


def fit_windows(
    train: DataFrame,
    features: Sequence[str],
    normal_labels: Sequence[str] = NORMAL_LABELS,
    seq_len: int = 20,
    k: int = 8,
    contamination: float = 0.05,
) -> Bottleneck:
    """Trained on windows that are normal throughout."""
    windows = build_sequences(train, features, normal_labels[0], seq_len, normal_labels=normal_labels)
    normal = with_vector(windows.where("all_normal"), name="raw").drop("window")
    net = _fit(normal, len(features) * seq_len, k)
    net.threshold = _threshold(_error(normal, net, "score"), contamination)
    return net


def score_windows(
    df: DataFrame, net: Bottleneck, features: Sequence[str], label: str, seq_len: int = 20, name: str = "score"
) -> DataFrame:
    """The error of a window belongs to its last row; rows before the first complete window get that window's error,
    services without one get 0."""
    windows = with_vector(build_sequences(df, features, label, seq_len), name="raw").drop("window")
    errors = _error(windows.select("timestamp", "service", "raw"), net, name)
    first = errors.groupBy("service").agg(F.min_by(name, "timestamp").alias("_first"))
    joined = df.join(errors, ["timestamp", "service"], "left").join(first, "service", "left")
    return joined.withColumn(name, F.coalesce(name, "_first", F.lit(0.0))).drop("_first")
