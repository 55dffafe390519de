"""Sliding windows of consecutive rows inside a service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.plans.blocks import AUTO, Layout, home_rows, series


def build_sequences(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    seq_len: int = 20,
    layout: Layout = AUTO,
    by: Sequence[str] = ("service",),
    normal_labels: Sequence[str] = (),
) -> DataFrame:
    """One row per complete window: time and service of its last row, the ``seq_len`` x features matrix flattened row by
    row as ``window``, the last row's label, and ``all_normal`` (every label in ``normal_labels`` 0 throughout).

    Windows never cross a service; services shorter than ``seq_len`` yield none.
    """
    extra = [c for c in dict.fromkeys([label, *normal_labels, *[b for b in by if b != "service"]]) if c in df.columns]
    base = df.select("timestamp", "service", *extra, F.array(*[F.col(f).cast("double") for f in features]).alias("_row"))
    rows, _, window = series(base, layout, seq_len - 1, by=by)
    frame = window.rowsBetween(-(seq_len - 1), 0)
    flags = [F.col(c) for c in normal_labels if c in df.columns]
    bad = F.greatest(*flags, F.lit(0)) if flags else F.lit(0)
    windows = rows.withColumn("_window", F.collect_list("_row").over(frame)).withColumn(
        "all_normal", F.max(bad).over(frame) == 0
    )
    complete = home_rows(windows).where(F.size("_window") == seq_len)
    return complete.select("timestamp", "service", *extra, F.flatten("_window").alias("window"), "all_normal")


def with_vector(df: DataFrame, source: str = "window", name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(source))


def assemble_features(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="keep").transform(df)


def window_counts(sequences: DataFrame, keys: Sequence[str] = ("service",)) -> DataFrame:
    return sequences.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"))
