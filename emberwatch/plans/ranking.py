"""Order statistics without a single-task sort.

``running_totals`` is the one primitive: rows are first combined per distinct value, then range-partitioned by value so
that each task owns one contiguous slice, and per-slice totals supply the offset of every slice. Percentile ranks, ROC / PR
curves, the two-sample KS statistic and the last step of exact quantiles all read from its output. A value shared by a third of
all rows is a single row here, and a key holding a third of all rows spans many slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.plans.durable import durable


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, bool]:
    """Range-partition by keys and order, remembering the slice of every row; also tells whether one slice holds all.

    Spark merges small partitions, so a small table ends up in one file and needs no offsets between slices.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    slices = durable(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    return slices, len(slices.inputFiles()) <= 1


def _by(keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """One row per (keys, value) with, for each weight ``w``: its sum ``w``, inclusive running sum ``cum_w`` in value
    order (NULL is the least value) and key total ``total_w``."""
    keys = list(keys)
    direction = F.col(value).desc() if descending else F.col(value).asc()
    combined = df.groupBy(*keys, value).agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    slices, single = _sliced(combined, keys, [direction])
    if single:
        upto = _by(keys).orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
        return slices.select(
            *keys,
            value,
            *weights,
            *[F.sum(n).over(upto).alias(f"cum_{n}") for n in weights],
            *[F.sum(n).over(_by(keys)).alias(f"total_{n}") for n in weights],
        )

    totals = slices.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(f"_in_{n}") for n in weights])
    whole = _by(keys)
    earlier = whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in weights],
        *[F.sum(f"_in_{n}").over(whole).alias(f"total_{n}") for n in weights],
    )
    local = W.partitionBy(*keys, "_slice").orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    return slices.join(offsets, [*keys, "_slice"]).select(
        *keys,
        value,
        *weights,
        *[(F.col(f"_before_{n}") + F.sum(n).over(local)).alias(f"cum_{n}") for n in weights],
        *[f"total_{n}" for n in weights],
    )


def rank_value(value: str, rank: Column, count: str = "n") -> Column:
    """Aggregate: the value holding 0-based ``rank`` in a ``running_totals`` frame."""
    cum = F.col(f"cum_{count}")
    return F.max(F.when((cum > rank) & (cum - F.col(count) <= rank), F.col(value)))


def quantile_columns(value: str, probs: dict[str, float], count: str = "n") -> list[Column]:
    """Aggregates giving linearly interpolated quantiles from a ``running_totals`` frame."""
    columns = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col(f"total_{count}") - 1)
        low = rank_value(value, F.floor(position), count)
        high = rank_value(value, F.ceil(position), count)
        share = F.max(position - F.floor(position))
        columns.append((low + (high - low) * share).alias(name))
    return columns


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with exact quantiles; linear interpolation between closest ranks. Suits values that repeat, which are
    combined first; ``plans/quantiles.py`` does not sort values that do not."""
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    totals = running_totals(clean, keys, value, {"n": F.lit(1)})
    return totals.groupBy(*keys).agg(*quantile_columns(value, probs))


def percentile_ranks(rows: DataFrame, reference: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``percentile`` = share of the key's reference values that are <= the row's value (NULL without one)."""
    keys = list(keys)
    both = reference.select(*keys, value, F.lit(1).alias("_ref")).unionByName(
        rows.select(*keys, value, F.lit(0).alias("_ref"))
    )
    clean = both.where(F.col(value).isNotNull() & ~F.isnan(value))
    totals = running_totals(clean, keys, value, {"ref": F.col("_ref")})
    ranks = totals.select(*keys, value, F.expr("cum_ref / nullif(total_ref, 0)").alias("percentile"))
    return rows.join(ranks, [*keys, value], "left")


def numbered(df: DataFrame, order: Sequence[str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds a 1-based position over the whole table (or per key) in ``order``, which must be a total order."""
    keys = list(keys)
    slices, single = _sliced(df, keys, [F.col(c) for c in order])
    if single:
        return slices.withColumn(name, F.row_number().over(_by(keys).orderBy(*order)).cast("long")).drop("_slice")
    totals = slices.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = _by(keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = W.partitionBy(*keys, "_slice").orderBy(*order)
    joined = slices.join(offsets, [*keys, "_slice"])
    return joined.withColumn(name, F.col("_before") + F.row_number().over(local)).drop("_slice", "_before")
