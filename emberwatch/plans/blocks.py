"""Row-frame windows over series of any length.

A window partitioned by service alone puts a whole service into one task. So the rows of each service are numbered
without a per-service sort (slices of time that hold about equally many rows of the table, plus offsets) and cut into
blocks of consecutive rows. Each block also receives the few neighbouring rows its frames can see, so every frame is complete and results
equal those of the plain window; the borrowed rows are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.config import SeriesLayout
from emberwatch.plans.slices import borders, slice_of

# A layout cuts every service into blocks, at every size; None states that each service fits one task.
Layout = SeriesLayout | None
AUTO = SeriesLayout()


def bucket_of(layout: SeriesLayout, timestamp: str = "timestamp") -> Column:
    return F.floor(F.unix_micros(F.col(timestamp)) / F.lit(layout.bucket_sec * 1_000_000)).cast("long")


def index_rows(
    df: DataFrame, layout: SeriesLayout, order: Sequence[str] = ("timestamp",), by: Sequence[str] = ("service",)
) -> DataFrame:
    """Adds ``_idx``, the 0-based position of each row inside its series."""
    keys = [*by, "_bucket"]
    time = F.unix_micros(F.col("timestamp"))
    rows = df.withColumn("_bucket", slice_of(time, borders(df, time)))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = W.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, keys)
        .withColumn("_idx", F.col("_before") + F.col("_local"))
        .drop("_bucket", "_before", "_local")
    )


def cut_blocks(indexed: DataFrame, layout: SeriesLayout, lookback: int, lookahead: int = 0) -> DataFrame:
    """Assigns rows with ``_idx`` to blocks; ``_home`` is true in the block that owns the row."""
    size = layout.block_rows
    if max(lookback, lookahead) > size:
        raise ValueError("block_rows must be at least as long as the longest frame")
    own = F.floor(F.col("_idx") / size)
    place = F.col("_idx") % size
    copies = F.array(
        own,
        F.when(place >= size - lookback, own + 1),
        F.when((place < lookahead) & (own > 0), own - 1),
    )
    return (
        indexed.withColumn("_own", own)
        .withColumn("_block", F.explode(F.array_compact(copies)))
        .withColumn("_home", F.col("_block") == F.col("_own"))
        .drop("_own", "_idx")
    )


def series(
    df: DataFrame,
    layout: Layout,
    lookback: int,
    lookahead: int = 0,
    order: Sequence[str] = ("timestamp",),
    by: Sequence[str] = ("service",),
) -> tuple[DataFrame, list[str], WindowSpec]:
    """The frame, its grouping columns and the window to compute row frames on; finish with ``home_rows``."""
    if layout is None:
        return df, list(by), W.partitionBy(*by).orderBy(*order)
    cut = cut_blocks(index_rows(df, layout, order, by), layout, lookback, lookahead)
    keys = [*by, "_block"]
    return cut, keys, W.partitionBy(*keys).orderBy(*order)


def home_rows(df: DataFrame) -> DataFrame:
    if "_home" not in df.columns:
        return df
    return df.where("_home").drop("_home", "_block")
