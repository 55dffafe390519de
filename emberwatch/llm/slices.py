"""Numbering within groups of any size, by slices of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.plans.durable import durable
from emberwatch.plans.slices import borders, slice_of

__all__ = ["borders", "numbered", "ranged", "slice_of"]


def ranged(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Written table of ``df`` with a column ``slice`` that never falls in ``order`` (nulls first).

    Slices hold about equally many rows however the values lie: a value with most of the rows, null too, is spread, and
    rows that are equal in ``order`` are split by their place in the table. ``df`` is read twice.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(count, *order, "__place")
    return durable(rows.drop("__place").withColumn("slice", F.spark_partition_id()), label)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: places from 0 without gaps within each ``group``, by slice and then by ``order`` (nulls first).

    ``df`` has a column ``slice`` and is read twice, so it should be a written table. Rows are numbered within (group,
    slice); counts per slice give the offsets, so a group with most of the rows is spread over all slices.
    """
    counts = df.groupBy(group, "slice").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(group, "slice").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    out = df.withColumn("within", within).join(offsets, [group, "slice"])
    return out.withColumn(name, F.col("before") + F.col("within") - 1).drop("within", "before")
