"""As-of counts from one sweep: how many points lie before a time, without meeting points and times in a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.plans.slices import borders, slice_of


def counts_up_to(points: DataFrame, asked: DataFrame, keys: Sequence[str], at: str = "at", inclusive: str = "inclusive") -> DataFrame:
    """``asked`` with ``n_before``, the points of the same keys before the time ``at``, or up to it where ``inclusive``.

    ``points`` has ``keys`` and ``at``. Points and questions are sorted together in slices of time and counted by a running
    sum within a slice, to which the totals of the earlier slices are added: no pair of them is made, and neither a key nor,
    without keys, the whole table is one task. Questions without time have no answer and are left out.
    """
    columns = asked.columns
    row = F.struct(*columns)
    rows = points.select(*keys, F.unix_micros(at).alias("_at"), F.lit(1).alias("_order"), F.lit(None).cast(asked.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    questions = asked.select(*keys, F.unix_micros(at).alias("_at"), F.when(F.col(inclusive), 2).otherwise(0).alias("_order"), row.alias("_row"))
    both = rows.unionByName(questions).where("_at is not null")
    both = both.withColumn("_slice", slice_of(F.col("_at"), borders(both, "_at")))
    group = [*keys, "_slice"]
    totals = both.groupBy(*group).agg(F.count_if(F.col("_order") == 1).alias("_points"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, F.coalesce(F.sum("_points").over(earlier), F.lit(0)).alias("_carried"))
    local = W.partitionBy(*group).orderBy("_at", "_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = both.withColumn("_here", F.sum((F.col("_order") == 1).cast("long")).over(local))
    counted = counted.where(F.col("_order") != 1).join(totals, group)
    return counted.select("_row.*", (F.col("_carried") + F.col("_here")).alias("n_before"))
