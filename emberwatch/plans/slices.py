"""Slices of a table by an integer key, for work in key order without one task that sees all rows.

Like a range partitioner's, the borders follow the cluster's number of partitions, not the data: slices hold about equally
many rows however unevenly the keys lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES_PER_PARTITION = 4


def borders(df: DataFrame, key: str | Column = "doc_id") -> list[int]:
    """Smallest key of each slice; empty if no row has a key."""
    count = SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = [i / count for i in range(1, count)]
    row = df.agg(F.min(key), F.percentile_approx(key, marks, max(10_000, 20 * count))).first()
    return sorted({x for x in [row[0], *(row[1] or [])] if x is not None})


def slice_of(key: Column, cuts: list[int]) -> Column:
    """Number of the slice, first among groups of borders, then within the group; it never falls as the key grows.
    Rows without key are in the last slice."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    within = lambda edges: F.size(F.filter(edges, lambda c: c <= key))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    group = within(longs([g[0] for g in groups])) - 1
    inner = within(F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(group, F.lit(0)) + 1))
    return F.when(key.isNull(), F.lit(len(cuts) - 1)).otherwise(group * width + inner - 1)
