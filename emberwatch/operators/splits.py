"""Chronological train / validation / test split with a purge gap before each border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.config import SplitConfig
from emberwatch.functions.columns import iso
from emberwatch.plans.ranking import running_totals

SPLITS = ("train", "val", "test")


def split_borders(df: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """One row: train_end, val_start, val_end, test_start and the number of distinct timestamps.

    The cut points are positions in the sorted distinct timestamps of the whole table.
    """
    train, train_val = config.fractions()
    train_val += train
    instants = df.select(F.unix_micros(F.col("timestamp")).alias("us")).where("us is not null").distinct()
    slots = running_totals(instants, [], "us", {"n": F.lit(1)})
    total = F.col("total_n")
    cut1 = F.least(F.greatest(F.lit(1), F.floor(total * F.lit(train))), total - 2)
    cut2 = F.least(F.greatest(cut1 + 1, F.floor(total * F.lit(train_val))), total - 1)
    gap = F.lit(config.purge_ticks * config.interval_sec * 1_000_000)

    def at(position):
        return F.max(F.when(F.col("cum_n") == position, F.col("us")))

    ends = slots.agg(at(cut1).alias("t1"), at(cut2).alias("t2"), F.max("total_n").alias("instants"))
    return ends.select(
        F.timestamp_micros(F.col("t1") - gap).alias("train_end"),
        F.timestamp_micros("t1").alias("val_start"),
        F.timestamp_micros(F.col("t2") - gap).alias("val_end"),
        F.timestamp_micros("t2").alias("test_start"),
        "instants",
    )


def time_split(df: DataFrame, config: SplitConfig = SplitConfig(), borders=None) -> DataFrame:
    """Adds ``split``; purged rows are dropped. The borders are four timestamps, read once and inlined as literals, so
    the split is a filter that reaches the scan."""
    b = borders or split_borders(df, config).first()
    if (b["instants"] or 0) < 3:
        raise ValueError(f"need at least 3 distinct timestamps to split, got {b['instants'] or 0}")
    t = F.col("timestamp")
    split = (
        F.when(t <= F.lit(b["train_end"]), "train")
        .when((t > F.lit(b["val_start"])) & (t <= F.lit(b["val_end"])), "val")
        .when(t > F.lit(b["test_start"]), "test")
    )
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def split_report(split: DataFrame, label_columns: list[str]) -> DataFrame:
    """One row per split: rows, services, first / last tick, positive rate per label, plus the two checks over all
    splits. ``overlap_pairs`` counts pairs of splits whose time ranges touch."""
    per_split = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("service").alias("services"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        *[F.round(F.avg(c), 6).alias(f"{c}_rate") for c in label_columns],
    )
    ranges = per_split.agg(
        *[F.max(F.when(F.col("split") == s, F.col("first_ts"))).alias(f"{s}_lo") for s in SPLITS],
        *[F.max(F.when(F.col("split") == s, F.col("last_ts"))).alias(f"{s}_hi") for s in SPLITS],
    )

    def touch(a: str, b: str):
        hit = (F.col(f"{a}_lo") <= F.col(f"{b}_hi")) & (F.col(f"{b}_lo") <= F.col(f"{a}_hi"))
        return F.when(hit, 1).otherwise(0)

    def in_order(a: str, b: str):
        return F.coalesce(F.col(f"{b}_lo") > F.col(f"{a}_hi"), F.lit(True))

    pairs = touch("train", "val") + touch("train", "test") + touch("val", "test")
    ordered = in_order("train", "val") & in_order("val", "test") & in_order("train", "test")
    checks = ranges.select(pairs.alias("overlap_pairs"), ordered.alias("chronological"))
    return per_split.select(
        "split",
        "rows",
        "services",
        iso(F.col("first_ts")).alias("first_ts"),
        iso(F.col("last_ts")).alias("last_ts"),
        *[f"{c}_rate" for c in label_columns],
        checks.select("overlap_pairs").scalar().alias("overlap_pairs"),
        checks.select("chronological").scalar().alias("chronological"),
    )
