"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.plans.durable import durable

# Characters that separate words: space and U+0009 to U+000D; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by their exact names; the first of several wins and other spellings do no harm."""
    plain, found = by_place(df, *names)
    return plain.select(*[F.col(c).alias(n) for c, n in zip(found, names)])


def by_place(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called c0, c1 and so on, and what the named ones are called there.

    Names are matched exactly and the first of several wins, so names that differ in case only, or that an operator makes
    itself, do no harm; ``toDF(*df.columns)`` gives the old names back.
    """
    columns = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(columns))]), [f"c{columns.index(n)}" for n in names]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def byte_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words of a text as UTF-8; only A to Z are lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(_LOWER) if lower else raw).split()


def unsigned(c: Column) -> Column:
    """CRC32 of UTF-8 text as a long; null counts as empty."""
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary")).cast("long")


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (finaliser of a public 64-bit hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``(id, comp)`` for every id in ``links(a, b)``: the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so a chain of n links
    needs about log n rounds. Minima are combined before the shuffle, and every join has a table with unique keys on one
    side, so a node with very many links is split by the skew join.
    """
    both = durable(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label
    )
    state = durable(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp")),
        f"{label}-labels",
    )
    while True:
        seen = both.join(state.select(F.col("id").alias("b"), "comp"), "b").select(F.col("a").alias("id"), "comp")
        lower = seen.union(state).groupBy("id").agg(F.min("comp").alias("comp"))
        jump = lower.select("id", F.col("comp").alias("via")).join(
            state.select(F.col("id").alias("via"), F.col("comp").alias("far")), "via"
        )
        after = durable(jump.select("id", F.least("via", "far").alias("comp")), f"{label}-labels")
        moved = after.exceptAll(state).limit(1).count()
        state = after
        if not moved:
            return state


def batches_of(rows: Iterator, size: int) -> Iterator[list]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
