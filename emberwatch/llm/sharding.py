"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone; there is no ring table. Adding shards moves the
necessary fraction only, and only into the new shards. Rows without key behave like rows with key -1; repeated keys share a
shard. Slots number the rows of a shard from 0 by key (without key: first), checksum and size; rows are spread by all three, so
no key, also none, is one task. Columns are found by their exact names; others are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import pick, unsigned
from emberwatch.llm.slices import numbered, ranged
from emberwatch.plans.durable import durable

# Fixed values of the published algorithm: multiplier of its generator, and the bits it draws from.
MULTIPLIER = 2862933555777941757
DRAWN_BITS = 31


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key; all keys advance together until each has jumped past the last shard."""
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    active = ahead < shards
    while active.any():
        at[active] = ahead[active]
        state[active] = state[active] * np.uint64(MULTIPLIER) + np.uint64(1)
        drawn = (state[active] >> np.uint64(64 - DRAWN_BITS)).astype(np.float64) + 1
        ahead[active] = ((at[active] + 1) * (float(1 << DRAWN_BITS) / drawn)).astype(np.int64)
        active = ahead < shards
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jump(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return jump(F.coalesce(key.cast("long"), F.lit(-1)))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row of ``docs(doc_id, text)``."""
    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        unsigned(F.col("text")).alias("text_crc32"),
        shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    order = ["doc_id", "text_crc32", "size"]
    placed = numbered(ranged(durable(rows, "shard-sizes"), order, "shard-rows"), "shard", order, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int = 16) -> None:
    """Writes ``docs`` as Parquet under ``path``, one folder per shard with ``files`` files each."""
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), shards))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(files))
    placed.repartition(shards * files, "shard", part).write.partitionBy("shard").parquet(path)
