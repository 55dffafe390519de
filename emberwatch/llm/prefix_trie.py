"""Trie of the prefixes that conversations share, with subtree totals by depth-band rollup.

A node is a distinct sequence of first turns. Its key adds up (exclusive or, two lanes of 64 bits) a hash of every turn
with its position, so keys of a conversation's prefixes are running sums: they are made in slices, and a conversation with
most of all turns is spread over many tasks.

Totals rise through bands of fixed height. A node is exploded to its ancestors within its band only; the roots of the
bands then form a trie that is ``height`` times as flat and is rolled up the same way, and their completed totals are
exploded to the ancestors in the band above. So a row explodes to at most ``height`` rows and the rounds are the logarithm
of the depth, also for a single conversation of a billion turns.

Turns are ordered by turn (null first), then by digest; repeated rows are turns of their own. Null role and null text
count as empty. Rows without conv_id belong to no conversation and make no node. A table without conversations has no
nodes, not even the root. Columns are found by their exact names; others are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import pick, unsigned
from emberwatch.llm.slices import ranged
from emberwatch.plans.durable import durable

HEIGHT = 16  # depths of a band
CHUNK = 256  # conversation ids hashed as one text
GROUP = 100  # conversations that may begin with turns of the first of them


def turn_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, chars`` per row of ``turns(conv_id, turn, role, text)``; texts stay behind."""
    rows = pick(turns, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.sha2(whole.cast("binary"), 256), 1, 32).alias("digest"),
        F.length(text("text")).cast("long").alias("chars"),
    )


def _before(over: str, by: str) -> Window:
    return Window.partitionBy(over).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def own_turns(digests: DataFrame) -> DataFrame:
    """Conversations as they are: ``conv_id, slice, pos, digest, chars`` with pos from 1."""
    rows = ranged(digests, ["conv_id", "turn", "digest"], "trie-turns")
    counts = rows.groupBy("conv_id", "slice").agg(F.count("*").alias("rows"))
    offsets = counts.select("conv_id", "slice", F.coalesce(F.sum("rows").over(_before("conv_id", "slice")), F.lit(0)).alias("before"))
    order = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = rows.withColumn("within", F.row_number().over(order)).join(offsets, ["conv_id", "slice"])
    return placed.select("conv_id", "slice", (F.col("before") + F.col("within")).alias("pos"), "digest", "chars")


def rebuilt_turns(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their group, and all their ids.

    Conversation c takes the first h turns of c - c % 100 (h: crc32 of c in decimals, modulo 6) and then its own after its
    first h. The first table is as of ``own_turns``, the second ``conv_id``, also of conversations left without turns.
    """
    own = durable(own_turns(digests), "trie-own")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("size"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    head = F.when(base == F.col("conv_id"), 0).otherwise(unsigned(F.col("conv_id").cast("string")) % 6)
    convs = durable(sizes.select("conv_id", "size", base.alias("base"), head.alias("head")), "trie-convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("has"))
    lent = F.least("head", F.coalesce("has", F.lit(0)))
    shifts = convs.join(bases, "base", "left").select("conv_id", "base", "head", lent.alias("lent"))
    # Shifts are joined per (conversation, slice), so that no conversation is one key.
    by_slice = own.select("conv_id", "slice").distinct().join(shifts.drop("base"), "conv_id")
    rest = own.join(by_slice, ["conv_id", "slice"]).where("pos > head")
    rest = rest.select("conv_id", "slice", (F.col("pos") - F.col("head") + F.col("lent")).alias("pos"), "digest", "chars")
    firsts = own.where((base == F.col("conv_id")) & (F.col("pos") < 6)).withColumnRenamed("conv_id", "base")
    begun = shifts.join(firsts.drop("slice"), "base").where("pos <= head")
    begun = begun.select("conv_id", F.lit(-1).alias("slice"), "pos", "digest", "chars")
    return rest.unionByName(begun), convs.select("conv_id")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, chars, ends`` per prefix with turns; ends: the conversation has no further turn."""
    lanes = {f"x{i}": F.xxhash64(F.lit(i), "pos", "digest") for i in (1, 2)}
    turns = durable(turns.withColumns(lanes).drop("digest"), "trie-rebuilt")
    sums = turns.groupBy("conv_id", "slice").agg(
        F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.max("pos").alias("last")
    )
    earlier = _before("conv_id", "slice")
    sums = sums.select(
        "conv_id", "slice", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)],
        F.max("last").over(Window.partitionBy("conv_id")).alias("last"),
    )
    upto = Window.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = turns.select("conv_id", "slice", "pos", "chars", *[F.bit_xor(f"x{i}").over(upto).alias(f"r{i}") for i in (1, 2)])
    key = lambda i: F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"k{i}")
    return running.join(sums, ["conv_id", "slice"]).select(
        "conv_id", F.col("pos").alias("depth"), key(1), key(2), "chars", (F.col("pos") == F.col("last")).alias("ends")
    )


def roll_up(paths: DataFrame, values: DataFrame, deepest: int, height: int = HEIGHT) -> DataFrame:
    """Sums over subtrees: ``conv_id, depth`` and the other columns of ``values`` per node.

    ``paths(conv_id, depth, node)`` has, for every conversation and depth, the node there by its smallest conversation;
    ``values(conv_id, depth, ...)`` has the numbers of each node.
    """
    names = [c for c in values.columns if c not in ("conv_id", "depth")]
    band = F.floor(F.col("depth") / height).alias("band")
    steps = F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("steps")  # at most `height`
    arrays = paths.groupBy("conv_id", band).agg(steps)
    if deepest >= height:
        arrays = durable(arrays, "trie-bands")

    def to_ancestors(rows: DataFrame, reach: Column) -> DataFrame:
        rows = rows.join(arrays, ["conv_id", "band"])
        step = F.explode(F.filter("steps", lambda s: s["depth"] <= reach)).alias("s")
        return rows.select(step, *names).select(F.col("s.node").alias("conv_id"), F.col("s.depth").alias("depth"), *names)

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in names])

    within = total(to_ancestors(values.withColumn("band", band), F.col("depth")))
    if deepest < height:
        return within
    within = durable(within, "trie-within")
    flat = lambda df: df.where(F.col("depth") % height == 0).withColumn("depth", F.floor(F.col("depth") / height))
    complete = roll_up(flat(paths), flat(within), deepest // height, height)
    below = complete.where("depth > 0").withColumn("band", F.col("depth") - 1)
    return total(within.unionByName(to_ancestors(below.withColumn("depth", F.col("depth") * height), F.col("depth"))))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of sorted rows, a chunk of one node at a time."""
    held, at, number = [], None, 0

    def flush() -> pa.RecordBatch:
        columns = [[at[0]], [at[1]], [held[0]], [",".join(map(str, held))]]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["depth", "node", "first", "ids"]
        )

    for batch in batches:
        for depth, node, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv_id"))):
            if held and (at != (depth, node) or len(held) == CHUNK):
                yield flush()
                held = []
            at = depth, node
            held.append(conv)
    if held:
        yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, which come one after the other; only its state is held."""
    done, at, sha = [], None, None
    rows = chain.from_iterable(
        zip(*(b.column(c).to_pylist() for c in ("depth", "node", "ids"))) for b in batches
    )
    for depth, node, ids in chain(rows, [(None, None, "")]):
        if at != (depth, node):
            if at is not None:
                done.append((*at, sha.hexdigest()))
            if done and (depth is None or len(done) >= 1000):
                d, n, s = zip(*done)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.string())], ["depth", "conv_id", "ends_sha256"]
                )
                done = []
            at, sha = (depth, node), hashlib.sha256()
        else:
            sha.update(b",")
        sha.update(ids.encode())


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, conv_id, ends_sha256`` per node of ``ends(depth, node, conv_id)``, its ids ascending.

    A digest is made in order, so a node's ids meet in one task, but as few chunks and a constant memory.
    """
    ends = durable(ends, "trie-ends")
    count = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ends = ends.repartitionByRange(count, "depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    chunks = sorted_ends.mapInArrow(_joined_ids, "depth long, node long, first long, ids string")
    chunks = chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return chunks.mapInArrow(_hashed, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Nodes of the trie of conversations given as of ``rebuilt_turns``: one row per node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.
    """
    spark = convs.sparkSession
    keys = durable(prefix_keys(turns), "trie-keys")
    found = keys.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.max("chars").alias("chars")
    )
    found = durable(found, "trie-found")
    top = convs.agg(F.min("conv_id"), F.count("*")).first()
    if top[0] is None:
        top = (None, 0)
    deepest = found.agg(F.max("depth")).first()[0] or 0
    # A prefix that a third of all conversations share is one key of many rows: a join, which Spark splits, not a group.
    met = durable(keys.select("conv_id", "depth", "k1", "k2", "ends").join(found, ["depth", "k1", "k2"]).drop("k1", "k2"), "trie-met")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(top[0]).cast("long").alias("node"))
    paths = met.select("conv_id", "depth", "node").unionByName(root)
    turnless = root.join(keys.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    idle = turnless.count()
    one = spark.range(1 if top[1] else 0).select(
        F.lit(top[0]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(top[1]).alias("n_convs"),
        F.lit(idle).alias("n_ends"), F.lit(0).alias("chars"),
    )
    nodes = met.where("node = conv_id").select("conv_id", "depth", "n_convs", "n_ends", "chars").unionByName(one)
    parents = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = durable(nodes.join(parents, ["conv_id", "depth"], "left"), "trie-nodes")

    values = nodes.select(
        "conv_id", "depth", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = roll_up(paths, values, deepest, height)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"))
    ends = met.where("ends").select("depth", "node", "conv_id").unionByName(turnless.select("depth", "node", "conv_id"))
    out = nodes.join(totals, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left")
    out = out.join(end_digests(ends), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Trie of the rebuilt conversations of ``turns(conv_id, turn, role, text)``."""
    digests = durable(turn_digests(turns), "trie-digests")  # texts are read once
    return prefix_trie(*rebuilt_turns(digests), height)
