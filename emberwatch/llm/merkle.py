"""Merkle manifest of documents with octopus multiproofs.

Leaves of a source ascend by doc_id (missing first), then by digest; every three consecutive nodes hash into the next level
until one is left, the source's subroot. Subroots, ordered by source (missing first, then by bytes), hash into the root in
the same way. The tree is built by blocks of 3 ** LEVELS neighbouring nodes, so a source of any size takes a few rounds.

Proofs are made per leaf partition, by default a block of neighbouring leaves. A partition works out which coordinates its
leaves need and cannot derive themselves, the minimal union over all its leaves; these nodes are joined to it once, it
derives the interior nodes that its leaves share, and reads each leaf's siblings off level by level.

Values: null fields are ``-``. A row without doc_id is a leaf like others. Repeated rows are leaves of their own. An empty
table has no leaves and no root. Columns are found by their exact names; others are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import pick, unsigned
from emberwatch.llm.slices import ranged
from emberwatch.plans.durable import durable

FAN = 3
LEVELS = 6  # levels that one task derives from its block of nodes
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its length in front, so that no two rows have one encoding."""
    parts = []
    for c in fields:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, tree, leaf, other`` per row; other: the digest with the column ``tampered`` in place of the text."""
    rows = pick(docs, *FIELDS)
    fields = [F.col(c) for c in FIELDS]
    other = leaf_digest([*fields[:-1], tampered]) if tampered is not None else leaf_digest(fields)
    # Trees sort as sources do: missing first, the others by their bytes behind a common first character.
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_digest(fields).alias("leaf"), other.alias("other"))


def numbered_leaves(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place in the tree from 0 in ``order``, and ``n``, the leaves of the tree."""
    rows = ranged(rows, ["tree", *order], "merkle-leaves")
    counts = rows.groupBy("tree", "slice").agg(F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(tree).alias("n")
    )
    place = F.row_number().over(Window.partitionBy("tree", "slice").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    rows = rows.withColumn("within", place).join(counts, ["tree", "slice"])
    return rows.withColumn("i", F.col("before") + F.col("within")).drop("slice", "before", "within")


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


NODE = "tree string, level int, i long, n long, digest string"


def _grow(levels: int):
    """All nodes above a block of neighbouring nodes of one level, up to ``levels`` levels or the top of the tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        tree, level, n, first = rows["tree"].iloc[0], *(int(rows[c].iloc[0]) for c in ("level", "n", "i"))
        nodes, out = rows["digest"].tolist(), []
        for _ in range(min(levels, height(n))):
            nodes = [digest(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]
            level, n, first = level + 1, -(-n // FAN), first // FAN
            out += [(tree, level, first + k, n, x) for k, x in enumerate(nodes)]
        return pd.DataFrame(out, columns=["tree", "level", "i", "n", "digest"])

    return run


def build_trees(level0: DataFrame, most: int, levels: int = LEVELS) -> DataFrame:
    """All nodes ``tree, level, i, n, digest`` of trees with leaves ``tree, i, n, digest``; n: nodes of that level.

    ``most``: leaves of the largest tree, which bounds the rounds.
    """
    current = level0.select("tree", F.lit(0).alias("level"), "i", "n", "digest")
    out = current
    for round_ in range(-(-height(most) // levels)):
        block = F.floor(F.col("i") / FAN**levels)
        grown = durable(current.where("n > 1").groupBy("tree", block).applyInPandas(_grow(levels), NODE), "merkle-nodes")
        out = out.unionByName(grown)
        current = grown.where(F.col("level") == (round_ + 1) * levels)
    return out


def missing_coordinates(held: Iterable[int], n: int) -> list[tuple[int, int]]:
    """Coordinates (level, place) that must be fetched to prove the leaves ``held`` of a tree of ``n``, each once.

    Level by level, the runs of the known nodes are completed, and the parents of complete runs are known.
    """
    known, out, level = np.unique(np.fromiter(held, np.int64)), [], 0
    while n > 1:
        runs = np.unique(known // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        need = np.setdiff1d(members[members < n], known, assume_unique=True)
        out += [(level, int(k)) for k in need]
        known, n, level = runs, -(-n // FAN), level + 1
    return out


def _requests(rows: pd.DataFrame) -> pd.DataFrame:
    tree, part, n = rows["tree"].iloc[0], int(rows["part"].iloc[0]), int(rows["n"].iloc[0])
    need = missing_coordinates(rows["i"], n)
    return pd.DataFrame([(tree, part, level, i) for level, i in need], columns=["tree", "part", "level", "i"])


def _siblings(i: int, n: int, nodes: dict[tuple[int, int], str]) -> list[tuple[list[str], list[str]]]:
    """Digests left and right of a leaf's path, level by level."""
    out, level = [], 0
    while n > 1:
        first = i - i % FAN
        out.append(
            (
                [nodes[level, k] for k in range(first, i)],
                [nodes[level, k] for k in range(i + 1, min(first + FAN, n))],
            )
        )
        i, n, level = i // FAN, -(-n // FAN), level + 1
    return out


def fold(leaf: str, proof: list[tuple[list[str], list[str]]]) -> str:
    for left, right in proof:
        leaf = digest([*left, leaf, *right])
    return leaf


def _derive(nodes: dict[tuple[int, int], str], held: Iterable[int], n: int) -> None:
    """Adds the nodes above the leaves ``held`` to ``nodes``, which has those leaves and the missing coordinates."""
    known, level = sorted(set(held)), 0
    while n > 1:
        runs = sorted({k // FAN for k in known})
        for r in runs:
            nodes[level + 1, r] = digest(nodes[level, k] for k in range(r * FAN, min((r + 1) * FAN, n)))
        known, n, level = runs, -(-n // FAN), level + 1


PROVED = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PLACE, TREES = -1, -2  # levels of the rows that tell a partition its source's place among how many


def _expand(rows: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of one partition from its leaves and the nodes fetched for it."""
    out = []
    if len(rows):
        n, held = int(rows["n"].iloc[0]), rows["i"].astype(int).tolist()
        at = zip(fetched["upper"], fetched["level"].astype(int), fetched["i"].astype(int), fetched["digest"])
        nodes, top, told = dict(zip([(0, i) for i in held], rows["leaf"])), {}, {}
        for upper, level, i, x in at:
            if level < 0:
                told[level] = i
            else:
                (top if upper else nodes)[level, i] = x
        place, trees = told[PLACE], told[TREES]
        _derive(nodes, held, n)
        subroot = top[0, place] = nodes[height(n), 0]
        _derive(top, [place], trees)
        root, upper = top[height(trees), 0], _siblings(place, trees, top)
        for doc_id, i, leaf, other in zip(rows["doc_id"], held, rows["leaf"], rows["other"]):
            proof = _siblings(i, n, nodes) + upper
            again = fold(other, proof)
            flat = digest(x for left, right in proof for x in (*left, *right))
            out.append((doc_id, leaf, subroot, root, flat, again, again == root))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PROVED.split(", ")])


def _upper_requests(rows: pd.DataFrame) -> pd.DataFrame:
    tree, place, trees = rows["tree"].iloc[0], int(rows["place"].iloc[0]), int(rows["trees"].iloc[0])
    need = [*missing_coordinates([place], trees), (PLACE, place), (TREES, trees)]
    return pd.DataFrame([(tree, level, i) for level, i in need], columns=["tree", "level", "i"])


@dataclass(frozen=True)
class Manifest:
    """Written tables of a manifest.

    ``rows(doc_id, tree, leaf, other, i, n)``, ``nodes`` and ``upper`` (``tree, level, i, n, digest``: of the sources, and
    of the tree over them) and ``places(of, i, n, digest)``, a row per source.
    """

    rows: DataFrame
    nodes: DataFrame
    places: DataFrame
    upper: DataFrame
    levels: int

    def root(self) -> str | None:
        top = self.upper.where("n = 1").first()
        return top and top["digest"]


def build_manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> Manifest:
    """Manifest of ``docs(doc_id, source, lang, n_chars, text)``; ``tampered``: a text to check against it, see ``prove``.

    A task derives ``levels`` levels of a tree from a block of 3 ** levels nodes.
    """
    digests = durable(leaves(docs, tampered), "merkle-digests")  # texts are read once
    rows = durable(numbered_leaves(digests, ["doc_id", "leaf", "other"]), "merkle-placed")
    most = rows.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    nodes = build_trees(rows.select("tree", "i", "n", F.col("leaf").alias("digest")), most, levels)
    places = nodes.where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    places = durable(numbered_leaves(places, ["of"]), "merkle-places")
    upper = build_trees(places.select("tree", "i", "n", "digest"), places.count(), levels)
    return Manifest(rows, nodes, places, upper, levels)


def prove(manifest: Manifest, which: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of the manifest, or those of ``which``.

    folded_root is computed from the leaf with the tampered text and the siblings of the manifest.
    """
    rows = manifest.rows.withColumn("part", F.floor(F.col("i") / FAN**manifest.levels))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make missing numbers floats
    # Partitions with all their leaves derive the lowest levels themselves.
    nodes = manifest.nodes.where(F.col("level") >= manifest.levels) if which is None else manifest.nodes
    rows = rows if which is None else rows.where(which)
    held = rows.select("tree", "part", "i", "n")
    asked = held.groupBy("tree", "part").applyInPandas(_requests, "tree string, part long, level int, i long")
    own = asked.join(nodes.select("tree", "level", "i", "digest"), ["tree", "level", "i"])
    # Of the tree over the sources, all partitions of a source need the same nodes.
    places = manifest.places.select(F.col("of").alias("tree"), F.col("i").alias("place"), F.col("n").alias("trees"))
    need = places.groupBy("tree").applyInPandas(_upper_requests, "tree string, level int, i long")
    need = need.join(manifest.upper.select("level", "i", "digest"), ["level", "i"], "left")
    above = held.select("tree", "part").distinct().join(need, "tree")
    columns = ["tree", "part", "level", "i", "digest"]
    fetched = own.select(*columns, F.lit(False).alias("upper")).unionByName(above.select(*columns, F.lit(True).alias("upper")))
    parts = rows.select("tree", "part", "i", "n", "doc_id", "leaf", "other").groupBy("tree", "part")
    proved = parts.cogroup(fetched.groupBy("tree", "part")).applyInPandas(_expand, PROVED)
    return proved.withColumn("doc_id", F.col("doc_id").cast("long"))


def without_line_feeds() -> Column:
    """The text, without line feeds where 2 divides the checksum of doc_id in decimals."""
    even = F.col("doc_id").isNotNull() & (unsigned(F.col("doc_id").cast("string")) % 2 == 0)
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
