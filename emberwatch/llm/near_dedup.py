"""Near-duplicates by HyperMinHash sketches, banding and exact verification.

A document's set holds its distinct shingles of ``width`` lower-cased words (fewer words: the whole sequence as one
shingle) as 64-bit hashes. Equal sets form a class. A class gets 128 registers: the first seven bits of a hash choose the
register, of the rest the smallest value is kept as its leading-zero count (six bits) and the ten bits after the first
one. Four registers make a band and fit one long. Two sets of similarity 0.8 miss all 32 bands once in twenty million.

* Buckets of up to ``SMALL`` classes give all their pairs. A larger bucket links every member to its pivot, the member
  that shares most buckets with others, which resolves dense groups of copies without their pairs.
* Pairs pass if the collision-corrected Jaccard estimate is within five standard deviations of the threshold; then the full
  sets decide.
* What larger buckets may still hide is found exactly: classes in them are joined over the prefixes of their sets (rare
  shingles first, long enough that two linked sets must share one). Shared shingles whose holders are already connected
  are done; small ones give pairs, larger ones are compared in blocks by a matrix product that emits links only.

Null text, empty text and text without words have an empty set and are linked with nothing. Repeated rows come back as
often as they came. Rows without doc_id take part, but never name a component unless all its rows lack one. Columns are found by
their exact names; others are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import byte_words, components, mix, pick
from emberwatch.plans.durable import durable

REGISTERS, PER_BAND, MANTISSA = 128, 4, 10
EMPTY = 0xFFFF
SMALL = 32  # members of a bucket up to which all pairs are looked at: at most 15.5 pairs a member
BLOCK = 1024  # side of the blocks in which larger groups are compared
BLOCK_ITEMS = 1 << 22  # shingles of a block
COLUMNS = 4096  # shingles multiplied at once
HEAVY = 200_000  # shingles held by more than one in so many of all postings are sorted last, so there are at most as many
MEMORY_WORDS = 500_000
_EDGES = (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)


class _Words(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, known: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = byte_words(text)
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    out = mix(values[: len(values) - span + 1] + np.uint64(span))
    for k in range(1, span):
        out = mix(out * np.uint64(2 * k + 1) + values[k : len(values) - span + 1 + k])
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """Registers of a sorted set, four to a long."""
    registers = np.full(REGISTERS, EMPTY, np.uint16)
    cuts = np.searchsorted(items, _EDGES)
    filled = np.flatnonzero(np.diff(np.r_[cuts, len(items)]))
    if len(filled):
        rest = np.minimum.reduceat(mix(items), cuts[filled])
        top = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))[1].astype(np.int64)  # bits of the value
        top = np.where((rest >> np.minimum(np.maximum(top - 1, 0), 63).astype(np.uint64)) == 0, top - 1, top)
        zeros = np.minimum(64 - top, 62)
        after = np.where(
            top > MANTISSA + 1,
            rest >> np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64),
            rest << np.maximum(MANTISSA + 1 - top, 0).astype(np.uint64),
        )
        registers[filled] = (zeros << MANTISSA) | (after & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    return registers.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of paired register rows, and the number of registers each rests on.

    Registers that agree by chance are subtracted: with r mantissa bits about 0.17 x 2^-r of them, less where the sets
    differ in size.
    """
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(1)
    count = used.sum(1)
    chance = 0.169919487 * 2.0**-MANTISSA * count * 4 * n_a * n_b / np.maximum(n_a + n_b, 1.0) ** 2
    return np.maximum(same - chance, 0) / np.maximum(count, 1), count


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            keys, sizes, rows = [], [], []
            for text in batch.column("text").to_pylist():
                items = shingle_set(text, width, known)
                sizes.append(len(items))
                keys.append(xxhash.xxh3_128_hexdigest(items.tobytes()) if len(items) else None)
                rows.append(sketch(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sha"), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()),
                 pa.array(rows, pa.list_(pa.int64()))],
                ["doc_id", "sha", "n_shingles", "k", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            ids, sizes, rows = [], [], []
            for text, key, cid in zip(*(batch.column(c).to_pylist() for c in ("text", "k", "cid"))):
                items = shingle_set(text, width, known)
                if xxhash.xxh3_128_hexdigest(items.tobytes()) == key:
                    ids.append(cid)
                    sizes.append(len(items))
                    rows.append(items.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
                ["cid", "n", "items"],
            )

    return run


def _registers(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint16).reshape(len(column), REGISTERS)


def _likely(percent: int):
    """Keeps pairs whose estimate is at most five standard deviations under the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = percent / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            value, count = estimate(_registers(batch.column("s_a")), _registers(batch.column("s_b")), n_a, n_b)
            fits = np.minimum(n_a, n_b) >= s * np.maximum(n_a, n_b) - 1e-9
            good = fits & (value >= s - 5 * np.sqrt(s * (1 - s) / np.maximum(count, 1)))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` that pass the estimate."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("sketch").alias(f"s_{c}"), F.col("n").alias(f"n_{c}"))
    joined = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(_likely(percent), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs linked by their full sets."""
    side = lambda c: sets.select(F.col("cid").alias(c), F.col("items").alias(f"i_{c}"), F.col("n").alias(f"n_{c}"))
    both = F.size(F.array_intersect("i_a", "i_b"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    return joined.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _pairs_within(members: DataFrame, key: str, different: str | None = None) -> DataFrame:
    """Pairs of members with an equal key; the callers bound the members of a key."""
    left = members.select(key, F.col("cid").alias("a"), *([F.col(different).alias("l_a")] if different else []))
    right = members.select(key, F.col("cid").alias("b"), *([F.col(different).alias("l_b")] if different else []))
    pairs = left.join(right, key).where(F.col("a") < F.col("b"))
    return (pairs.where("l_a != l_b") if different else pairs).select("a", "b")


def _prefixes(heavy: np.ndarray, holders: np.ndarray, percent: int):
    """The first n - ceil(s n) + 1 elements of every set, rare ones first: in any common order two sets of similarity s
    share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, comps = (batch.column(c).to_numpy() for c in ("cid", "comp"))
            sets = batch.column("items")
            found = []
            for k in range(batch.num_rows):
                items = sets[k].values.to_numpy()
                at = np.minimum(np.searchsorted(heavy, items), max(len(heavy) - 1, 0))
                weight = np.where(heavy[at] == items, holders[at], 0) if len(heavy) else np.zeros(len(items), np.int64)
                first = len(items) + -len(items) * percent // 100 + 1
                found.append(items[np.lexsort((items, weight))[:first]])
            sizes = [len(x) for x in found]
            items = np.concatenate(found) if found else np.empty(0, np.int64)
            whole = np.array([len(sets[k]) for k in range(batch.num_rows)], np.int64)
            columns = [pa.array(x) for x in (items, *(np.repeat(c, sizes) for c in (cids, comps, whole)))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "cid", "comp", "n"])

    return run


def _block_links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One link for each two components that a link connects in this pair of blocks."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        rows = rows.drop_duplicates(["cid", "side"])
        if rows["comp"].nunique() > 1:
            columns, sizes = np.concatenate(rows["items"].to_list()), rows["n"].to_numpy()
            _, column, holders = np.unique(columns, return_inverse=True, return_counts=True)
            shared = holders > 1
            new = np.cumsum(shared) - 1
            keep = shared[column]
            at = np.repeat(np.arange(len(rows)), sizes)[keep]
            column = new[column[keep]]
            order = np.argsort(column, kind="stable")
            at, column = at[order], column[order]
            ids, comp, side = (rows[c].to_numpy() for c in ("cid", "comp", "side"))
            left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
            both = np.zeros((len(left), len(right)), np.float32)
            for low in range(0, int(shared.sum()), COLUMNS):  # so that the memory does not grow with the sets
                some = slice(*np.searchsorted(column, [low, low + COLUMNS]))
                dense = np.zeros((len(rows), COLUMNS), np.float32)
                dense[at[some], column[some] - low] = 1
                both += dense[left] @ dense[right].T
            union = sizes[left][:, None] + sizes[right][None, :] - both
            hit = (100 * both >= percent * union) & (comp[left][:, None] != comp[right][None, :])
            for i, j in zip(*np.nonzero(hit)):
                a, b = left[i], right[j]
                found.setdefault((min(comp[a], comp[b]), max(comp[a], comp[b])), (ids[a], ids[b]))
        return pd.DataFrame(list(found.values()), columns=["a", "b"], dtype="int64")

    return run


def _hidden_links(hot: DataFrame, sets: DataFrame, classes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links between classes of large buckets that are not connected yet."""
    held = durable(
        sets.join(hot, "cid").join(comps, F.col("cid") == F.col("id"), "left")
        .select("cid", "n", "items", F.coalesce("comp", "cid").alias("comp")),
        "near-hot",
    )
    postings = held.select(F.explode("items").alias("item"))
    many = held.agg(F.greatest(F.sum("n") / HEAVY, F.lit(2)).alias("least"))
    heavy = (
        postings.groupBy("item").agg(F.count("*").alias("holders")).join(F.broadcast(many))
        .where(F.col("holders") >= F.col("least")).select("item", "holders")
    )
    rows = sorted((r["item"], r["holders"]) for r in heavy.collect())  # at most HEAVY
    common = np.array(rows, np.int64).reshape(-1, 2)
    prefix = held.mapInArrow(_prefixes(common[:, 0], common[:, 1], percent), "item long, cid long, comp long, n long")
    prefix = durable(prefix, "near-prefix")
    open_items = (
        prefix.groupBy("item")
        .agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low != high")
    )
    open_items = durable(prefix.join(open_items.select("item", "members", "weight"), "item"), "near-open")
    few = _pairs_within(open_items.where(F.col("members") <= SMALL), "item", "comp")
    small = verified(durable(likely_pairs(few, classes, percent), "near-pairs"), sets, percent)
    # Larger groups: every member goes to the blocks that meet its own; side -1 / 1 tells rows of the two blocks apart.
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("weight") / BLOCK_ITEMS)).cast("int")
    large = open_items.where(F.col("members") > SMALL).withColumn("of", blocks)
    large = large.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("of")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    large = large.select(
        "item", "cid", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.signum(F.col("own") - F.col("other")).cast("int").alias("side"),
    )
    large = large.join(sets, "cid").select("item", "i", "j", "side", "cid", "comp", "n", "items")
    return small.union(large.groupBy("item", "i", "j").applyInPandas(_block_links(percent), "a long, b long"))


def text_sha(text: str = "text") -> Column:
    """Tells the texts of one doc_id apart."""
    return F.sha2(F.col(text).cast("binary"), 256)


def _named_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, n_shingles, k`` and classes ``k, first, comp``.

    k is the class of equal sets, null for an empty set; first is the least ``(no_id, doc_id, sha)`` of the rows of a class,
    those without doc_id last; comp numbers the components.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("sha", text_sha())
    rows = durable(
        docs.mapInArrow(_sketches(width), "doc_id long, sha string, n_shingles long, k string, sketch array<long>"), "near-rows"
    )
    classes = rows.where("k is not null").groupBy("k")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha"))
    classes = classes.agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()), "near-classes")

    posts = classes.select("cid", F.posexplode("sketch").alias("band", "key")).where("key != -1")
    posts = posts.select("cid", F.xxhash64("band", "key").alias("bucket"))
    filled = posts.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    posts = durable(posts.join(durable(filled, "near-filled"), "bucket"), "near-buckets")
    large = posts.where(F.col("members") > SMALL)
    shared = posts.groupBy("cid").agg(F.sum("members").alias("shared"))
    pivots = large.join(shared, "cid").groupBy("bucket").agg(F.max_by("cid", F.struct("shared", "cid")).alias("pivot"))
    stars = large.join(pivots, "bucket").where("cid != pivot")
    stars = stars.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"))
    few = _pairs_within(posts.where(F.col("members") <= SMALL), "bucket")
    pairs = durable(likely_pairs(few.union(stars), classes, percent), "near-pairs")

    hot = large.select("cid").distinct()
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).union(hot).distinct()
    wanted = classes.join(wanted, "cid").select("cid", "k", F.col("first.doc_id").alias("rep"), F.col("first.sha").alias("of"))
    # By text as well: rows without doc_id would all meet each other.
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"]) & (docs["sha"] == wanted["of"])).select("cid", "k", "text")
    sets = durable(texts.mapInArrow(_sets(width), "cid long, n long, items array<long>"), "near-sets")

    links = durable(verified(pairs, sets, percent), "near-links")
    comps = components(links, "near")
    hidden = durable(_hidden_links(hot, sets, classes, comps, percent), "near-links")
    if hidden.limit(1).count():
        comps = components(links.union(hidden), "near")

    named = classes.join(comps, F.col("cid") == F.col("id"), "left")
    return rows, durable(named.select("k", "first", F.coalesce("comp", "cid").alias("comp")), "near-named")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links of at least ``percent``; kept where it is the own one.
    """
    rows, named = _named_classes(docs, width, percent)
    least = named.groupBy("comp").agg(F.min("first.doc_id").alias("component_id"))
    named = durable(named.join(least, "comp").select("k", "component_id"), "near-named")
    out = rows.join(named, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def survivors(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, sha`` of one row per component: of the smallest doc_id, rows without one last, then of the smallest class
    key, then of the smallest ``text_sha``. Rows with an empty set are in no component."""
    _, named = _named_classes(docs, width, percent)
    order = F.struct("first.no_id", "first.doc_id", "k", "first.sha")
    return named.groupBy("comp").agg(F.min(order).alias("w")).select("w.doc_id", "w.sha")
