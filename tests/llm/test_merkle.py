"""Merkle manifest against a plain version, and its multiproofs."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberwatch.llm import merkle as mk


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(*fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    for nodes in tree[:-1]:
        first = i - i % 3
        yield nodes[first:i], nodes[i + 1 : first + 3]
        i //= 3


def plain_proofs(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        text = r[4]
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        by_source[r[1]].append((r[0] is not None, r[0] or 0, encoded(*r), encoded(*r[:4], text), r[0]))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:4])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (*_, leaf, other, doc_id) in enumerate(sorted(by_source[s], key=lambda x: x[:4])):
            proof = [*path(trees[s], i), *path(top, k)]
            again = other
            for left, right in proof:
                again = sha(*left, again, *right)
            root = top[-1][0]
            flat = sha(*(x for left, right in proof for x in (*left, *right)))
            out.append((doc_id, leaf, trees[s][-1][0], root, flat, again, again == root))
    return sorted(out, key=str)


def proofs(df):
    names = [c.split()[0] for c in mk.PROVED.split(", ")]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def table(spark, rows):
    """With columns whose names differ in case only from those used."""
    wide = [(*r, "x", 1.5) for r in rows]
    return spark.createDataFrame(wide, SCHEMA + ", Text string, DOC_ID double").repartition(5)


@pytest.mark.parametrize("levels_", [1, 2, 6])
def test_proofs(spark, levels_):
    rng = random.Random(levels_)
    sources = [None, "", "a", "ä", "z", "hot", *(f"s{k}" for k in range(9))]
    rows = []
    for k in range(400):
        text = rng.choice([None, "", "\n", f"one\ntwo {k}", "plain", "😀\n" * 3])
        source = "hot" if k % 2 else rng.choice(sources)
        rows.append((rng.choice([k, k, k, None, 7, 2**60 + k, -k]), source, rng.choice([None, "en"]), rng.choice([None, k]), text))
    rows += [rows[3], rows[3]]
    docs = table(spark, rows)
    built = mk.build_manifest(docs, mk.without_line_feeds(), levels_)
    got = proofs(mk.prove(built))
    assert got == plain_proofs(rows) and {r[-1] for r in got} == {True, False} and built.root() == got[0][3]
    some = F.col("i") % 5 == 2
    assert set(proofs(mk.prove(built, some))) < set(got)


def test_small_tables(spark):
    assert mk.prove(mk.build_manifest(table(spark, []))).count() == 0 and mk.build_manifest(table(spark, [])).root() is None
    for rows in ([(None,) * 5], [(1, "a", "en", 3, "x\ny")], [(1, "a", "en", 3, "x" * 2_000_000), (2, "b", None, None, None)]):
        docs = table(spark, rows)
        assert proofs(mk.prove(mk.build_manifest(docs, mk.without_line_feeds()))) == plain_proofs(rows)


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 200).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(0, n - 1), min_size=1))))
def test_missing_coordinates_are_the_least(case):
    """All leaves can be proved with the coordinates fetched, none of which could be derived."""
    n, held = case
    tree = levels([sha(str(k)) for k in range(n)])
    need = mk.missing_coordinates(held, n)
    assert len(set(need)) == len(need)
    nodes = {(level, i): tree[level][i] for level, i in need} | {(0, i): tree[0][i] for i in held}
    fetched = dict(nodes)
    mk._derive(nodes, held, n)
    for i in held:
        proof = mk._siblings(i, n, nodes)
        assert proof == list(path(tree, i)) and mk.fold(tree[0][i], proof) == tree[-1][0]
    for level, i in need:  # nothing below a fetched node is held, and its run holds a known one
        below = {k // 3**level for k in held}
        assert i not in below and {r // 3 for r in below} >= {i // 3} and fetched[level, i]
