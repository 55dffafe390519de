import random

import numpy as np
import pytest

from emberwatch.llm import near_dedup as nd
from emberwatch.llm.common import components
from tests.llm.brute import shingles, near_components


def result(df):
    return sorted(
        [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1])
    )


@pytest.mark.parametrize("width", [4, 5])
def test_equals_brute_force(docs, corpus, width):
    assert result(nd.near_duplicates(docs, width=width)) == near_components(corpus, width)


def test_large_buckets_take_the_exact_way(docs, corpus, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 2)
    monkeypatch.setattr(nd, "BLOCK", 16)
    assert result(nd.near_duplicates(docs, width=4)) == near_components(corpus, 4)


def test_chain_in_a_dense_group(spark, monkeypatch):
    """Each text is linked with the next only, and all share a passage: no pivot sees all links."""
    monkeypatch.setattr(nd, "SMALL", 2)
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words[3 * i : 3 * i + 3] = [f"c{i}{k}" for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(nd.near_duplicates(df, width=4)) == near_components(rows, 4)


def test_nothing_to_do(empty, nothing):
    assert nd.near_duplicates(empty).collect() == []
    assert [tuple(r) for r in nd.near_duplicates(nothing).collect()] == [(None, 0, None, True)] * 2


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        values = []
        for _ in range(60):
            items = rng.integers(0, 2**64 - 1, 2000, dtype=np.uint64)
            both = int(2000 * 2 * share / (1 + share) / 2)
            common = items[:both]
            rest = (2000 - both) // 2
            a = np.unique(np.r_[common, items[both : both + rest]])
            b = np.unique(np.r_[common, items[both + rest : both + 2 * rest]])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            pair = [nd.sketch(x).view(np.uint16)[None, :] for x in (a, b)]
            values.append(nd.estimate(*pair, np.array([len(a)]), np.array([len(b)]))[0][0] - true)
        assert abs(np.mean(values)) < 0.02 and np.std(values) < 0.055


def test_register_holds_zeros_and_mantissa():
    items = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    items.sort()
    for register, bucket in zip(nd.sketch(items).view(np.uint16), range(nd.REGISTERS)):
        mine = [int(x) for x in nd.mix(items[(items >> np.uint64(57)) == bucket])]
        if not mine:
            assert register == nd.EMPTY
            continue
        bits = format(min(mine), "064b")
        zeros = len(bits) - len(bits.lstrip("0"))
        after = (bits[zeros + 1 :] + "0" * 10)[:10]
        assert register == (min(zeros, 62) << 10) | int(after, 2)


def test_shingles_of_short_texts():
    known = nd._Words()
    assert len(nd.shingle_set("A b", 4, known)) == 1
    assert (nd.shingle_set("A b", 4, known) == nd.shingle_set("a B", 4, known)).all()
    assert (nd.shingle_set("a b", 4, known) != nd.shingle_set("b a", 4, known)).all()
    assert len(nd.shingle_set("a b c d e", 4, known)) == len(shingles("a b c d e", 4)) == 2


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)}
