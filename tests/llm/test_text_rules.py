"""Quality rules, classifier and fingerprints against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import fingerprints as fp
from emberwatch.llm import quality_classifier as qc
from emberwatch.llm.common import pick
from emberwatch.llm.quality_rules import RULES, Rule, keep_good, quality_rules
from tests.llm.brute import words
from tests.llm.conftest import prose

SYMBOLS = set("#*$%&|<>")


def counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x in windows if windows.count(x) > 1} if len(set(windows)) < len(windows) else set()
    covered = {i + k for i, x in enumerate(windows) if x in often for k in range(5)}
    n = len(w)
    return (
        n, sum(map(len, w)), sum(c in SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def test_measures_equal_plain_counts(docs, corpus):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(tuple(r) for r in quality_rules(docs).where("doc_id is not null").select(*names).collect())
    assert got == sorted((i, *counts(t)) for i, t in corpus if i is not None)


def test_rules_can_be_replaced(docs):
    strict = quality_rules(docs, rules=[Rule("n_words", least=10**6)])
    assert strict.where("kept").count() == 0
    assert quality_rules(docs, base=[], rules=[]).where("not kept").count() == 0


def test_filter_keeps_columns_and_rows(docs):
    kept = keep_good(pick(docs, "doc_id", "text", "score"))
    assert kept.columns == ["doc_id", "text", "score"]
    good = quality_rules(docs).where("kept").count()
    assert kept.count() == good > 0
    assert {r.measure for r in RULES} >= {"symbols_per_word", "stop_word_ratio", "dup_line_ratio"}


def test_no_rows_and_null_rows(empty, nothing):
    assert quality_rules(empty).count() == 0 and keep_good(empty).count() == 0
    row = quality_rules(nothing).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed, row.kept) == (0, 0, True, False)


# -- fingerprints


def test_edited_texts_and_fingerprints(docs, corpus):
    rows = sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    want = []
    for k, (i, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    out = fp.document_fingerprints(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], key=key) == sorted(want, key=key)
    prints = {}
    for r in out:
        prints.setdefault(r.doc_id, r.fingerprint)
        assert len(r.fingerprint) == 32 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for i, t in corpus:
        by_text.setdefault(t or "", set()).add(prints[i])
    assert all(len(x) == 1 for x in by_text.values())
    assert by_text[" \t\n\x0b\x0c\r"] == by_text[""] == {"0" * 32}


def test_votes_are_counted_bit_by_bit(spark):
    text = "alpha beta alpha gamma"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    w = text.split()
    terms = [(a, None, min(len(a), 16)) for a in w] + [(a, b, min(len(a), 16) + min(len(b), 16)) for a, b in zip(w, w[1:])]
    got = fp.fingerprints(df, ["doc_id"]).first().fingerprint
    want = ""
    for s in (1, 2):
        hashes = [
            spark.range(1).select(F.xxhash64(F.lit(s), F.lit(a), *([F.lit(b)] if b else [])).alias("h")).first().h for a, b, _ in terms
        ]
        votes = [sum(v if (h >> k) & 1 else -v for h, (_, _, v) in zip(hashes, terms)) for k in range(64)]
        want += format(sum(1 << k for k, v in enumerate(votes) if v > 0), "016x")
    assert got == want


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(12)]
    values = base + [b ^ sum(1 << x for x in rng.sample(range(128), k)) for b in base for k in (1, 3, 6, 7, 12)]
    rows = [(i, format(v, "032x")) for i, v in enumerate(values)] + [(900, format(values[0], "032x"))]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {(r.fingerprint, r.other, r.bits) for r in fp.within_radius(df, df).collect()}
    near = [(a, b, (a ^ b).bit_count()) for a in set(values) for b in set(values)]
    assert got == {(format(a, "032x"), format(b, "032x"), d) for a, b, d in near if d <= fp.RADIUS}
    out = {r.doc_id: r.n_within for r in fp.neighbour_counts(df).collect()}
    want = {i: sum((int(f, 16) ^ int(g, 16)).bit_count() <= fp.RADIUS for _, g in rows) - 1 for i, f in rows}
    assert out == {i: want[i] if i % 100 == 0 else None for i in want}


def test_fingerprints_without_rows(empty, nothing):
    assert fp.document_fingerprints(empty).collect() == []
    assert [(r.doc_id, r.n_chars, r.near_next) for r in fp.document_fingerprints(nothing).collect()] == [(None, 0, 1.0)] * 2


def test_one_document_follows_itself(spark):
    row = fp.document_fingerprints(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# -- classifier


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, rng.randrange(5, 200)), 1) for i in range(0, 600, 2)]
    bad = [(i, " ".join(w.upper() + "!!" if i % 4 == 1 else w + "###" for w in prose(rng, rng.randrange(5, 200)).split()), 0) for i in range(1, 300, 2)]
    return good + bad


def test_held_out_accuracy(spark, graded):
    df = spark.createDataFrame([r[:2] for r in graded], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in graded], "doc_id long, quality int").where(~qc.held_out())
    out = {r.doc_id: r for r in qc.score_quality(df, qc.fit_quality(df, labels)).collect()}
    held = [(out[i], q) for i, _, q in graded if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in out.values()) == len(held)
    assert np.mean([r.predicted == q for r, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(80, 3)), rng.normal(1, 2, size=(120, 3))]
    y = np.r_[np.zeros(80, int), np.ones(120, int)]
    model = qc.fit(x, y, 0.2, 0.05)
    z = (x - x.mean(0)) / x.std(0)
    own = [np.cov(z[y == k].T) for k in (0, 1)]
    common = (80 * own[0] + 120 * own[1]) / 200
    logs = []
    for k, share in ((0, 0.4), (1, 0.6)):
        c = 0.8 * own[k] + 0.2 * common
        c = 0.95 * c + 0.05 * np.trace(c) / 3 * np.eye(3)
        d = z - z[y == k].mean(0)
        logs.append(np.log(share) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_awkward_texts_are_scored(spark, docs, corpus, empty, nothing):
    labels = spark.createDataFrame([(i, n % 2) for n, (i, _) in enumerate(corpus)], "doc_id long, quality int")
    out = qc.score_quality(docs, qc.fit_quality(docs, labels))
    assert out.count() == len(corpus) and out.where("score is null or isnan(score)").count() == 0
    constant = qc.fit_quality(empty, labels)
    assert constant.constant == 0.5
    assert [r.predicted for r in qc.score_quality(nothing, constant).collect()] == [0, 0]
    assert qc.score_quality(empty, constant).count() == 0
    few = spark.createDataFrame([(None, 1), (7, None), (7, 3)], "doc_id long, quality int")
    assert qc.fit_quality(docs, few).constant == 0.5


def test_fit_takes_a_bounded_sample(docs, corpus, spark):
    labels = spark.createDataFrame([(i, n % 2) for n, (i, _) in enumerate(corpus)], "doc_id long, quality int")
    assert qc.fit_quality(docs, labels, most=1).constant is not None
    kept = qc.keep_scored(pick(docs, "doc_id", "text", "k"), qc.fit_quality(docs, labels), threshold=0.0)
    assert kept.columns == ["doc_id", "text", "k"] and kept.count() == len(corpus)
