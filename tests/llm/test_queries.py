"""Registered queries against their SQL and against plain versions, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline as cp
from emberwatch.llm import queries as q
from emberwatch.llm.quality_rules import quality_rules
from tests.llm.brute import near_components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect()) if name in q.ORACLE else df.collect()
    if name in q.ORACLE:
        want = con.execute(f"select {', '.join(columns)} from ({q.ORACLE[name]})").fetchall()
        assert got == sorted(want)
    else:
        table = "pages" if name.startswith("op6_") else "documents"
        assert len(got) == con.execute(f"select count(*) from {table}").fetchall()[0][0] or name == "op8_packing"


def test_pipeline_stages(spark):
    docs = q.read(spark, FOLDER, "documents")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    good = cp.classify(spark, docs, FOLDER)
    assert good.columns == names and 0 < good.count() < len(before)
    clean = cp.rules(spark, good, FOLDER)
    kept = {r.doc_id for r in quality_rules(good).where("kept").collect()}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == kept
    single = cp.near_dedup(spark, clean, FOLDER)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert single.columns == names
    assert sorted(r.doc_id for r in single.collect()) == [d for d, _, _, k in near_components(rows, 5) if k]
    packed = cp.pack(spark, single, FOLDER)
    assert packed.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in packed.where("start = 0").collect())


def test_pipeline_run_equals_its_stages(spark):
    docs = q.read(spark, FOLDER, "documents")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, cp.run(spark, FOLDER).collect()))


def test_near_dedup_keeps_rows_without_doc_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, FOLDER).collect()) == [1, 2]


def near_dedup_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return sorted((tuple(r) for r in cp.near_dedup(spark, docs, FOLDER).collect()), key=str)


def test_near_dedup_keeps_different_texts_without_doc_id(spark):
    rows = [(None, "a b c d e f g", "x"), (None, "other words are in here", "x"), (None, "A b c d e f g", "x"), (None, None, "x")]
    got = near_dedup_of(spark, rows)
    assert len(got) == 3 and {r[1] for r in got} >= {None, "other words are in here"}
    assert got == near_dedup_of(spark, rows[::-1])


def test_near_dedup_decides_per_text_of_a_doc_id(spark):
    """Of doc 5 the first text stays, the second is a copy of doc 1, and the repeated row comes once."""
    rows = [
        (1, "a b c d e f g", "x"), (5, "quite another text of its own", "y"), (5, "a b c d e f g", "x"),
        (5, "quite another text of its own", "x"), (5, "quite another text of its own", "y"), (5, " ", "x"), (5, " ", "x"),
    ]
    want = [(1, "a b c d e f g", "x"), (5, " ", "x"), (5, " ", "x"), (5, "quite another text of its own", "x")]
    assert near_dedup_of(spark, rows) == want
