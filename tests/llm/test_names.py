"""Every operator and stage on tables whose further columns have clashing names."""

import pytest

import corpus_pipeline as cp
from emberwatch.llm import bpe_codec, chat_format, fingerprints, html_extract, license_scan, merkle, near_dedup, packing
from emberwatch.llm import prefix_trie, quality_classifier, quality_rules, sentencepiece_codec, sharding
from emberwatch.llm.common import pick

FOLDER = "/root/testdata/sf0.001"
NAMES = ["DOC_ID", "Text", "slice", "score", "__score", "row", "k", "rank", "label", "c0", "doc", "Source", "N_Chars", "__id", "`odd. name`"]


@pytest.fixture(scope="module")
def clean(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)


@pytest.fixture(scope="module")
def clashing(clean):
    """The columns of documents, and others whose names differ in case only or are used inside."""
    df = clean
    names = clean.columns + NAMES
    return df.select(*clean.columns, *[clean["lang"]] * len(NAMES)).toDF(*names)


TABLES = {
    "op3": sharding.shard_documents, "op4": quality_rules.quality_rules, "op5": fingerprints.document_fingerprints,
    "op7": near_dedup.near_duplicates, "op8": packing.pack_documents, "op9": sentencepiece_codec.codec_digests,
    "op10": license_scan.scan_licenses, "op12": bpe_codec.bpe_digests,
    "op13": lambda docs: merkle.prove(merkle.build_manifest(docs, merkle.without_line_feeds())),
}


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(TABLES))
def test_documents(clean, clashing, name):
    assert rows(TABLES[name](clashing)) == rows(TABLES[name](clean))


def test_classifier(spark, clean, clashing):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    wide = labels.select(*labels.columns, labels["toxic"], labels["toxic"]).toDF(*labels.columns, "Quality", "DOC_ID")
    model, other = (quality_classifier.fit_quality(d, x) for d, x in ((clean, labels), (clashing, wide)))
    assert rows(quality_classifier.score_quality(clean, model)) == rows(quality_classifier.score_quality(clashing, other))


def test_conversations_and_pages(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    wide = turns.select(*turns.columns, turns["role"], turns["text"], turns["turn"]).toDF(*turns.columns, "Text", "digest", "depth")
    for operator in (lambda t: chat_format.conversation_digests(chat_format.format_windows(t)), prefix_trie.conversation_trie):
        assert rows(operator(wide)) == rows(operator(turns))
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").limit(10)
    wide = pages.select(*pages.columns, pages["url"], pages["url"]).toDF(*pages.columns, "HTML", "text")
    assert rows(html_extract.extract_pages(wide)) == rows(html_extract.extract_pages(pages))


@pytest.mark.parametrize("number", range(4))
def test_pipeline_stages(spark, clean, clashing, number):
    name, stage = cp.STAGES[number]
    got, want = stage(spark, clashing, FOLDER), stage(spark, clean, FOLDER)
    if name == "pack":
        assert rows(got) == rows(want)
    else:
        assert got.columns == clashing.columns
        assert rows(pick(got, *clean.columns)) == rows(want)
