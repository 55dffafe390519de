"""Corpus pipeline over documents: quality classifier, quality rules, near-duplicates, packing.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of documents. Between
stages the rows are written to the shared folder and read back. Columns are found by their exact names and kept by their
places, so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import WORD, by_place, read
from emberwatch.llm.near_dedup import survivors, text_sha
from emberwatch.llm.packing import pack_documents
from emberwatch.llm.quality_classifier import fit_quality, held_out, keep_scored
from emberwatch.llm.quality_rules import keep_good
from emberwatch.plans.durable import durable


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = read(spark, sf_dir, "labels").where(~held_out())
    return keep_scored(docs, fit_quality(docs, labels))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, and every row without words.

    Groups are made of texts, so rows of one doc_id or of none stay apart unless their texts are near. ``survivors`` defines
    the doc_id and text that stay; of rows equal in both the first by the remaining columns, nulls first.
    """
    rows, (doc_id, text) = by_place(docs, "doc_id", "text")
    chosen = survivors(docs).select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (text_sha(text) == F.col("__sha"))
    kept = rows.join(chosen, same).groupBy("__id", "__sha").agg(F.min(F.struct(*rows.columns)).alias("row")).select("row.*")
    return kept.union(rows.where(~F.coalesce(text, F.lit("")).rlike(WORD))).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places in packed sequences."""
    return pack_documents(docs)


STAGES = [("classify", classify), ("rules", rules), ("near_dedup", near_dedup), ("pack", pack)]

# A fitted classifier and byte-pair encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
