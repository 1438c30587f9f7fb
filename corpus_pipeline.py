"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Rows, defined results of the whole: a null text and a text without words or
lines are rejected by the classifier; a null id is an id that no group of
duplicates has, so its document passes that stage; rows with one id and equal
texts are one document to the duplicates and stay or go together; ties are
settled by the smallest id; an empty table gives an empty table; of other
columns only ``COLUMNS`` are read, whatever the others are named. Every stage's
operator states its own cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, crf, line_dedup, mixing, ngram_join
from orrery.runtime import attach, forget, read_table, spill_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of duplicates (some 24 bytes each in a hash table) up to which they are broadcast.
BROADCAST_IDS = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labelled ones of the folder, doesn't reject (null and blank texts go)."""
    attach(spark)
    raw = read_table(spark, sf_dir, "documents")
    model = crf.train(raw, read_table(spark, sf_dir, "labels"))
    return crf.filter_quality(docs.select(*COLUMNS), model)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents of their source share; no source or no text: as they are."""
    attach(spark)
    out = line_dedup.drop_boilerplate(docs.select(*COLUMNS), F.col("source"), ratio=0.05, min_pages=2)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of connected near copies, and all that are in none."""
    attach(spark)
    gone = spill_table(ngram_join.ngram_join(docs, t=0.5).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")), "gone")
    if gone.count() <= BROADCAST_IDS:  # else texts are shuffled to them
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked mix of sources, languages and topics; those of no words go."""
    attach(spark)
    return mixing.mix_sources(docs.select(*COLUMNS), extra=False).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    attach(spark)
    return bpe.round_trip(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", line_frequency),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]

#: The classifier is a trained model: no SQL. tests/llm/test_pipeline.py holds every stage against a brute-force version in plain Python, the trained model being given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    attach(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = spill_table(stage(spark, docs, sf_dir), name)
        forget(docs)  # the table of the stage before
        docs = done
    return docs
