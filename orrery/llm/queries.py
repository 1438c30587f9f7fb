"""Queries over the driver's tables, one per operator, each with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, crf, hamming, lattice, licenses, line_dedup, mixing, ngram_join, omh, oracles, token_count
from orrery.runtime import attach, read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license detection of every document."""
    attach(spark)
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as text lines, without its site's boilerplate lines."""
    attach(spark)
    pages = read_table(spark, sf_dir, "pages")
    lines = pages.select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("text"))
    return line_dedup.drop_boilerplate(lines, F.col("host"), ratio=0.05, min_pages=2, dropped="dropped_lines")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document and its bad lines, by the field fitted on the labelled ones."""
    attach(spark)
    docs = read_table(spark, sf_dir, "documents")
    return crf.quality(docs, crf.train(docs, read_table(spark, sf_dir, "labels")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked mix of sources, languages and topics."""
    attach(spark)
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability")


def op5_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors, by the signs of their 64 coordinates, to every one whose id is divisible by 20."""
    attach(spark)
    rows = read_table(spark, sf_dir, "embeddings")
    return hamming.topk(rows, F.col("vec_id"), hamming.sign_code(F.col("embedding")), k=10, queries=F.col("vec_id") % 20 == 0)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document and decode it again: doc_id, token_ids, n_tokens, decoded (null texts: null, 0, null)."""
    attach(spark)
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document (null texts: null; empty ones: 0; a row for each row)."""
    attach(spark)
    return token_count.token_counts(read_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document over all its segmentations, by scores of the whole table (null texts: null; empty ones: 0)."""
    attach(spark)
    return lattice.lattice_scores(read_table(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen entries for every document, of 3 k-mers of 8 signs each (null texts: null; ties: the earlier k-mer)."""
    attach(spark)
    return omh.order_minhash(read_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document that is half or more like another by word trigrams (null and wordless texts: none)."""
    attach(spark)
    return ngram_join.ngram_join(read_table(spark, sf_dir, "documents"), t=0.5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_line_dedup, op3_quality, op4_mix_sources, op5_hamming_topk, op6_byte_bpe, op7_token_counts, op8_lm_scoring, op9_order_minhash, op10_ngram_join)
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": oracles.OP2, "op4_mix_sources": oracles.OP4, "op5_hamming_topk": oracles.OP5, "op10_ngram_join": oracles.OP10}
