"""A corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes all rows that the one before kept and returns the columns of documents, but for the last. Null texts count
as empty ones, repeated rows and null doc_ids are rows like any other unless a stage says so, texts are read whole, other
columns pass through whatever their names are, and a stage on an empty table returns an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import byte_bpe, containment, near_dup, quality, substring_dedup
from lattica.llm.common import read_table, remove, scratch, temporary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the graded documents among them, does not reject. Without grades all stay; equal
    texts share their fate."""
    return quality.keep_quality(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class of near-duplicates, one row of it. Documents without words, empty and
    null ones too, are one class; a class whose rows all lack a doc_id keeps one of them; of unlike texts under one doc_id each
    has a class of its own."""
    return near_dup.keep_one(docs, near_dup.near_duplicates(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur again; n_chars follows the text. A text of which
    nothing is left is empty; null texts stay null."""
    return substring_dedup.remove_repeats(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; empty and null ones contain none. Items of no words are in no text."""
    return containment.drop_contaminated(docs, containment.index_batches(read_table(spark, sf_dir, "benchmark"), "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of what is left, a row for every row."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("near_dup", one_of_near_duplicates), ("substring_dedup", without_repeats), ("decontamination", without_benchmarks), ("byte_bpe", tokens)]

#: Classifier, sampling and suffix sorting have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again by the next. What a stage writes on its
    way goes when its result is stored, and that when the next stage's is."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        with temporary(spark, name):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
