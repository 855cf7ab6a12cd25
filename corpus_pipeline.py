"""The training-data pipeline: each stage works on all rows that the one before it kept.

ORACLE_SQL is None: language ID and the mix cannot be expressed in SQL; tests hold the stages against brute force.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any
name, and returns the columns of documents (the last one digests): language ID drops documents without a recognised
language, so null texts, empty ones, texts without letters and texts in scripts that were not learned go there; exact dedup keeps one of rows that repeat a
doc_id and text, and the largest doc_id of equal texts (a null doc_id is the smallest); near-dedup keeps rows with a null
doc_id and the smallest doc_id of a group, ties being impossible; the mix takes a null source as a source of its own and
repeats rows; encoding returns a row for each row. An empty table gives an empty table.

Stages look for what goes by ids, digests and sizes. The ids (or copies) that a stage has found are broadcast to the texts
where they are few, so the texts are filtered where they are read; beyond that bound they meet them in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm import bpe_tree, cuckoo, langid, minhash, mixing
from motifloom.llm._common import documents, held_out, materialize


#: Rows of whole texts are large: smaller Arrow batches keep the memory of executors and their Python workers low.
ARROW_ROWS = "1000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """For what is computed inside the block."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, ARROW_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (1): drops documents without a recognised language."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.identified(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (5): of equal texts the row with the largest doc_id stays."""
    return cuckoo.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (3), five-word shingles, similarity 0.8: the smallest doc_id of each group stays."""
    with _small_batches(spark):
        return minhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (8): documents are repeated or left out by pivotal rounding."""
    return mixing.resampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE encoding and decoding (6): the digests of each document's ids and decoded bytes."""
    with _small_batches(spark):  # the digests are narrow, so they are written here
        return materialize(bpe_tree.encoding_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("BPE encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
