"""A corpus pipeline of five operators: each stage's result is written as Parquet and read again by the next.

Every function takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.

Defined cases, for every stage: a row is known by its doc_id and text, so of rows that share an id each text is judged on
its own, and rows equal in both count as one document (near_dedup keeps one of them).  Null and empty texts, and texts
without a letter, have no language and go in the first stage; rows without doc_id, if their language is known, take no
part in dedup and stay.  Null sources are a source of their own.  Texts of any length are read whole.  Ties go to the
lowest doc_id, then the hash of the text.  An empty ``documents`` gives no rows, an empty ``benchmark`` takes nothing
out.  Further columns stay as they are, whatever they are called; n_chars follows the text.  What stages write goes once
the next one has read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gyeol.llm import decontam, langid, linededup, minhash, mixing
from gyeol.llm.common import remove, scratch, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the network can't tell."""
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that repeat an earlier line; a document without any other line goes."""
    return linededup.drop_lines(docs, linededup.repeated_lines(docs, with_h=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of tokens, mixed to the target weights."""
    return mixing.mix_sources(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: The first stage is a trained network, which SQL can't express; tests/llm compares the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k:
            remove(spark, f"{out}/{k - 1}")
    return docs
