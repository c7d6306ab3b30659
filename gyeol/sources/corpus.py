"""Corpora: documents, sentences, tokens and token counts; readers and writers of the text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import split_words, strip


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sentences(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_id, sent_id, sent: the non-blank parts of each text, numbered from 0 with blank ones counted."""
    parts = F.transform(F.split("text", separator), strip)
    return docs.select("doc_id", F.posexplode_outer(parts).alias("sent_id", "sent")).where("sent <> ''")  # outer: else a filter evaluates the parts once more


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0 within the file), value: lines are read in parallel, a file isn't one row.

    Each split's first number comes from the sizes of the splits before it in its file.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("block", F.input_file_block_start()).withColumn("place", F.monotonically_increasing_id())
    size = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = size.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("base"))
    return lines.join(base, ["file", "block"]).select("file", (F.col("place") - F.col("first") + F.col("base")).alias("line"), "value")


def read_doublespace(spark: SparkSession, path: str, iter_sent: bool = False, skip_header: int = 0, num_doc: int = -1, num_sent: int = -1) -> DataFrame:
    """A line is a document, two spaces end a sentence.

    Documents: doc_id, text.  Sentences: doc_id, sent_id, sent without blank ones.  Lines
    are numbered within the file, so the header and the caps follow file order.
    """
    lines = numbered_lines(spark, path).where(F.col("line") >= skip_header).select(F.col("line").alias("doc_id"), strip(F.col("value")).alias("text"))
    if not iter_sent:
        return lines.orderBy("doc_id").limit(num_doc) if num_doc > 0 else lines
    sents = sentences(lines, "  ")
    return sents.orderBy("doc_id", "sent_id").limit(num_sent) if num_sent > 0 else sents


def corpus_length(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """num_doc and num_sent (non-blank sentences)."""
    n = F.size(F.filter(F.split("text", separator), lambda s: strip(s) != ""))
    return docs.agg(F.count("*").alias("num_doc"), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), n)), F.lit(0)).cast("long").alias("num_sent"))


def check_corpus(df: DataFrame, column: str = "text") -> DataFrame:
    """Raise unless there is the column and a row."""
    if column not in df.columns:
        raise ValueError(f"a corpus needs a column {column}")
    if df.isEmpty():
        raise ValueError("a corpus must not be empty")
    return df


def token_table(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, pos, tok."""
    return sents.select("doc_id", "sent_id", F.posexplode_outer(split_words("sent")).alias("pos", "tok")).where("tok is not null")


def token_counts(sents: DataFrame, column: str = "sent") -> DataFrame:
    """tok, n: the table that every sub-word statistic expands, once for each distinct token."""
    return sents.select(F.explode_outer(split_words(column)).alias("tok")).where("tok is not null").groupBy("tok").agg(F.count("*").alias("n"))


def write_counts(df: DataFrame, path: str, order: list[Column], columns: list[str]) -> None:
    """Space-separated lines in a total order."""
    df.orderBy(*order).select(F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", " ")
    return spark.read.text(path).select(p[0].alias("eojeol"), p[1].cast("long").alias("count"))


def sorted_lines(spark: SparkSession, path: str, out: str) -> DataFrame:
    """A text file's non-blank lines, stripped and sorted, written to another path."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''").orderBy("value")
    lines.write.mode("overwrite").text(out)
    return lines
