"""Document-term vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import split_words
from ..session import cut


def _dense_index(terms: DataFrame, by: str) -> DataFrame:
    """idx from 0 by descending count, then term, without a single-partition window.

    Ranges are sorted in parallel; each partition's offset comes from the sizes of the
    partitions before it.
    """
    placed = terms.repartitionByRange(F.desc(by), F.col("term")).sortWithinPartitions(F.desc(by), "term").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed)  # read twice, and ranges that are drawn twice may differ
    first = placed.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    base = first.withColumn("base", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(base.select("part", "first", "base")), "part").select((F.col("place") - F.col("first") + F.col("base")).alias("idx"), *terms.columns)


def analyse(docs: DataFrame, lowercase: bool = False, stopwords: DataFrame | None = None, tokens: Column | None = None) -> DataFrame:
    """doc_id, pos, term; lower case and stop words only if asked for."""
    text = F.lower("text") if lowercase else F.col("text")
    out = docs.select("doc_id", F.posexplode_outer(split_words(text) if tokens is None else tokens).alias("pos", "term")).where("term is not null")
    return out.join(stopwords.select("term"), "term", "left_anti").select("doc_id", "pos", "term") if stopwords is not None else out


def fit(terms: DataFrame, n_docs: DataFrame, min_tf: int = 0, max_tf: int = 1 << 62, min_df: float = 0.0, max_df: float = 1.0) -> DataFrame:
    """idx, term, df: the vocabulary.  A term counts once for each document; n_docs: one row, column n."""
    df = terms.select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    band = df.crossJoin(F.broadcast(n_docs)).where(  # one row
        (F.col("df") >= F.floor(F.col("n") * min_df)) & (F.col("df") <= F.floor(F.col("n") * max_df)) & F.col("df").between(min_tf, max_tf)
    )
    return _dense_index(band.select("term", "df"), "df")


def transform(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, idx, n: the coordinates of the document-term matrix."""
    per = terms.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return per.join(vocabulary.select("term", "idx"), "term").select("doc_id", "idx", "n")


def encode_list(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, ids in token order; unknown terms are left out."""
    known = terms.join(vocabulary.select("term", "idx"), "term")
    return known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("p")).select("doc_id", F.col("p.idx").alias("ids"))


def decode_list(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, terms; unknown numbers are left out."""
    e = encoded.select("doc_id", F.posexplode("ids").alias("pos", "idx")).join(vocabulary.select("term", "idx"), "idx")
    return e.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("p")).select("doc_id", F.col("p.term").alias("terms"))


def encode_bow(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, bow: map of idx to count."""
    return transform(terms, vocabulary).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "n")))).alias("bow"))


def decode_bow(bow: DataFrame, vocabulary: DataFrame) -> DataFrame:
    e = bow.select("doc_id", F.explode("bow").alias("idx", "n")).join(vocabulary.select("term", "idx"), "idx")
    return e.select("doc_id", "term", "n")


def matrix_market(matrix: DataFrame, rows: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(header lines, body lines) of a coordinate file; documents are numbered by the order of their id."""
    ids = _dense_index(matrix.select(F.col(rows).alias("term")).distinct().withColumn("none", F.lit(0)), "none").select((F.col("idx") + 1).alias("i"), F.col("term").alias(rows))
    body = matrix.join(ids, rows).select("i", (F.col("idx") + 1).alias("j"), "n")
    size = body.agg(F.coalesce(F.max("i"), F.lit(0)).alias("i"), F.coalesce(F.max("j"), F.lit(0)).alias("j"), F.count("*").alias("nnz"))
    head = size.select(F.explode(F.array(F.lit("%%MatrixMarket matrix coordinate integer general"), F.lit("%"), F.concat_ws(" ", "i", "j", "nnz"))).alias("value"))
    return head, body


def write_matrix_market(matrix: DataFrame, path: str) -> None:
    """path/header and path/body (many parts); put together they are one coordinate file."""
    head, body = matrix_market(matrix)
    head.coalesce(1).write.mode("overwrite").text(f"{path}/header")
    body.select(F.concat_ws(" ", "i", "j", "n").alias("value")).write.mode("overwrite").text(f"{path}/body")


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """One term to a line, the line's number is its index."""
    vocabulary.orderBy("idx").select(F.col("term").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("idx", "term"))
