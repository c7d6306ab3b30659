"""Lexicons and feature tables from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import strip


def read_words(spark: SparkSession, path: str, min_count: int = 0) -> DataFrame:
    """word, count from lines of a word and, behind a blank, how often it was seen (1 if it isn't told)."""
    parts = F.split(strip(F.col("value")), r"\s+")
    count = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("long"), F.lit(1))
    return spark.read.text(path).select(parts[0].alias("word"), count.alias("count")).where((F.col("word") != "") & (F.col("count") >= min_count))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """feature: one to a line."""
    return spark.read.text(path).select(strip(F.col("value")).alias("feature")).where("feature <> ''").distinct()


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """feature, weight of tab-separated lines, the highest weight of each feature; lines that can't be read are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(strip(parts[0]).alias("feature"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("weight"))
    return rows.where("weight is not null").groupBy("feature").agg(F.max("weight").alias("weight"))
