"""Bigrams and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import split_words

MIN_FREQUENCY = 5


def bigrams(sents: DataFrame, min_frequency: int = MIN_FREQUENCY, tokens: Column | None = None) -> DataFrame:
    """w0, w1, frequency of adjacent tokens; ``tokens`` is any expression that gives an array of them."""
    t = sents.select((split_words("sent") if tokens is None else tokens).alias("toks"))
    pairs = F.transform(F.slice("toks", 1, F.size("toks") - 1), lambda x, i: F.struct(x.alias("w0"), F.element_at("toks", i + 2).alias("w1")))
    return t.select(F.inline_outer(F.when(F.size("toks") > 1, pairs))).where("w0 is not null").groupBy("w0", "w1").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= min_frequency)


def slot_counts(pairs: DataFrame) -> DataFrame:
    """w, slots: places that a word takes in the surviving bigrams (not its frequency)."""
    return pairs.select(F.explode(F.array("w0", "w1")).alias("w")).groupBy("w").agg(F.count("*").alias("slots"))


def extract(pairs: DataFrame, score: str = "pmi", threshold: float = 0.0, topk: int = -1, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """w0, w1, frequency, score with score 'frequency', 'pmi' or 'mikolov'; the topk best ones if topk > 0."""
    if score == "frequency":
        out = pairs.withColumn("score", F.col("frequency").cast("double"))
    elif score in ("pmi", "mikolov"):
        slots = slot_counts(pairs)
        both = pairs.join(slots.select(F.col("w").alias("w0"), F.col("slots").alias("u0")), "w0").join(slots.select(F.col("w").alias("w1"), F.col("slots").alias("u1")), "w1")
        base = F.col("u0") * F.col("u1")
        if score == "pmi":
            total = pairs.agg((2 * F.sum("frequency")).alias("total"))
            both = both.crossJoin(F.broadcast(total))  # one row
            both = both.withColumn("score", F.log(F.col("total") * F.col("frequency") / base))
        else:
            both = both.withColumn("score", (F.col("frequency") - min_frequency) / base)
        out = both.select("w0", "w1", "frequency", "score")
    else:
        raise ValueError(f"unknown score {score}")
    out = out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), "w0", "w1").limit(topk) if topk > 0 else out
