"""Eojeol counts and the L-R graph, which is only a view of them: every (l, r) belongs to the one eojeol l + r."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.corpus import token_counts


def eojeol_counts(sents: DataFrame, max_length: int = 15, min_count: int = 1, column: str = "sent") -> DataFrame:
    """eojeol, count."""
    t = token_counts(sents, column).where(F.length("tok") <= max_length)
    return t.where(F.col("n") >= min_count).select(F.col("tok").alias("eojeol"), F.col("n").alias("count"))


def summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("unique"))


def remove_covered(counts: DataFrame, covered: DataFrame) -> DataFrame:
    """Counts without the eojeols of ``covered``."""
    return counts.join(covered.select("eojeol"), "eojeol", "left_anti")


def coverage(counts: DataFrame, left: DataFrame) -> DataFrame:
    """Share of occurrences that are no longer in ``left``."""
    a, b = summary(counts), summary(left).select(F.col("total").alias("rest"), F.col("unique").alias("unique_rest"))
    return a.crossJoin(b).select("total", "rest", "unique_rest", F.when(F.col("total") == 0, 0.0).otherwise(1 - F.col("rest") / F.col("total")).alias("coverage"))


def lr_graph(counts: DataFrame, l_max: int = 10, r_max: int = 9) -> DataFrame:
    """l, r, count for every split with a non-empty l of up to l_max and an r of up to r_max characters."""
    n = F.length("eojeol")
    lo, hi = F.greatest(F.lit(1), n - r_max), F.least(F.lit(l_max), n)
    return counts.where((n > 0) & (lo <= hi)).select("count", "eojeol", F.explode(F.sequence(lo, hi)).alias("i")).select(
        F.expr("substr(eojeol, 1, i)").alias("l"), F.expr("substr(eojeol, i + 1)").alias("r"), "count"
    )


def inverse(graph: DataFrame) -> DataFrame:
    return graph.where("r <> ''").select("r", "l", "count")


def top_r(graph: DataFrame, topk: int) -> DataFrame:
    """l, r, count, rank: the most frequent r of each l; all of them for topk <= 0."""
    w = Window.partitionBy("l").orderBy(F.desc("count"), "r")
    out = graph.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= topk) if topk > 0 else out


def top_l(graph: DataFrame, topk: int) -> DataFrame:
    w = Window.partitionBy("r").orderBy(F.desc("count"), "l")
    out = inverse(graph).withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= topk) if topk > 0 else out


def add_pairs(graph: DataFrame, more: DataFrame) -> DataFrame:
    return graph.unionByName(more).groupBy("l", "r").agg(F.sum("count").alias("count"))


def remove_pairs(graph: DataFrame, gone: DataFrame) -> DataFrame:
    """Counts less those of ``gone``; pairs at zero or below disappear, unknown ones are ignored."""
    g = gone.groupBy("l", "r").agg(F.sum("count").alias("gone"))
    left = graph.join(g, ["l", "r"], "left").withColumn("count", F.col("count") - F.coalesce("gone", F.lit(0)))
    return left.where("count > 0").select("l", "r", "count")


def to_counts(graph: DataFrame) -> DataFrame:
    return graph.groupBy(F.concat("l", "r").alias("eojeol")).agg(F.max("count").alias("count"))


def filtered_graph(counts: DataFrame, l_max: int = 10, r_max: int = 6, min_frequency: int = 10) -> DataFrame:
    """Pairs whose l and whose r are both frequent enough; r = '' needs no frequency."""
    g = lr_graph(counts, l_max, r_max)
    l_ok = g.groupBy("l").agg(F.sum("count").alias("n")).where(F.col("n") >= min_frequency).select("l")
    r_ok = g.where("r <> ''").groupBy("r").agg(F.sum("count").alias("n")).where(F.col("n") >= min_frequency).select("r")
    kept = g.join(l_ok, "l", "left_semi")
    return kept.where("r = ''").unionByName(kept.where("r <> ''").join(r_ok, "r", "left_semi").select("l", "r", "count"))


def conditional(graph: DataFrame) -> DataFrame:
    """l, r, count, l_count, p: P(r | l)."""
    total = F.sum("count").over(Window.partitionBy("l"))
    return graph.withColumn("l_count", total).withColumn("p", F.col("count") / F.col("l_count")).select("l", "r", "count", "l_count", "p")


def l_statistics(graph: DataFrame) -> DataFrame:
    """l, l_count, cohesion_l and droprate_l against the prefix that is one character shorter."""
    lc = graph.groupBy("l").agg(F.sum("count").alias("l_count"))
    heads = lc.where(F.length("l") == 1).select(F.col("l").alias("head"), F.col("l_count").alias("head_n"))
    shorter = lc.select(F.col("l").alias("sub"), F.col("l_count").alias("sub_n"))
    both = lc.join(heads, F.substring("l", 1, 1) == F.col("head"), "left").join(shorter, F.expr("substr(l, 1, length(l) - 1)") == F.col("sub"), "left")
    n = F.length("l")
    return both.select(
        "l", "l_count",
        F.when((n > 1) & F.col("head_n").isNotNull(), F.pow(F.col("l_count") / F.col("head_n"), 1 / (n - 1))).otherwise(0.0).alias("cohesion_l"),
        F.when((n > 1) & F.col("sub_n").isNotNull(), F.col("l_count") / F.col("sub_n")).otherwise(0.0).alias("droprate_l"),
    )


def hits(graph: DataFrame, damping: float = 0.9, iterations: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """side, word, rank: mutual ranks on the bipartite graph, each side's ranks spread in proportion to the counts.

    Lineage is cut by a checkpoint in each round.
    """
    g = graph.where("r <> ''")
    out_l, out_r = F.sum("count").over(Window.partitionBy("l")), F.sum("count").over(Window.partitionBy("r"))
    g = g.withColumn("to_r", F.col("count") / out_l).withColumn("to_l", F.col("count") / out_r)
    g = cut(g)
    ranks = g.select("l").distinct().withColumn("rank", F.lit(1.0))
    total = ranks.count()
    for _ in range(iterations):
        r = g.join(ranks, "l").groupBy("r").agg((F.sum(F.col("to_r") * F.col("rank")) * damping + (1 - damping)).alias("rank"))
        new = g.join(r, "r").groupBy("l").agg((F.sum(F.col("to_l") * F.col("rank")) * damping + (1 - damping)).alias("rank"))
        new = cut(new)
        moved = new.alias("a").join(ranks.alias("b"), "l").agg(F.sum(F.abs(F.col("a.rank") - F.col("b.rank")))).first()[0] or 0.0
        ranks = new
        if moved < tolerance * total:
            break
    r = g.join(ranks, "l").groupBy("r").agg((F.sum(F.col("to_r") * F.col("rank")) * damping + (1 - damping)).alias("rank"))
    return ranks.select(F.lit("L").alias("side"), F.col("l").alias("word"), "rank").union(r.select(F.lit("R"), "r", "rank"))


def write_graph_text(graph: DataFrame, path: str) -> None:
    """path/lrgraph and path/rlgraph: for each key a line '> key (sum)' and its partners '  - key: count', by descending count."""
    for name, key, other in (("lrgraph", "l", "r"), ("rlgraph", "r", "l")):
        g = (graph if name == "lrgraph" else graph.where("r <> ''")).groupBy(key).agg(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), F.col(other).alias("w")))).alias("x"))
        lines = F.concat_ws("\n", F.concat(F.lit("> "), key, F.lit(" ("), F.col("n").cast("string"), F.lit(")")), F.transform("x", lambda p: F.concat(F.lit("  - "), p["w"], F.lit(": "), (-p["c"]).cast("string"))))
        g.select(lines.alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def read_graph_text(spark: SparkSession, path: str) -> DataFrame:
    """l, r, count from what ``write_graph_text`` wrote; a key and its partners are one record."""
    blocks = spark.read.option("lineSep", "\n> ").text(f"{path}/lrgraph").select(F.split(F.regexp_replace("value", r"^> |\n+$", ""), "\n").alias("x"))
    rows = blocks.select(F.regexp_extract(F.col("x")[0], r"^(.*) \(\d+\)$", 1).alias("l"), F.explode(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0)))).alias("line"))
    return rows.select("l", F.regexp_extract("line", r"^  - (.*): \d+$", 1).alias("r"), F.regexp_extract("line", r"(\d+)$", 1).cast("long").alias("count"))
