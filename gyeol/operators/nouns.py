"""Noun extraction from L-R statistics.

Everything works on the ``eojeol, count`` table.  Whether some longer feature covers
(l, r) depends on the eojeol alone: a longer suffix of it is a feature.  So the longest
feature suffix of each class is found once for each eojeol, and every prediction is one
aggregation by l.

Longest-first prediction runs one round for each length: words of equal length never
share an eojeol, so all of a length are scored together, and the accepted ones take
their eojeols away by an anti-join.  Each round is cut by a checkpoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hangul import normalize_sent_for_lrgraph
from ..session import cut, drop
from .lrgraph import eojeol_counts, lr_graph
from .tokenize import _tasks, dictionary, max_score


def features(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """feature, class ('pos', 'neg' or 'common', which are in both)."""
    p, n = pos.select("feature").distinct(), neg.select("feature").distinct().withColumnRenamed("feature", "other")
    both = p.join(n, F.col("feature") == F.col("other"), "full_outer")
    kind = F.when(F.col("other").isNull(), "pos").when(F.col("feature").isNull(), "neg").otherwise("common")
    return both.select(F.coalesce("feature", "other").alias("feature"), kind.alias("class"))


def max_weights(weights: DataFrame) -> DataFrame:
    """feature, weight: the highest weight of a feature."""
    return weights.groupBy("feature").agg(F.max("weight").alias("weight"))


def marked(counts: DataFrame, feats: DataFrame) -> DataFrame:
    """eojeol, count, long_pos, long_neg: lengths of its longest suffix in either class, 0 for none."""
    n = F.length("eojeol")
    suffix = counts.where(n > 0).select("eojeol", F.explode(F.sequence(F.lit(1), n)).alias("k")).select("eojeol", "k", F.right("eojeol", F.col("k")).alias("feature"))
    hit = suffix.join(feats.where("class <> 'common'"), "feature")
    per = hit.groupBy("eojeol").agg(F.max(F.when(F.col("class") == "pos", F.col("k"))).alias("p"), F.max(F.when(F.col("class") == "neg", F.col("k"))).alias("n"))
    return counts.join(per, "eojeol", "left").select("eojeol", "count", F.coalesce("p", F.lit(0)).alias("long_pos"), F.coalesce("n", F.lit(0)).alias("long_neg"))


def _splits(table: DataFrame, l_max: int, r_max: int, only: int | None = None) -> DataFrame:
    n = F.length("eojeol")
    lo, hi = F.greatest(F.lit(1), n - r_max), F.least(F.lit(l_max), n)
    cuts = table.where((n > 0) & (lo <= hi))
    cuts = cuts.where(F.lit(only).between(lo, hi)).withColumn("i", F.lit(only)) if only else cuts.withColumn("i", F.explode(F.sequence(lo, hi)))
    return cuts.withColumn("l", F.expr("substr(eojeol, 1, i)")).withColumn("r", F.expr("substr(eojeol, i + 1)")).drop("i")


def candidates(splits: DataFrame, feats: DataFrame) -> DataFrame:
    """l, n: prefixes that some positive feature follows, with how often."""
    pos = feats.where("class = 'pos'").select(F.col("feature").alias("r"))
    return splits.join(pos, "r", "left_semi").groupBy("l").agg(F.sum("count").alias("n"))


def predict(splits: DataFrame, feats: DataFrame, min_noun_score: float = 0.3, min_num_of_features: int = 1, max_frequency_when_noun_is_eojeol: int = 30) -> DataFrame:
    """l, pos, common, neg, unk, end, n_features, n_first, support, score; splits: l, r, count, long_pos, long_neg."""
    s = splits.join(feats.select(F.col("feature").alias("r"), "class"), "r", "left").withColumn("size", F.length("r"))
    kind, count = F.coalesce("class", F.lit("unk")), F.col("count")
    longer_pos, longer_neg = F.col("long_pos") > F.col("size"), F.col("long_neg") > F.col("size")
    counted = (F.col("r") != "") & ~longer_pos & ~longer_neg
    total = lambda c: F.coalesce(F.sum(F.when(c, count)), F.lit(0))
    own = ((kind == "pos") & ~longer_pos) | ((kind == "neg") & ~longer_neg)
    first = (F.col("r") != "") & (kind.isin("neg", "unk") | ~longer_pos)
    g = s.groupBy("l").agg(
        *[total(counted & (kind == k)).alias(k) for k in ("pos", "common", "neg", "unk")],
        total(F.col("r") == "").alias("end"),
        F.count(F.when((F.col("r") != "") & own, 1)).alias("n_features"),
        F.count_distinct(F.when(first, F.substring("r", 1, 1))).alias("n_first"),
    )
    pos, common, neg, end = (F.col(c) for c in ("pos", "common", "neg", "end"))
    everything = pos + common + neg + F.col("unk") + end
    base = F.when(pos + neg == 0, 0.0).otherwise((pos - neg) / (pos + neg))
    support = F.when(base >= min_noun_score, pos + end + common).otherwise(neg + end + common)
    good = pos + common + end
    enough = F.col("n_features") > min_num_of_features
    frequent = (end > max_frequency_when_noun_is_eojeol) & (pos >= neg)
    whole = ((common > 0) | (pos > 0)) & (end / everything >= 0.3) & (common >= neg)
    by_share = ~enough & (everything > 0) & ~frequent & (whole | (F.col("n_first") >= 2))
    score = F.when(enough, base).when(everything == 0, 0.0).when(frequent, base).when(by_share, good / everything).otherwise(0.0)
    return g.withColumn("support", F.when(by_share, good).otherwise(support)).withColumn("score", score)


def predict_longest_first(counts: DataFrame, feats: DataFrame, l_max: int = 10, r_max: int = 9, min_noun_score: float = 0.3, **options: int) -> tuple[DataFrame, DataFrame]:
    """(l, support, score of every candidate; the eojeols that no accepted word took)."""
    left = cut(marked(counts, feats))
    wanted = cut(candidates(_splits(left, l_max, r_max), feats).select("l"))
    done = None
    for k in range(l_max, 0, -1):
        before = left
        at = _splits(left, l_max, r_max, k)
        seen = predict(at.join(wanted, "l", "left_semi"), feats, min_noun_score, **options).select("l", "support", "score")
        # a candidate whose eojeols are all gone has nothing to be scored by
        seen = cut(wanted.where(F.length("l") == k).join(seen, "l", "left").select("l", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("score", F.lit(0.0)).alias("score")))
        done = seen if done is None else done.union(seen)
        taken = seen.where(F.col("score") >= min_noun_score).select(F.col("l").alias("noun"))
        n = F.length("eojeol")
        left = cut(left.join(taken, (F.expr(f"substr(eojeol, 1, {k})") == F.col("noun")) & (n >= k) & (n <= k + r_max), "left_anti"))
        drop(before)
    return done, left.select("eojeol", "count")


def parse_compound(pieces: list, josa: set[str]) -> list[str] | None:
    """The parts of a compound of nouns, with or without a particle behind it; None if it isn't one."""
    *front, last = pieces
    if any(p[3] <= 0 for p in front):
        return None
    if len(pieces) >= 3 and last[0] in josa:
        return [p[0] for p in front]
    return [p[0] for p in pieces] if last[3] > 0 else None


def may_be_compound(word: str, nouns: dict[str, float], josa: set[str]) -> bool:
    """Whether a noun is in front, and a noun or a particle at the end: without, there is no compound, and nothing to cut."""
    n = len(word)
    return any(word[:e] in nouns for e in range(2, n)) and any(word[b:] in nouns or word[b:] in josa for b in range(2, n))


def compounds(counts: DataFrame, scored: DataFrame, feats: DataFrame, l_max: int = 10, r_max: int = 9, min_noun_score: float = 0.3) -> DataFrame:
    """noun, parts, frequency, score of compounds of accepted nouns.

    The nouns are sent to the tasks, at most tokenize.MAX_ENTRIES of them.
    """
    scored = cut(scored.select("l", "score"))  # read three times
    nouns = scored.where((F.col("score") > min_noun_score) & (F.length("l") > 1)).select("l", F.length("l").cast("double").alias("weight"), "score")
    weight, value = dictionary(nouns.select("l", "weight")), dictionary(scored.select("l", "score"))
    josa = set(dictionary(feats.where("class = 'pos'").select("feature")))
    words = lr_graph(counts, l_max, r_max).where(F.length("l") >= 4).groupBy("l").agg(F.coalesce(F.sum(F.when(F.col("r") == "", F.col("count"))), F.lit(0)).alias("n"))
    words = words.join(nouns.select("l"), "l", "left_anti").repartition(_tasks(words), "l")

    @F.pandas_udf("struct<parts:array<string>,score:double>")
    def split(c: pd.Series) -> pd.DataFrame:
        parts = [parse_compound(max_score(w, weight), josa) if may_be_compound(w, weight, josa) else None for w in c]
        return pd.DataFrame({"parts": parts, "score": [max(value.get(x, 0.0) for x in p) if p else None for p in parts]})

    found = words.withColumn("x", split.asNondeterministic()("l")).where("x.parts is not null")
    g = found.groupBy(F.array_join("x.parts", "").alias("noun")).agg(F.min("x.parts").alias("parts"), F.sum("n").alias("frequency"), F.max("x.score").alias("score"))
    return g.select("noun", "parts", "frequency", "score")


def _word_splits(nouns: DataFrame, least: int = 2) -> DataFrame:
    n = F.length("noun")
    return nouns.where(n > least).select("*", F.explode(F.sequence(F.lit(least), n - 1)).alias("i")).withColumn("l", F.expr("substr(noun, 1, i)")).withColumn("r", F.expr("substr(noun, i + 1)")).drop("i")


def detaching_features(nouns: DataFrame, feats: DataFrame) -> DataFrame:
    """Without noun + feature of two or more characters."""
    pos = feats.where("class = 'pos'").select(F.col("feature").alias("r"))
    bad = _word_splits(nouns.select("noun")).where(F.length("r") > 1).join(pos, "r", "left_semi").join(nouns.select(F.col("noun").alias("l")), "l", "left_semi").select("noun").distinct()
    return nouns.join(bad, "noun", "left_anti")


def ignore_features(nouns: DataFrame, feats: DataFrame) -> DataFrame:
    return nouns.join(feats.where("class in ('pos', 'common')").select(F.col("feature").alias("noun")), "noun", "left_anti")


def ignore_noun_josa(nouns: DataFrame, counts: DataFrame, josa: DataFrame, suffixes: DataFrame, min_num_of_josa: int = 5, l_max: int = 10, r_max: int = 9) -> DataFrame:
    """Without noun + particle whose noun is more frequent and has several particles."""
    j = josa.select(F.col("word").alias("r")).distinct()
    ends = j.join(suffixes.select(F.col("word").alias("r")), "r", "left_anti")
    several = lr_graph(counts, l_max, r_max).join(j, "r", "left_semi").groupBy("l").agg(F.count_distinct("r").alias("k")).where(F.col("k") >= min_num_of_josa).select("l")
    heads = nouns.select(F.col("noun").alias("l"), F.col("frequency").alias("head"))
    bad = _word_splits(nouns.select("noun", "frequency")).join(ends, "r", "left_semi").join(heads, "l").where(F.col("frequency") < F.col("head")).join(several, "l", "left_semi").select("noun").distinct()
    return nouns.join(bad, "noun", "left_anti")


def covered(counts: DataFrame, nouns: DataFrame, feats: DataFrame, l_max: int = 10, r_max: int = 9) -> DataFrame:
    """total, covered, coverage: occurrences of eojeols that start with a noun which is a candidate.

    A noun of one character covers only itself and what a positive or common feature follows.
    """
    s = _splits(counts, l_max, r_max)
    known = candidates(s, feats).select("l").join(nouns.select(F.col("noun").alias("l")), "l", "left_semi")
    easy = feats.where("class in ('pos', 'common')").select(F.col("feature").alias("r"), F.lit(True).alias("easy"))
    ok = s.join(known, "l", "left_semi").join(easy, "r", "left").where((F.length("l") > 1) | (F.col("r") == "") | F.col("easy"))
    hit = ok.select("eojeol", "count").distinct().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("covered"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return total.crossJoin(hit).select("total", "covered", F.when(F.col("total") == 0, 0.0).otherwise(F.col("covered") / F.col("total")).alias("coverage"))


def domain_features(counts: DataFrame, nouns: DataFrame, feats: DataFrame, min_score: float = 0.3, min_frequency: int = 1000, min_last_chars: int = 4, min_last_entropy: float = 0.5, min_noun_entropy: float = 1.5, l_max: int = 10, r_max: int = 9) -> DataFrame:
    """feature, score, frequency: unknown endings that behave like positive features after nouns.

    Shorter ones first, since an accepted ending explains longer ones: one round for each length.
    """
    s = _splits(counts, l_max, r_max).where("r <> ''")
    n = cut(nouns.select(F.col("noun").alias("l"))).withColumn("is_noun", F.lit(True))  # read in every round
    known = feats.where("class = 'pos'").select("feature")
    wanted = s.join(n, "l", "left_semi").groupBy("r").agg(F.sum("count").alias("k")).where(F.col("k") >= min_frequency)
    wanted = cut(wanted.join(known, F.col("r") == F.col("feature"), "left_anti").join(n, F.col("r") == n["l"], "left_anti").select("r"))
    # only what a wanted ending follows is looked at
    g = cut(s.join(wanted, "r", "left_semi").join(n, "l", "left").select("l", "r", "count", F.coalesce("is_noun", F.lit(False)).alias("is_noun")))
    out, entropy = None, lambda t: F.log(F.sum(t)) - F.sum(t * F.log(t)) / F.sum(t)
    for k in range(1, r_max + 1):
        part = g.where(F.length("r") == k)
        # noun + an accepted ending in front of r explains l
        tail = known if out is None else known.union(out.select("feature"))
        cuts = part.where(~F.col("is_noun")).select("l", "r", F.explode(F.sequence(F.lit(1), F.length("l"))).alias("i")).select("l", "r", F.expr("substr(l, 1, i)").alias("head"), F.expr("concat(substr(l, i + 1), r)").alias("feature"))
        noun_tail = cuts.join(n.select(F.col("l").alias("head")), "head", "left_semi").join(tail, "feature", "left_semi").select("l", "r").distinct().withColumn("explained", F.lit(True))
        part = cut(part.join(noun_tail, ["l", "r"], "left").where("explained is null").drop("explained"))  # read three times
        last = part.groupBy("r", F.right("l", F.lit(1)).alias("c")).agg(F.sum("count").cast("double").alias("n")).groupBy("r").agg(F.count("*").alias("chars"), entropy(F.col("n")).alias("char_entropy"))
        pos, neg = F.sum(F.when(F.col("is_noun"), F.col("count")).otherwise(0)), F.sum(F.when(F.col("is_noun"), 0).otherwise(F.col("count")))
        of = part.groupBy("r").agg(pos.alias("p"), neg.alias("m"))
        nn = part.where("is_noun").withColumn("n", F.col("count").cast("double")).groupBy("r").agg(entropy(F.col("n")).alias("noun_entropy"))
        ok = of.join(last, "r").join(nn, "r").withColumn("score", (F.col("p") - F.col("m")) / (F.col("p") + F.col("m"))).where(
            (F.col("chars") >= min_last_chars) & (F.col("char_entropy") >= min_last_entropy) & (F.col("noun_entropy") >= min_noun_entropy) & (F.col("score") >= min_score) & (F.col("p") >= min_frequency)
        )
        ok = cut(ok.select(F.col("r").alias("feature"), "score", F.col("p").alias("frequency")))
        drop(part)
        out = ok if out is None else out.union(ok)
    return out


class NounExtractor:
    """Nouns from positive and negative features; the features and particles are tables."""

    def __init__(self, feats: DataFrame, josa: DataFrame | None = None, suffixes: DataFrame | None = None, max_left_length: int = 10, max_right_length: int = 9, normalize: bool = False, extract_compound: bool = True, min_num_of_features: int = 1, max_frequency_when_noun_is_eojeol: int = 30):
        self.feats, self.josa, self.suffixes = feats, josa, suffixes
        self.l_max, self.r_max, self.normalize, self.extract_compound = max_left_length, max_right_length, normalize, extract_compound
        self.options = {"min_num_of_features": min_num_of_features, "max_frequency_when_noun_is_eojeol": max_frequency_when_noun_is_eojeol}

    def train(self, sents: DataFrame) -> DataFrame:
        """The eojeol counts of sentences."""
        if self.normalize:
            sents = sents.withColumn("sent", normalize_sent_for_lrgraph("sent"))
        return eojeol_counts(sents, self.l_max + self.r_max)

    def extract(self, counts: DataFrame, min_noun_score: float = 0.3, min_noun_frequency: int = 1) -> DataFrame:
        """noun, frequency, score."""
        counts = cut(counts)
        scored, self.rest = predict_longest_first(counts, self.feats, self.l_max, self.r_max, min_noun_score, **self.options)
        nouns = scored.where(F.col("score") >= min_noun_score).select(F.col("l").alias("noun"), F.col("support").alias("frequency"), "score")
        if self.extract_compound:
            more = compounds(counts, scored, self.feats, self.l_max, self.r_max, min_noun_score).select("noun", "frequency", "score")
            nouns = nouns.join(more.select("noun"), "noun", "left_anti").union(more)
        nouns = cut(nouns.where(F.col("frequency") >= min_noun_frequency))
        nouns = ignore_features(detaching_features(nouns, self.feats), self.feats)
        if self.josa is not None:
            none = self.josa.limit(0)
            nouns = ignore_noun_josa(nouns, counts, self.josa, none if self.suffixes is None else self.suffixes, l_max=self.l_max, r_max=self.r_max)
        return nouns

    def train_extract(self, sents: DataFrame, **thresholds: float) -> DataFrame:
        return self.extract(self.train(sents), **thresholds)


# --- by weighted features ---------------------------------------------------------------------


def weighted_graph(counts: DataFrame, l_max: int = 10, r_max: int = 7, min_frequency: int = 5) -> DataFrame:
    """l, r, count, eojeol: splits whose l and whose r (unless empty) are frequent prefixes and suffixes."""
    n = F.length("eojeol")
    lefts = counts.where(n > 0).select("count", F.expr(f"explode(transform(sequence(1, least({l_max}, length(eojeol))), i -> substr(eojeol, 1, i)))").alias("l")).groupBy("l").agg(F.sum("count").alias("l_n")).where(F.col("l_n") >= min_frequency)
    rights = counts.where(n > 1).select("count", F.expr(f"explode(transform(sequence(1, least({r_max}, length(eojeol) - 1)), i -> right(eojeol, i)))").alias("r")).groupBy("r").agg(F.sum("count").alias("k")).where(F.col("k") >= min_frequency).select("r")
    s = _splits(counts, l_max, r_max).join(lefts, "l")
    return s.where("r = ''").unionByName(s.where("r <> ''").join(rights, "r", "left_semi").select(*s.columns))


def weighted_score(graph: DataFrame, weights: DataFrame, min_num_of_features: int = 1) -> DataFrame:
    """l, score (mean weight of its features), known (share of known ones); 0 with too few kinds of r."""
    n = F.length("eojeol")
    eo = graph.select("eojeol").distinct()
    suffix = eo.select("eojeol", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("feature", F.right("eojeol", F.col("k")))
    longest = suffix.join(weights.select("feature"), "feature", "left_semi").groupBy("eojeol").agg(F.max("k").alias("longest"))
    s = graph.where("r <> ''").join(weights.select(F.col("feature").alias("r"), "weight"), "r", "left").join(longest, "eojeol", "left")
    known = F.col("weight").isNotNull() & (F.coalesce("longest", F.lit(0)) <= F.length("r"))
    g = s.groupBy("l").agg(F.count("*").alias("kinds"), F.sum(F.when(known, F.col("count") * F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(known, F.col("count"))), F.lit(0)).alias("norm"), F.coalesce(F.sum(F.when(F.col("weight").isNull(), F.col("count"))), F.lit(0)).alias("unknown"))
    enough = F.col("kinds") > min_num_of_features
    score = F.when(enough & (F.col("norm") > 0), F.col("w") / F.col("norm")).otherwise(0.0)
    ratio = F.when(enough & (F.col("norm") + F.col("unknown") > 0), F.col("norm") / (F.col("norm") + F.col("unknown"))).otherwise(0.0)
    return g.select("l", score.alias("score"), ratio.alias("known"))


def longest_noun_counts(graph: DataFrame, nouns: DataFrame) -> DataFrame:
    """noun, frequency: every eojeol counts for its longest noun."""
    hit = graph.join(nouns.select(F.col("noun").alias("l")), "l", "left_semi")
    best = hit.groupBy("eojeol").agg(F.max_by("l", F.length("l")).alias("noun"), F.max("count").alias("n"))
    per = best.groupBy("noun").agg(F.sum("n").alias("frequency"))
    return nouns.join(per, "noun", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def extract_weighted(counts: DataFrame, weights: DataFrame, min_noun_score: float = 0.5, min_frequency: int = 5, l_max: int = 10, r_max: int = 7, candidates: DataFrame | None = None) -> DataFrame:
    """noun, frequency, score, known_r_ratio; candidates (word) may name the words to look at."""
    graph = cut(weighted_graph(counts, l_max, r_max, min_frequency))
    nouns = weighted_score(graph, weights).where((F.length("l") > 1) & (F.col("score") >= min_noun_score)).select(F.col("l").alias("noun"), "score", "known")
    if candidates is not None:
        nouns = nouns.join(candidates.select(F.col("word").alias("noun")).distinct(), "noun", "left_semi")
    size = graph.groupBy("l").agg(F.max("l_n").alias("n"))
    head, shorter = size.select(F.col("l").alias("head"), F.col("n").alias("head_n")), size.select(F.col("l").alias("sub"), F.col("n").alias("sub_n"))
    n = F.length("noun")
    both = nouns.join(size.withColumnRenamed("l", "noun"), "noun").join(head, F.substring("noun", 1, 1) == F.col("head"), "left").join(shorter, F.expr("substr(noun, 1, length(noun) - 1)") == F.col("sub"), "left")
    rising = F.pow(F.col("n") / F.col("head_n"), 1 / (n - 1)) >= F.coalesce(F.pow(F.col("sub_n") / F.col("head_n"), 1 / (n - 2)), F.lit(0.0))
    falling = both.where((n > 2) & ~rising).select("noun")
    strong = weights.where(F.col("weight") > min_noun_score).select(F.col("feature").alias("r"))
    bad = _word_splits(falling).join(strong, "r", "left_semi").join(nouns.select(F.col("noun").alias("l")), "l", "left_semi").select("noun").distinct()
    kept = nouns.where(~F.right("noun", F.lit(1)).isin(".", ",")).join(bad, "noun", "left_anti")
    return longest_noun_counts(graph, kept).select("noun", "frequency", "score", F.col("known").alias("known_r_ratio"))


def is_noun(words: DataFrame, extracted: DataFrame, min_noun_score: float = 0.5) -> DataFrame:
    """word, is_noun: whether the extraction gave it such a score."""
    good = extracted.where(F.col("score") >= min_noun_score).select(F.col("noun").alias("word"), F.lit(True).alias("found")).distinct()
    return words.select("word").distinct().join(good, "word", "left").select("word", F.coalesce("found", F.lit(False)).alias("is_noun"))
