"""Nouns of news text: one aggregate of feature weights, then rules that take words away and put compounds back.

Every rule is an aggregate or a join over the L-R graph, and its result a set of words; sets are frozen while a
rule runs, so nothing depends on the order of words.  Three places where that differs from growing a dictionary while
it is being read: only the words that pass all other rules explain an ending in JOSA_TAIL, compounds are found in a
single pass, and an eojeol is cut into noun + verb behind its second character only.

Defined cases: null sentences and words count nothing; repeated lexicon rows count once, the highest weight of a
feature holds; an empty corpus has no nouns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hangul import decompose
from ..session import cut
from .lrgraph import eojeol_counts, lr_graph

#: Particles and endings whose first two characters speak for the noun in front of them.
PASS = tuple(
    # particles
    "는 은 이 를 과 와 의 로 으로 으로의 로는 로도 로서 이나 부터 처럼 에게 에도 에서 에와"
    # plurals, 'only'
    " 들이 들의 들에 들 뿐인 뿐이 뿐만 뿐"
    # forms of 이다, 하다 and 되다
    " 임 인 이었 이라 할 한 했다 했고 했던 하다 된다 되다 되는 되고".split()
)
#: Last characters of words that are cut short, with what follows them and the share of it that tells.
CUT_SHORT = {"으": ("로", "로써", "로만", "로의"), "지": ("만",), "없": ("는", "이", "다", "었다")}
STOP_TAILS, FREQUENT_TAILS, PLURAL_TAILS, JOSA_TAIL = ("갔다", "이는", "겠지", "보는"), "인은의와과", ("들이", "들은", "들도", "들을"), "으로"

FIELDS = ("score", "frequency", "feature_proportion", "eojeol_proportion", "n_positive_feature", "unique_positive_feature_proportion")


def news_graph(sents: DataFrame, l_max: int = 10, r_max: int = 7) -> tuple[DataFrame, DataFrame]:
    """(eojeol counts of up to l_max + r_max characters, their L-R graph)."""
    counts = eojeol_counts(sents, l_max + r_max)
    return counts, lr_graph(counts, l_max, r_max)


def l_frequency(graph: DataFrame) -> DataFrame:
    """l, n."""
    return graph.groupBy("l").agg(F.sum("count").alias("n"))


def news_scores(graph: DataFrame, counts: DataFrame, weights: DataFrame) -> DataFrame:
    """l and the six fields of its score, for every l of the graph."""
    best = weights.groupBy(F.col("feature").alias("r")).agg(F.max("weight").alias("weight"))
    s = graph.join(best, "r", "left")
    known = F.col("weight").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    g = s.groupBy("l").agg(
        F.sum("count").alias("frequency"),
        zero(F.sum(F.when(known, F.col("count")))).alias("norm"),
        F.sum(F.when(known, F.col("count") * F.col("weight"))).alias("w"),
        F.count(F.when(known, 1)).alias("kinds"),
        F.count(F.when(F.col("weight") > 0, 1)).alias("n_positive_feature"),
    )
    g = g.join(counts.select(F.col("eojeol").alias("l"), F.col("count").alias("whole")), "l", "left").withColumn("whole", zero(F.col("whole")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return g.select(
        "l", ratio(F.col("w"), F.col("norm")).alias("score"), "frequency",
        ratio(F.col("norm"), F.col("frequency") - F.col("whole")).alias("feature_proportion"),
        ratio(F.col("whole"), F.col("frequency")).alias("eojeol_proportion"), "n_positive_feature",
        ratio(F.col("n_positive_feature"), F.col("kinds")).alias("unique_positive_feature_proportion"),
    )


def _cuts(words: DataFrame, least: int = 2, up_to: int = 1) -> DataFrame:
    """l, i, head, tail: every cut from ``least`` characters on; the tail has at least ``up_to`` characters."""
    n = F.length("l")
    c = words.select("l").where(n >= least + up_to).select("l", F.explode(F.sequence(F.lit(least), n - up_to)).alias("i"))
    return c.select("l", "i", F.expr("substr(l, 1, i)").alias("head"), F.expr("substr(l, i + 1)").alias("tail"))


def _among(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Rows whose column is one of the words (a frame of one column)."""
    return df.join(words.toDF("_w").distinct(), F.col(column) == F.col("_w"), "left_semi")


def _without(words: DataFrame, gone: DataFrame) -> DataFrame:
    return words.join(gone.select(F.col("l").alias("_w")).distinct(), F.col("l") == F.col("_w"), "left_anti")


class NewsNounExtractor:
    """weights: feature, weight; verbs: word (verbs and adjectives as they are written); base: word (nouns known before)."""

    def __init__(self, weights: DataFrame, verbs: DataFrame, base: DataFrame | None = None, max_left_length: int = 10, max_right_length: int = 7):
        self.weights, self.verbs, self.base = weights, verbs.select("word").distinct(), base
        self.l_max, self.r_max = max_left_length, max_right_length
        self.josa = weights.where("weight > 0.1").select("feature").union(weights.sparkSession.createDataFrame([("는",)], "feature string")).distinct()

    def train(self, sents: DataFrame) -> NewsNounExtractor:
        counts, graph = news_graph(sents, self.l_max, self.r_max)
        self.counts = cut(counts)
        self.graph = cut(lr_graph(self.counts, self.l_max, self.r_max))
        self.scores = cut(news_scores(self.graph, self.counts, self.weights))
        self.sizes = self.scores.select("l", F.col("frequency").alias("n"))
        return self

    def predict(self, words: DataFrame) -> DataFrame:
        """l and its score; 0 in all fields for what the corpus doesn't have."""
        return words.select("l").distinct().join(self.scores, "l", "left").select("l", *[F.coalesce(f, F.lit(0)).alias(f) for f in FIELDS])

    def whole_eojeols(self, min_frequency: int = 3, min_share: float = 0.99) -> DataFrame:
        """l, n: words that are nearly always a whole eojeol."""
        return self.scores.where((F.col("frequency") >= min_frequency) & (F.col("eojeol_proportion") >= min_share)).select("l", F.col("frequency").alias("n"))

    def nouns_before_verbs(self, min_frequency: int = 3, min_noun_score: float = 0.4) -> DataFrame:
        """l: two-character heads of whole eojeols that go on as a verb."""
        heads = self.whole_eojeols(min_frequency).where(F.length("l") >= 4).select(F.expr("substr(l, 1, 2)").alias("l"), F.expr("substr(l, 3)").alias("tail"))
        good = self.scores.where(F.col("score") >= min_noun_score).select("l")
        return _among(heads, "tail", self.verbs).select("l").distinct().join(good, "l", "left_semi")

    # --- rules; each takes words (l) and gives those it holds for ------------------------------------------

    def noun_part_and_josa(self, words: DataFrame, nouns: DataFrame, min_score: float = 0.4, share: float = 0.8, drop: float = 0.7) -> DataFrame:
        """A noun with the first characters of its particles."""
        heads = nouns.select("l").union(self.scores.where(F.col("score") > min_score).select("l"))
        at = _among(_cuts(words), "head", heads).groupBy("l").agg(F.max("i").alias("most"), F.collect_set("i").alias("ends"))
        base = self.sizes.select(F.col("l").alias("base"), F.col("n").alias("base_n"))
        at = at.join(self.sizes, "l").join(base, F.expr("substr(l, 1, most)") == F.col("base")).where(F.col("n") / F.col("base_n") <= drop)
        tokens = self.graph.join(at.select("l", "ends"), "l").select("l", "r", "count", F.explode("ends").alias("i"))
        tokens = tokens.withColumn("tail", F.expr("substr(concat(l, r), i + 1)"))
        hit = _among(tokens, "tail", self.josa).select("l", "r", "count").distinct().groupBy("l").agg(F.sum("count").alias("hit"))
        return hit.join(self.sizes, "l").where(F.col("hit") / F.col("n") > share).select("l")

    def nouns_with_josa(self, words: DataFrame, min_score: float = 0.7, share: float = 0.7) -> DataFrame:
        """Heads of words that go on as a particle and are about as frequent."""
        heads = self.scores.where(F.col("score") > min_score).select(F.col("l").alias("head"), F.col("frequency").alias("head_n"))
        both = _among(_cuts(words), "tail", self.josa).join(heads, "head").join(self.sizes, "l")
        return both.where(F.col("head_n") / F.col("n") > share).select(F.col("head").alias("l")).distinct()

    def _short_tails(self, words: DataFrame) -> DataFrame:
        """l, head, tail for tails of one character, and of two if the word has more than three."""
        n = F.length("l")
        b = F.explode(F.when(n <= 3, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))
        return words.select("l").where(n > 1).select("l", b.alias("b")).select("l", F.expr("substr(l, 1, length(l) - b)").alias("head"), F.expr("right(l, b)").alias("tail"))

    def noun_and_verb_part(self, words: DataFrame, scored: DataFrame, nouns: DataFrame, share: float = 0.7) -> DataFrame:
        """A noun with the first characters of verbs that are mostly written on their own."""
        at = _among(_among(self._short_tails(words), "head", scored.select("l")), "head", nouns.select("l"))
        alone = self.scores.where(F.least(F.lit(1.0), "eojeol_proportion") > share).select(F.col("l").alias("verb"), F.lit(1).alias("alone"))
        ext = at.join(self.graph, "l").withColumn("verb", F.concat("tail", "r")).join(alone, "verb", "left")
        g = ext.groupBy("l", "tail").agg((F.sum(F.when(F.col("alone") == 1, F.col("count")).otherwise(0)) / F.sum("count")).alias("p"))
        return g.where(F.col("p") > share).select("l").distinct()

    def far_rarer_than_head(self, words: DataFrame, known: DataFrame, drop: float = 0.1) -> DataFrame:
        heads = self.sizes.select(F.col("l").alias("head"), F.col("n").alias("head_n"))
        at = _among(self._short_tails(words), "head", known.select("l")).join(heads, "head", "left").join(self.sizes, "l", "left")
        rate = F.when(F.coalesce("head_n", F.lit(0)) <= 0, 0.0).otherwise(F.coalesce("n", F.lit(0)) / F.col("head_n"))
        return at.where(rate < drop).select("l").distinct()

    def compounds(self, words: DataFrame, known: DataFrame) -> DataFrame:
        """Words of two known parts (four characters or more) or three (six or more); parts but the last of two have two characters at least."""
        long = words.select("l").distinct()
        heads = _among(_cuts(long.where(F.length("l") >= 4)), "head", known.select("l"))
        two = _among(heads, "tail", known.select("l")).select("l")
        rest = heads.where((F.length("l") >= 6) & (F.length("tail") >= 4)).select("l", "i", "tail")
        rest = rest.select("l", F.col("tail"), F.explode(F.sequence(F.lit(2), F.length("tail") - 2)).alias("j")).select("l", F.expr("substr(tail, 1, j)").alias("middle"), F.expr("substr(tail, j + 1)").alias("last"))
        three = _among(_among(rest, "middle", known.select("l")), "last", known.select("l")).select("l")
        return two.union(three).distinct()

    def noun_and_josa(self, words: DataFrame, known: DataFrame) -> DataFrame:
        """A known noun alone, or with a feature of positive weight."""
        own = words.select("l").where(F.length("l") >= 2)
        positive = self.weights.where("weight > 0").select("feature")
        return _among(own, "l", known.select("l")).union(_among(_among(_cuts(own), "head", known.select("l")), "tail", positive).select("l")).distinct()

    def noun_and_verb(self, words: DataFrame, nouns: DataFrame) -> DataFrame:
        return _among(_among(_cuts(words), "head", nouns.select("l")), "tail", self.verbs).select("l").distinct()

    def one_josa(self, scored: DataFrame, known: DataFrame, min_frequency: int = 10, max_josa: int = 1) -> DataFrame:
        """Rare words whose few features don't speak for a noun."""
        rare = scored.where((F.col("frequency") <= min_frequency) & (F.col("n_positive_feature") <= max_josa)).select("l")
        ext = self.graph.join(rare, "l", "left_semi")
        rs = ext.where("r <> ''").select(F.col("r").alias("l")).distinct()
        good = self.noun_and_josa(rs, known).union(rs.where(F.substring("l", 1, 2).isin(*PASS))).distinct().select(F.col("l").alias("r"), F.lit(True).alias("good"))
        g = ext.join(good, "r", "left").groupBy("l").agg(F.sum(F.when(F.col("r") != "", F.col("count"))).alias("n"), F.sum(F.when(F.col("good"), F.col("count"))).alias("k"))
        ok = g.where(F.coalesce(F.col("k"), F.lit(0)) / F.col("n") > 0.5).select("l")
        return _without(rare, ok)

    def bad_tails(self, words: DataFrame, nouns: DataFrame, drop: float = 0.8) -> DataFrame:
        """Words that are a verb, or whose last characters belong to what follows; JOSA_TAIL goes with a noun of ``nouns`` in front."""
        own = words.select("l").distinct()
        last, two = F.right("l", F.lit(1)), F.right("l", F.lit(2))
        bad = _among(own, "l", self.verbs).union(own.where(two.isin(*STOP_TAILS)))
        share = self.graph.join(self.sizes, "l").select("l", "r", (F.col("count") / F.col("n")).alias("p"))
        cases = [(F.right("l", F.lit(1)) == c) & F.col("r").isin(*rs) for c, rs in CUT_SHORT.items()]
        follows = own.join(share, "l").where(cases[0] | cases[1] | cases[2]).groupBy("l").agg(F.sum("p").alias("p")).where("p > 0.5").select("l")
        shorter = self.sizes.select(F.col("l").alias("sub"), F.col("n").alias("sub_n"))
        tails = own.where(last.isin(*FREQUENT_TAILS) | two.isin(*PLURAL_TAILS)).join(self.sizes, "l", "left").join(shorter, F.expr("substr(l, 1, length(l) - 1)") == F.col("sub"), "left")
        rate = F.when(F.col("sub_n").isNull(), 0.0).otherwise(F.coalesce("n", F.lit(0)) / F.col("sub_n"))
        dropping = tails.where(rate < drop).select("l")
        josa = own.where(two == JOSA_TAIL).withColumn("head", F.expr("substr(l, 1, length(l) - 2)"))
        with_josa = josa.where(F.length("l") == 3).select("l").union(_among(josa, "head", nouns.select("l")).select("l"))
        return bad.union(follows).union(dropping).union(with_josa).distinct()

    def light_verbs(self, words: DataFrame, known: DataFrame, share: float = 0.5) -> DataFrame:
        """Words that go on with ㅎ (하다) half of the time, unless a known noun and a last character other than 당 make them up."""
        own = words.select("l").distinct()
        cutoff = own.where(F.right("l", F.lit(1)) != "당").withColumn("head", F.expr("substr(l, 1, length(l) - 1)"))
        own = _without(own, _among(cutoff, "head", known.select("l")))
        first = self.graph.where("r <> ''").select(F.substring("r", 1, 1).alias("c")).distinct()
        h = first.where(decompose("c")["cho"] == "ㅎ").withColumn("is_h", F.lit(True))
        ext = self.graph.join(own, "l", "left_semi").withColumn("c", F.substring("r", 1, 1)).join(h, "c", "left")
        return ext.groupBy("l").agg((F.sum(F.when(F.col("is_h"), F.col("count")).otherwise(0)) / F.sum("count")).alias("p")).where(F.col("p") >= share).select("l")

    # --- the whole ------------------------------------------------------------------------------------------

    def dictionary(self, min_frequency: int = 3) -> DataFrame:
        found = self.nouns_before_verbs(min_frequency)
        return found if self.base is None else found.union(self.base.select("word")).distinct()

    def scored(self, min_noun_score: float = 0.4, min_frequency: int = 3, candidates: DataFrame | None = None) -> DataFrame:
        """Candidates with a score above the threshold: two characters at least, frequent, no features themselves."""
        words = self.scores if candidates is None else self.scores.join(candidates.select(F.col("word").alias("l")).distinct(), "l", "left_semi")
        return _without(words.where((F.col("frequency") >= min_frequency) & (F.length("l") >= 2) & (F.col("score") > min_noun_score)), self.weights.select(F.col("feature").alias("l")))

    def postprocess(self, scored: DataFrame, nouns: DataFrame) -> DataFrame:
        """scored without what the rules take away."""
        words = scored.select("l")
        known = cut(words.union(nouns.select("l")).distinct())
        compound = cut(self.compounds(words, known))
        parts = cut(self.noun_part_and_josa(words, nouns))
        heads = self.nouns_with_josa(_without(words, parts))
        verbs = self.noun_and_verb_part(words, scored, nouns).join(self.far_rarer_than_head(words, known), "l", "left_semi")
        gone = parts.union(heads).union(_without(verbs, compound)).union(_without(self.one_josa(scored, known), compound)).union(self.light_verbs(words, known))
        left = cut(_without(scored, gone))
        firm = _without(left, self.bad_tails(left, nouns.limit(0))).select("l")
        return _without(left, self.bad_tails(left, nouns.select("l").union(firm)))

    def compounds_of_eojeols(self, scored: DataFrame, kept: DataFrame, nouns: DataFrame, min_frequency: int = 3) -> DataFrame:
        """l: whole eojeols that are compounds of known nouns."""
        known = cut(scored.select("l").union(nouns.select("l")).distinct())
        words = cut(_without(self.whole_eojeols(min_frequency).select("l"), kept))
        settled = kept.select("l").union(nouns.select("l"))
        gone = self.noun_part_and_josa(words, nouns).union(self.noun_and_josa(words, known)).union(self.noun_and_verb(words, settled)).union(self.bad_tails(words, settled))
        return _without(self.compounds(words, known), gone)

    def extract(self, min_noun_score: float = 0.4, min_frequency: int = 3, candidates: DataFrame | None = None) -> DataFrame:
        """noun and the six fields of its score."""
        nouns = cut(self.dictionary(min_frequency))
        scored = cut(self.scored(min_noun_score, min_frequency, candidates))
        kept = cut(self.postprocess(scored, nouns))
        more = nouns.select("l").union(self.compounds_of_eojeols(scored, kept, nouns, min_frequency)).distinct()
        return kept.select("l", *FIELDS).union(self.predict(_without(more, kept))).withColumnRenamed("l", "noun")

    def train_extract(self, sents: DataFrame, **thresholds: float) -> DataFrame:
        return self.train(sents).extract(**thresholds)

