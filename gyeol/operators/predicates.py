"""Predicates: endings and stems mined from an L-R graph, lemmas of eojeols, adjectives and verbs.

Lexicons are frames with a column ``word``.  Conjugation and its inverse run in Arrow batches over distinct pairs; what is
counted is a join or an aggregate.  Endings are mined longest first: endings of equal length never share an eojeol, so a
length is one round, cut by a checkpoint, and what it accepts takes its eojeols away by an anti-join.

Deviations: the pieces of evidence for a stem are weighted by how often they occur; an eojeol whose lemmas are all
taken away is no predicate.

Defined cases: null and empty words have no lemma, as have words with characters that aren't Hangul; repeated rows of a
lexicon count once; empty lexicons or counts give nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morph
from ..session import cut
from .lrgraph import lr_graph

#: Endings that are particles, too, and say nothing about a stem.
AMBIGUOUS = tuple("은 는 아 서는 다가 다 고만 고도 고 게도 게는 게 거나".split())


def _in(df: DataFrame, column: str, words: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose column is (or, by an anti-join, isn't) one of the words, a frame of one column."""
    return df.join(words.toDF("_w").distinct(), F.col(column) == F.col("_w"), how)


def surfaces(stems: DataFrame) -> DataFrame:
    """l: what the stems look like in front of an ending."""
    return stems.select("word").distinct().select(F.explode(morph.surfaces_of_stem("word")).alias("l")).distinct()


def _splits(df: DataFrame, column: str, least: int, behind: int, names: tuple[str, str]) -> DataFrame:
    """Every cut of a column with at least ``least`` characters in front and ``behind`` after it."""
    n = F.length(column)
    c = df.where(n >= least + behind).select("*", F.explode(F.sequence(F.lit(least), n - behind)).alias("_i"))
    return c.withColumn(names[0], F.expr(f"substr({column}, 1, _i)")).withColumn(names[1], F.expr(f"substr({column}, _i + 1)")).drop("_i")


# --- endings ------------------------------------------------------------------------------------------------


def marked_splits(counts: DataFrame, stem_forms: DataFrame, nouns: DataFrame, l_max: int = 10, r_max: int = 9) -> DataFrame:
    """eojeol, l, r, count, kind ('pos', 'neg', 'unk'; null if the split says nothing), own (l is the longest stem form of the eojeol), takes."""
    g = lr_graph(counts, l_max, r_max).where("r <> ''").withColumn("eojeol", F.concat("l", "r"))
    eojeols = counts.select("eojeol").where(F.length("eojeol") > 0)
    heads = eojeols.select("eojeol", F.explode(F.sequence(F.lit(1), F.length("eojeol"))).alias("i")).withColumn("head", F.expr("substr(eojeol, 1, i)"))
    longest = _in(heads, "head", stem_forms).groupBy("eojeol").agg(F.max("i").alias("longest"))
    ls = g.select("l").distinct()
    is_form = _in(ls, "l", stem_forms).withColumn("is_form", F.lit(True))
    after_noun = _in(_in(ls.withColumn("head", F.substring("l", 1, 1)).withColumn("rest", F.expr("substr(l, 2)")), "head", nouns.select("word")), "rest", stem_forms).select("l", F.lit(True).alias("after_noun"))
    tails = _in(_splits(ls, "l", 1, 1, ("_head", "tail")), "tail", stem_forms).select("l").distinct().withColumn("form_last", F.lit(True))
    whole = nouns.select(F.col("word").alias("eojeol"), F.lit(True).alias("is_noun")).distinct()
    s = g.join(longest, "eojeol", "left").join(is_form, "l", "left").join(after_noun, "l", "left").join(tails, "l", "left").join(whole, "eojeol", "left")
    longer = F.coalesce("longest", F.lit(0)) > F.length("l")
    form, verb = F.coalesce("is_form", F.lit(False)), F.coalesce("after_noun", F.lit(False))
    kind = F.when(F.col("is_noun") | longer, None).when(form | verb, "pos").when(F.col("form_last"), "unk").otherwise("neg")
    return s.select("eojeol", "l", "r", "count", kind.alias("kind"), (form & ~longer).alias("own"), (form | verb).alias("takes"), form.alias("form"))


def predict_endings(splits: DataFrame, min_score: float = 0.3, min_features: int = 5) -> DataFrame:
    """r, support, score; 0 with too few stem forms in front."""
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0)).alias(k)
    g = splits.groupBy("r").agg(total("pos"), total("neg"), total("unk"), F.count(F.when(F.col("own"), 1)).alias("k"))
    base = F.when(F.col("pos") + F.col("neg") == 0, 0.0).otherwise((F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg")))
    support = F.when(base >= min_score, F.col("pos") + F.col("unk")).otherwise(F.col("neg") + F.col("unk"))
    enough = F.col("k") >= min_features
    return g.select("r", F.when(enough, support).otherwise(0).alias("support"), F.when(enough, base).otherwise(0.0).alias("score"))


def endings_longest_first(counts: DataFrame, stem_forms: DataFrame, nouns: DataFrame, min_score: float = 0.3, min_features: int = 5, l_max: int = 10, r_max: int = 9) -> DataFrame:
    """r, support, score of every r that follows a stem form; accepted ones take away the eojeols that a stem form (or noun + stem form) and they make up."""
    splits = cut(marked_splits(counts, stem_forms, nouns, l_max, r_max))
    wanted = cut(splits.where("form").select("r").distinct())
    gone, done = None, None
    for k in range(r_max, 0, -1):
        at = splits.where(F.length("r") == k).join(wanted, "r", "left_semi")
        if gone is not None:
            at = at.join(gone, "eojeol", "left_anti")
        seen = predict_endings(at, min_score, min_features)
        seen = cut(wanted.where(F.length("r") == k).join(seen, "r", "left").select("r", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("score", F.lit(0.0)).alias("score")))
        taken = splits.where("takes").join(seen.where(F.col("score") >= min_score).select("r"), "r", "left_semi").select("eojeol")
        gone = cut(taken if gone is None else gone.union(taken).distinct())
        done = seen if done is None else done.union(seen)
    return done


def ending_lemmas(found: DataFrame, graph: DataFrame, stems: DataFrame, min_frequency: int = 1, min_score: float = 0.3) -> DataFrame:
    """ending, frequency, score: endings as they are in the lexicon, with the mean score of their forms by frequency."""
    good = found.where(F.col("score") >= min_score).select("r", "score")
    pairs = graph.where("r <> ''").join(good, "r").select("count", "score", F.inline(morph.lemmas("l", "r")))
    pairs = _in(pairs, "stem", stems.select("word"))
    g = pairs.groupBy("ending").agg(F.sum("count").alias("frequency"), (F.sum(F.col("count") * F.col("score")) / F.sum("count")).alias("score"))
    return g.where((F.col("frequency") >= min_frequency) & (F.col("score") >= min_score))


def extract_endings(counts: DataFrame, stems: DataFrame, nouns: DataFrame, min_score: float = 0.3, min_frequency: int = 1, min_features: int = 5) -> DataFrame:
    """ending, frequency, score."""
    found = endings_longest_first(counts, surfaces(stems), nouns, min_score, min_features)
    return ending_lemmas(found, lr_graph(counts), stems, min_frequency, min_score)


# --- stems --------------------------------------------------------------------------------------------------


def attested(counts: DataFrame, stems: DataFrame, endings: DataFrame) -> DataFrame:
    """stem, ending, word, l, r: conjugations that occur and are longer than the stem, cut behind as many characters as the stem has.

    The product of both lexicons is made of stems whose unchanging front starts some eojeol and endings whose rest ends one.
    """
    eojeols = counts.select("eojeol").where(F.length("eojeol") > 0).distinct()
    heads = _splits(eojeols, "eojeol", 0, 1, ("head", "_r")).select("head").distinct()
    tails = _splits(eojeols, "eojeol", 1, 0, ("_l", "tail")).select("tail").distinct()
    s = stems.select(F.col("word").alias("stem")).where(F.length("stem") > 0).distinct().withColumn("front", F.expr("substr(stem, 1, greatest(length(stem) - 2, 0))"))
    e = endings.select(F.col("word").alias("ending")).where(F.length("ending") > 0).distinct().withColumn("rest", F.expr("substr(ending, 2)"))
    s, e = _in(s, "front", heads).select("stem"), _in(e, "rest", tails).select("ending")
    made = s.crossJoin(e).select("stem", "ending", F.explode(morph.conjugated("stem", "ending")).alias("word")).where(F.length("word") > F.length("stem"))
    return _in(made, "word", eojeols).select("stem", "ending", "word", F.expr("substr(word, 1, length(stem))").alias("l"), F.expr("substr(word, length(stem) + 1)").alias("r"))


def predict_stems(graph: DataFrame, words: DataFrame, known_l: DataFrame, known_r: DataFrame, min_score: float = 0.7, min_frequency: int = 1, min_chars: int = 10, min_entropy: float = 0.5) -> DataFrame:
    """l, score, frequency; (0, 0) if too few kinds of characters follow or the endings are too much alike."""
    g = graph.join(words.select("l").distinct(), "l", "left_semi")
    rs = g.select("r").where("r <> ''").distinct()
    is_r = _in(rs, "r", known_r).withColumn("is_r", F.lit(True))
    predicate = _in(_in(_splits(rs, "r", 1, 1, ("_a", "_b")), "_a", known_l), "_b", known_r).select("r").distinct().withColumn("is_predicate", F.lit(True))
    ends = g.where("r <> ''").select("l", "r", F.explode(F.sequence(F.lit(1), F.length("l"))).alias("i")).withColumn("longer", F.concat(F.expr("right(l, i)"), "r"))
    longer = _in(ends, "longer", known_r).select("l", "r").distinct().withColumn("is_longer", F.lit(True))
    s = g.join(is_r, "r", "left").join(predicate, "r", "left").join(longer, ["l", "r"], "left")
    kind = (
        F.when(F.col("r").isin(*AMBIGUOUS), None).when(F.col("r") == "", "neg").when(F.col("is_r"), "pos").when(F.col("is_predicate") | F.col("is_longer"), "neg").otherwise("unk")
    )
    pure = F.col("is_r") & F.col("is_predicate").isNull() & F.col("is_longer").isNull() & ~F.col("r").isin(*AMBIGUOUS)
    s = s.withColumn("kind", kind).withColumn("c", F.when(pure, F.col("count").cast("double")))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0)).alias(k)
    spread = F.when(F.count("c") > 1, F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).otherwise(0.0)
    chars = F.count_distinct(F.when(F.col("r") != "", F.substring("r", 1, 1)))
    t = s.groupBy("l").agg(total("pos"), total("neg"), total("unk"), spread.alias("entropy"), chars.alias("chars"))
    score = F.when(F.col("pos") + F.col("neg") > 0, (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg"))).otherwise(0.0)
    frequency = F.when(score >= min_score, F.col("pos")).otherwise(F.col("neg") + F.col("unk"))
    varied = (F.col("chars") >= min_chars) & (F.col("entropy") >= min_entropy)
    return t.select("l", F.when(varied & (frequency >= min_frequency), score).otherwise(0.0).alias("score"), F.when(varied, frequency).otherwise(0).alias("frequency"))


def drop_derived(found: DataFrame, known_l: DataFrame, known_r: DataFrame) -> DataFrame:
    """found (l, ...) without stem + ending (+ more) and without words that start with another one of two characters or more."""
    both = found.select("l").union(known_l.toDF("l")).distinct()
    at = _in(_splits(found.select("l"), "l", 1, 1, ("head", "tail")), "head", both)
    begins = at.select("l", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda k: F.substr("tail", F.lit(1), k))).alias("piece"))
    with_ending = _in(begins, "piece", known_r).select("l")
    longer = _in(_splits(found.select("l"), "l", 2, 1, ("head", "tail")), "head", found.select("l")).select("l")
    return found.join(with_ending.union(longer).distinct(), "l", "left_anti")


def extract_stems(counts: DataFrame, stems: DataFrame, endings: DataFrame, min_score: float = 0.7, min_frequency: int = 100, min_chars: int = 10, min_entropy: float = 0.5, ignore: DataFrame | None = None) -> DataFrame:
    """stem, frequency, score."""
    graph = cut(lr_graph(counts))
    pairs = cut(attested(counts, stems, endings))
    known_l, known_r = pairs.select("l").distinct(), pairs.select("r").distinct()
    words = _in(_in(graph, "r", known_r).groupBy("l").agg(F.sum("count").alias("n")).where(F.col("n") >= min_frequency), "l", known_l, "left_anti")
    words = _in(words, "l", known_r, "left_anti").where((F.length("l") > 1) & (F.right("l", F.lit(1)) != "다"))
    if ignore is not None:
        words = _in(words, "l", ignore.select("word"), "left_anti")
    found = predict_stems(graph, words, known_l, known_r, min_score, min_frequency, min_chars, min_entropy)
    found = cut(found.where((F.col("score") >= min_score) & (F.col("frequency") >= min_frequency)))
    kept = drop_derived(found, known_l, known_r)
    lemma = graph.where("r <> ''").join(kept, "l").select("score", "frequency", F.inline(morph.lemmas("l", "r")))
    lemma = _in(lemma, "ending", endings.select("word"), "left_anti")
    return lemma.groupBy("stem").agg(F.sum("frequency").alias("frequency"), (F.sum(F.col("frequency") * F.col("score")) / F.sum("frequency")).alias("score"))


# --- predicates ---------------------------------------------------------------------------------------------


def without_stem_fronts(nouns: DataFrame, stems: DataFrame) -> DataFrame:
    """Nouns that aren't a stem less its last character, or else less its last two."""
    s = stems.select("word").distinct().select(F.col("word").alias("stem"), F.expr("substr(word, 1, greatest(length(word) - 1, 0))").alias("a"), F.expr("substr(word, 1, greatest(length(word) - 2, 0))").alias("b"))
    own = nouns.select("word").distinct()
    one = _in(s, "a", own)
    two = _in(s.join(one.select("stem"), "stem", "left_anti"), "b", own)
    return _in(own, "word", one.select("a").union(two.select("b")), "left_anti")


def predicate_counts(counts: DataFrame, nouns: DataFrame) -> DataFrame:
    """Eojeols of two characters or more that don't start with a noun of two characters or more."""
    long = counts.where(F.length("eojeol") > 1)
    with_noun = _in(_splits(long.select("eojeol"), "eojeol", 2, 0, ("head", "_t")), "head", nouns.select("word")).select("eojeol").distinct()
    return long.join(with_noun, "eojeol", "left_anti")


def lemma_candidates(counts: DataFrame, nouns: DataFrame, josa: DataFrame, stems: DataFrame, endings: DataFrame) -> DataFrame:
    """word, frequency, stem, ending: known lemmas of eojeols that aren't noun + particle."""
    with_josa = _in(_in(_splits(counts.select("eojeol"), "eojeol", 1, 1, ("_n", "_j")), "_n", nouns.select("word")), "_j", josa.select("word")).select("eojeol").distinct()
    own = counts.join(with_josa, "eojeol", "left_anti").select(F.col("eojeol").alias("word"), F.col("count").alias("frequency"))
    return own.join(morph.lemmatize(own, stems, endings), "word").select("word", "frequency", "stem", "ending")


def wrong_endings(lemmas: DataFrame, nouns: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(endings that only make nouns of two characters; word, ending pairs to take away) among endings of up to two characters."""
    per = lemmas.where(F.length("ending") < 3).select("word", "ending").distinct()
    per = per.join(nouns.select("word", F.lit(True).alias("is_noun")).distinct(), "word", "left")
    two, noun = F.length("word") == 2, F.coalesce("is_noun", F.lit(False))
    g = per.groupBy("ending").agg(F.count("*").alias("n"), F.count(F.when(two, 1)).alias("n2"), F.count(F.when(two & noun, 1)).alias("k"))
    bad = g.where((F.col("n2") > 0) & (F.col("k") / F.col("n2") >= share)).select("ending", (F.col("n2") == F.col("n")).alias("always"))
    pairs = per.join(bad, "ending").where((F.col("always") & two) | (~F.col("always") & ((two & noun) | ((F.length("word") == 3) & (F.length("ending") == 2)))))
    return bad.where("always").select(F.col("ending").alias("word")), pairs.select("word", "ending")


def adjective_or_verb(lemmas: DataFrame, adjectives: DataFrame, verbs: DataFrame) -> DataFrame:
    """lemmas with kind: by the lexicons (verbs first), by the stem's end, else 'Verb' if two forms that only verbs have occur among the words."""
    stems = lemmas.select("stem").distinct()
    v, a = verbs.select(F.col("word").alias("stem"), F.lit(True).alias("v")).distinct(), adjectives.select(F.col("word").alias("stem"), F.lit(True).alias("a")).distinct()
    s = stems.join(v, "stem", "left").join(a, "stem", "left").withColumn("kind", F.when(F.col("v"), "Verb").when(F.col("a"), "Adjective").otherwise(morph.rule_class("stem")))
    open_ = s.where("kind is null").select("stem")
    tried = open_.select("stem", F.explode(F.array_distinct(F.concat(*[morph.forms("stem", k) for k in ("present", "imperative", "pleasure")]))).alias("form"))
    seen = _in(tried, "form", lemmas.select("word")).groupBy("stem").agg(F.count_distinct("form").alias("k")).where("k > 1").select("stem", F.lit("Verb").alias("tested"))
    kinds = s.join(seen, "stem", "left").select("stem", F.coalesce("kind", "tested", F.lit("Adjective")).alias("kind"))
    return lemmas.join(kinds, "stem").select("word", "frequency", "stem", "ending", "kind")


class PredicateExtractor:
    """nouns, josa, adjectives, verbs and endings: frames with a column word."""

    def __init__(self, nouns: DataFrame, josa: DataFrame, adjectives: DataFrame, verbs: DataFrame, endings: DataFrame, mine_endings: bool = False, mine_stems: bool = False):
        self.josa, self.adjectives, self.verbs = (x.select("word").distinct() for x in (josa, adjectives, verbs))
        self.endings, self.stems = endings.select("word").distinct(), adjectives.select("word").union(verbs.select("word")).distinct()
        self.nouns = cut(without_stem_fronts(nouns, self.stems))
        self.mine_endings, self.mine_stems = mine_endings, mine_stems

    def train(self, counts: DataFrame, min_eojeol_frequency: int = 2, ending_options: dict | None = None, stem_options: dict | None = None) -> PredicateExtractor:
        """counts: eojeol, count; lexicons grow by what is mined."""
        self.counts = cut(counts.where((F.col("count") >= min_eojeol_frequency) & (F.length("eojeol") > 0)))
        if self.mine_endings or self.mine_stems:
            rest = cut(predicate_counts(self.counts, self.nouns))
            if self.mine_endings:
                more = extract_endings(rest, self.stems, self.nouns, **(ending_options or {}))
                self.endings = cut(self.endings.union(more.select("ending")).distinct())
            if self.mine_stems:
                self.stems = cut(self.stems.union(extract_stems(rest, self.stems, self.endings, **(stem_options or {})).select("stem")).distinct())
        return self

    def extract(self, min_frequency: int = 1, candidates: DataFrame | None = None) -> DataFrame:
        """word, frequency, stem, ending, kind ('Adjective' or 'Verb'); without candidates, eojeols of syllables only that occur more than min_frequency times."""
        words = candidates if candidates is not None else self.counts.where((F.col("count") > min_frequency) & F.col("eojeol").rlike("^[가-힣]+$"))
        lemmas = cut(lemma_candidates(words, self.nouns, self.josa, self.stems, self.endings))
        bad, pairs = wrong_endings(lemmas, self.nouns)
        lemmas = cut(lemmas.join(pairs, ["word", "ending"], "left_anti").select("word", "frequency", "stem", "ending"))
        self.endings = cut(_in(self.endings, "word", bad, "left_anti"))
        return adjective_or_verb(lemmas, self.adjectives, self.verbs)
