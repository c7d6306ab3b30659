"""Parts of speech of all eojeols, by a cascade: every stage matches what earlier stages left and takes it away.

State is kept in frames: ``eojeols`` (eojeol, count) that are left, one counter (word, count) for each tag, and lexicons of
lemmas (word, stem, ending).  A stage adds to counters by union and aggregation and removes by an anti-join; stages are cut
by checkpoints.  Within a stage all matches read the same eojeols, so they don't exclude each other.

News: whole word; noun + particle / adjective / verb; compounds of predicates; lemmas; one-syllable noun + the rest;
removal of irregular words; compound nouns; confused nouns.  Chat: without compound nouns, and with stems, endings and
nouns that look wrong taken away.

Deviation: of the compounds' counts, only their own frequency is added, once for each kind.

Defined cases: empty tables give empty results; null words are left out; repeated lexicon rows count once; ties between
cuts go to the shortest noun.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morph
from ..functions.hangul import decompose, is_consonant
from ..session import cut
from .nouns import parse_compound
from .predicates import _in, _splits
from .tokenize import dictionary, max_score

TAGS = ("Noun", "Adjective", "Verb", "Adverb", "Josa")


def _sum(*parts: DataFrame) -> DataFrame:
    """word, count over counters."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("word").agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class State:
    """What is left, what has been counted, and the lexicons as they have grown so far."""

    eojeols: DataFrame
    counted: DataFrame  # tag, word, count
    adjectives: DataFrame  # word, stem, ending
    verbs: DataFrame
    adjective_stems: DataFrame  # word
    verb_stems: DataFrame
    endings: DataFrame
    josa: DataFrame

    def of(self, tag: str) -> DataFrame:
        return self.counted.where(F.col("tag") == tag).select("word", "count")

    def step(self, found: DataFrame | None, matched: DataFrame, **lexicons: DataFrame) -> State:
        """Counters with what was found (tag, word, count), eojeols without what was matched (eojeol)."""
        counted = self.counted
        if found is not None:
            counted = cut(counted.unionByName(found.select("tag", "word", "count")).groupBy("tag", "word").agg(F.sum("count").alias("count")))
        left = cut(self.eojeols.join(matched.select("eojeol").distinct(), "eojeol", "left_anti").select("eojeol", "count"))
        return replace(self, eojeols=left, counted=counted, **{k: cut(v) for k, v in lexicons.items()})


def start(eojeols: DataFrame, predicates: DataFrame, adjective_stems: DataFrame, verb_stems: DataFrame, endings: DataFrame, josa: DataFrame) -> State:
    """predicates: word, stem, ending, kind, as the predicate extractor gives them."""
    lemma = lambda k: cut(predicates.where(F.col("kind") == k).select("word", "stem", "ending").distinct())
    none = eojeols.sparkSession.createDataFrame([], "tag string, word string, count long")
    words = [cut(x.select("word").where(F.col("word").isNotNull()).distinct()) for x in (adjective_stems, verb_stems, endings, josa)]
    return State(cut(eojeols.select("eojeol", F.col("count").cast("long").alias("count")).where(F.length("eojeol") > 0)), none, lemma("Adjective"), lemma("Verb"), *words)


def match_words(s: State, nouns: DataFrame, adverbs: DataFrame) -> State:
    """Eojeols that are a noun, an adjective, a verb or an adverb as a whole (or several of them)."""
    lexicon = {"Noun": nouns.select("word"), "Adjective": s.adjectives.select("word"), "Verb": s.verbs.select("word"), "Adverb": adverbs.select("word")}
    found = [_in(s.eojeols, "eojeol", words).select(F.lit(t).alias("tag"), F.col("eojeol").alias("word"), "count") for t, words in lexicon.items()]
    every = found[0].union(found[1]).union(found[2]).union(found[3])
    return s.step(every, every.select(F.col("word").alias("eojeol")))


def _first_cut(eojeols: DataFrame, heads: DataFrame, tails: DataFrame, least: int = 2) -> DataFrame:
    """eojeol, count, head, tail: the shortest head that is known, with a known tail."""
    both = _in(_in(_splits(eojeols, "eojeol", least, 1, ("head", "tail")), "head", heads), "tail", tails)
    return both.groupBy("eojeol").agg(F.first("count").alias("count"), F.min_by(F.struct("head", "tail"), F.length("head")).alias("x")).select("eojeol", "count", "x.*")


def match_noun_and_word(s: State) -> State:
    """Noun + particle, adjective or verb."""
    nouns = s.of("Noun").select("word")
    tails = {"Josa": s.josa, "Adjective": s.of("Adjective").select("word"), "Verb": s.of("Verb").select("word")}
    found = None
    for tag, words in tails.items():
        at = _first_cut(s.eojeols, nouns, words).select("eojeol", "count", "head", "tail", F.lit(tag).alias("tag"))
        found = at if found is None else found.union(at)
    found = cut(found)
    counts = found.select(F.lit("Noun").alias("tag"), F.col("head").alias("word"), "count").union(found.select("tag", F.col("tail").alias("word"), "count"))
    return s.step(counts, found)


def joinable(stem: str = "stem", ending: str = "ending", chat: bool = False):  # noqa: ANN201
    """Whether a stem and an ending, both as in the lexicon, can stand together without merging."""
    a, b = decompose(F.right(stem, F.lit(1))), decompose(F.substring(ending, 1, 1))
    merged = a["jong"].isin("ㄹ", "ㅂ") & b["cho"].isin("ㄴ", "ㄹ", "ㅁ", "ㅂ")
    dropped = (a["jung"] == "ㅡ") & (a["jong"] == " ") & (b["cho"] == "ㅇ") & b["jung"].isin("ㅓ", "ㅏ")
    ok = a.isNotNull() & b.isNotNull() & ~merged & ~dropped
    return ok & ~F.right(stem, F.lit(1)).isin("업", "닿", "땋") if chat else ok


def predicate_compounds(s: State, heads: DataFrame, base: DataFrame, stems: tuple[DataFrame, DataFrame], chat: bool = False) -> DataFrame:
    """eojeol, count, stem, ending: predicate + one of ``base``, with stems that aren't known yet."""
    at = _first_cut(s.eojeols, heads, base.select("word"))
    lemma = at.join(base.select(F.col("word").alias("tail"), F.col("stem").alias("base_stem"), "ending"), "tail")
    lemma = lemma.select("eojeol", "count", F.concat("head", "base_stem").alias("stem"), "ending").where(joinable(chat=chat)).distinct()
    for known in stems:
        lemma = _in(lemma, "stem", known, "left_anti")
    if chat:
        own = base.groupBy(F.col("word").alias("eojeol")).agg(F.max(F.length("stem")).alias("size"))
        lemma = lemma.join(own, "eojeol", "left").where(F.col("size").isNull() | (F.length("stem") > F.col("size"))).drop("size")
        wrong = wrong_stems(lemma.select("stem", "ending", "count"))
        lemma = _in(lemma, "stem", wrong, "left_anti")
    return lemma.select("eojeol", "count", "stem", "ending")


def match_predicate_compounds(s: State, chat: bool = False) -> State:
    """Predicate + adjective or verb; the eojeols of all adjectives and verbs counted so far go."""
    heads = cut(s.adjectives.select("word").union(s.verbs.select("word")).distinct())
    adj = cut(predicate_compounds(s, heads, s.adjectives, (s.verb_stems, s.adjective_stems), chat))
    adjectives = s.adjectives.union(adj.select("eojeol", "stem", "ending")).distinct()
    new_stems = s.adjective_stems if chat else s.adjective_stems.union(adj.select("stem")).distinct()
    verb = cut(predicate_compounds(s, heads, s.verbs, (s.verb_stems, new_stems), chat))
    verbs = s.verbs.union(verb.select("eojeol", "stem", "ending")).distinct()
    verb_stems = s.verb_stems if chat else s.verb_stems.union(verb.select("stem")).distinct()
    endings = s.endings
    if chat:
        bad = wrong_endings(adjectives, adj.select("eojeol")).union(wrong_endings(verbs, verb.select("eojeol"))).distinct()
        endings = _in(endings, "word", bad, "left_anti")
    one = lambda df, tag: df.groupBy("eojeol").agg(F.first("count").alias("count")).select(F.lit(tag).alias("tag"), F.col("eojeol").alias("word"), "count")
    found = one(adj, "Adjective").union(one(verb, "Verb"))
    seen = s.of("Adjective").union(s.of("Verb")).select(F.col("word").alias("eojeol")).union(found.select("word"))
    return s.step(found, seen, adjectives=adjectives, verbs=verbs, adjective_stems=new_stems, verb_stems=verb_stems, endings=endings)


def known_lemmas(words: DataFrame, stems: DataFrame, endings: DataFrame) -> DataFrame:
    """eojeol, stem, ending: the known lemmas of the longest front that has any."""
    own = words.select("eojeol").distinct()
    cuts = _splits(own, "eojeol", 1, 0, ("l", "r"))
    found = cuts.select("eojeol", F.length("l").alias("k"), F.inline(morph.lemmas("l", "r")))
    found = _in(_in(found, "stem", stems), "ending", endings)
    best = found.groupBy("eojeol").agg(F.max("k").alias("best"))
    return found.join(best, "eojeol").where("k = best").select("eojeol", "stem", "ending").distinct()


def match_lemmas(s: State) -> State:
    """Eojeols with a known stem and a known ending."""
    adj, verb = cut(known_lemmas(s.eojeols, s.adjective_stems, s.endings)), cut(known_lemmas(s.eojeols, s.verb_stems, s.endings))
    count = lambda df, tag: s.eojeols.join(df.select("eojeol").distinct(), "eojeol", "left_semi").select(F.lit(tag).alias("tag"), F.col("eojeol").alias("word"), "count")
    found = count(adj, "Adjective").union(count(verb, "Verb"))
    return s.step(found, adj.select("eojeol").union(verb.select("eojeol")), adjectives=s.adjectives.union(adj), verbs=s.verbs.union(verb))


def match_syllable_nouns(s: State) -> State:
    """One syllable + an adjective, a verb or a particle that has been counted."""
    cuts = s.eojeols.where(F.length("eojeol") > 1).select("eojeol", "count", F.substring("eojeol", 1, 1).alias("head"), F.expr("substr(eojeol, 2)").alias("tail"))
    tags = s.counted.where(F.col("tag").isin("Adjective", "Verb", "Josa")).select("tag", F.col("word").alias("tail"))
    found = cut(cuts.join(tags, "tail"))
    counts = found.select(F.lit("Noun").alias("tag"), F.col("head").alias("word"), "count").union(found.select("tag", F.col("tail").alias("word"), "count"))
    return s.step(counts, found)


def remove_irregular(s: State) -> State:
    """Without eojeols that are a particle, an ending or a single character."""
    odd = _in(s.eojeols, "eojeol", s.josa.union(s.endings)).select("eojeol").union(s.eojeols.where(F.length("eojeol") == 1).select("eojeol"))
    return s.step(None, odd)


def match_compound_nouns(s: State) -> State:
    """Nouns put together, with or without something counted behind them.

    The nouns are sent to the tasks, at most tokenize.MAX_ENTRIES of them.
    """
    weight = dictionary(s.of("Noun").where(F.length("word") > 1).select("word", F.lit(1.0).alias("weight")))
    if not weight:
        return s

    @F.pandas_udf("struct<front:string,whole:string,last:string>")
    def pieces(words: pd.Series) -> pd.DataFrame:
        cuts = [max_score(w, weight) for w in words]
        front = ["".join(p[0] for p in c[:-1]) if len(c) > 2 and parse_compound(c, {c[-1][0]}) else None for c in cuts]
        whole = [w if parse_compound(c, set()) else None for w, c in zip(words, cuts)]
        return pd.DataFrame({"front": front, "whole": whole, "last": [c[-1][0] for c in cuts]})

    at = cut(s.eojeols.withColumn("x", pieces("eojeol")).select("eojeol", "count", "x.*").where("front is not null or whole is not null"))
    tails = s.counted.where(F.col("tag") != "Adverb").select(F.col("word").alias("last"), F.lit(True).alias("known")).distinct()
    found = at.join(tails, "last", "left").withColumn("word", F.when(F.col("known"), F.coalesce("front", "whole")).otherwise(F.col("whole"))).where("word is not null")
    found = cut(found.select("eojeol", "word", "count"))
    return s.step(found.select(F.lit("Noun").alias("tag"), "word", "count"), found)


# --- what looks wrong in chat ----------------------------------------------------------------------------------


def wrong_stems(lemmas: DataFrame, share: float = 0.9) -> DataFrame:
    """word: stems whose endings begin with a single consonant, nearly always; lemmas: stem, ending, count."""
    first = F.col("ending") != ""
    jaum = F.sum(F.when(first & is_consonant("ending"), F.col("count")).otherwise(0))
    return lemmas.groupBy("stem").agg((jaum / F.sum("count")).alias("p")).where(F.col("p") >= share).select(F.col("stem").alias("word"))


def wrong_endings(lemmas: DataFrame, compounds: DataFrame) -> DataFrame:
    """word: endings that more compounds than other predicates have; lemmas: word, stem, ending; compounds: eojeol."""
    mark = compounds.select(F.col("eojeol").alias("word"), F.lit(1).alias("new")).distinct()
    votes = F.sum(F.when(F.col("new") == 1, 1).otherwise(-1))
    return lemmas.distinct().join(mark, "word", "left").groupBy("ending").agg(votes.alias("n")).where("n > 0").select(F.col("ending").alias("word"))


def without_stems(lemmas: DataFrame, stems: DataFrame) -> DataFrame:
    """lemmas (stem, ...) without those of the stems; a word that has no other lemma is gone."""
    return _in(lemmas, "stem", stems.select("word"), "left_anti")


def noun_phrases(nouns: DataFrame, tails: DataFrame) -> DataFrame:
    """Nouns of three characters or more that end with one of the tails."""
    long = nouns.where(F.length("word") > 2)
    return long.join(_in(_splits(long.select("word"), "word", 1, 1, ("_l", "_r")), "_r", tails.select("word")).select("word").distinct(), "word", "left_semi")


# --- the whole --------------------------------------------------------------------------------------------------


def confused_nouns(s: State) -> DataFrame:
    """word, count: nouns that are an adjective, a verb or an adverb, too."""
    return _in(s.of("Noun"), "word", s.counted.where(F.col("tag").isin("Adjective", "Verb", "Adverb")).select("word"))


def tag_words(eojeols: DataFrame, nouns: DataFrame, predicates: DataFrame, adjective_stems: DataFrame, verb_stems: DataFrame, endings: DataFrame, josa: DataFrame, adverbs: DataFrame, chat: bool = False) -> tuple[DataFrame, DataFrame, State]:
    """(tag, word, count; tag, word, stem, ending of the predicates counted; the last state).

    Besides the five parts of speech, tags are 'ConfusedNoun' and 'Irrecognizable' (an eojeol).  -ha stems give adverbs.
    """
    made = adjective_stems.select("word").union(verb_stems.select("word")).select(morph.stem_to_adverb("word").alias("word")).where("word is not null")
    s = match_words(start(eojeols, predicates, adjective_stems, verb_stems, endings, josa), nouns, adverbs.select("word").union(made).distinct())
    s = match_noun_and_word(s)
    s = match_predicate_compounds(s, chat)
    s = match_lemmas(s)
    s = match_syllable_nouns(s)
    s = remove_irregular(s)
    if not chat:
        s = match_compound_nouns(s)
    confused = confused_nouns(s)
    if chat:
        tails = s.counted.where(F.col("tag").isin("Josa", "Adjective", "Verb")).select("word")
        confused = confused.union(noun_phrases(s.of("Noun"), tails)).distinct()
    confused = cut(confused)
    rest = s.counted.join(confused.select(F.lit("Noun").alias("tag"), "word"), ["tag", "word"], "left_anti").select("tag", "word", "count")
    out = rest.union(confused.select(F.lit("ConfusedNoun"), "word", "count")).union(s.eojeols.select(F.lit("Irrecognizable"), F.col("eojeol").alias("word"), "count"))
    lemma = None
    for tag, lexicon, stems in (("Adjective", s.adjectives, s.adjective_stems), ("Verb", s.verbs, s.verb_stems)):
        words = s.of(tag).select("word")
        have = words.join(lexicon, "word")
        more = known_lemmas(words.join(lexicon, "word", "left_anti").withColumnRenamed("word", "eojeol"), stems, s.endings).withColumnRenamed("eojeol", "word")
        one = have.union(more).distinct().select(F.lit(tag).alias("tag"), "word", "stem", "ending")
        lemma = one if lemma is None else lemma.union(one)
    return out, lemma, s
