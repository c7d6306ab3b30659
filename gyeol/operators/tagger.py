"""Part-of-speech tagging by templates: generate candidates, choose the best, fill the gaps.

The dictionary is a ``tag, word`` table.  Tagging is a function of one eojeol, applied to
distinct eojeols.  ``Generator``, ``Evaluator`` and gap filling are plain functions, so
others can be put in their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import token_table
from .tokenize import MAX_ENTRIES, over_distinct

LABELS = {"Noun": "명사", "Verb": "동사", "Adjective": "형용사", "Adverb": "부사", "Josa": "조사", "Determiner": "관형사", "Exclamation": "감탄사", "Pronoun": "대명사", "Numeral": "수사", "Eomi": "어미", "Number": "숫자", "Symbol": "기호"}


class Span(NamedTuple):
    """L from b to m with its tag, R from m to e."""

    l: str
    l_tag: str | None
    r: str
    r_tag: str | None
    b: int
    m: int
    e: int


class Dictionary:
    """Immutable tag -> words; changes give another dictionary."""

    def __init__(self, words: dict[str, Iterable[str]]):
        self.words = {t: frozenset(w) for t, w in words.items()}
        self.max_length = max((len(w) for ws in self.words.values() for w in ws), default=0)

    @classmethod
    def of(cls, table: DataFrame, limit: int = MAX_ENTRIES) -> Dictionary:
        """From a ``tag, word`` table of at most ``limit`` rows, since it travels with the tasks."""
        rows = table.select("tag", "word").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"a dictionary of more than {limit} entries")
        out: dict[str, set[str]] = {}
        for tag, word in rows:
            out.setdefault(tag, set()).add(word)
        return cls(out)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, w) for t, ws in sorted(self.words.items()) for w in sorted(ws)], "tag string, word string")

    def tags(self, word: str) -> list[str]:
        return [t for t, ws in self.words.items() if word in ws]

    def has(self, word: str, tag: str) -> bool:
        return word in self.words.get(tag, ())

    def with_words(self, tag: str, words: Iterable[str], force: bool = False) -> Dictionary:
        """With more words of a tag; a new tag only if forced."""
        if tag not in self.words and not force:
            raise ValueError(f"unknown tag {tag}")
        return Dictionary({**self.words, tag: self.words.get(tag, frozenset()) | frozenset(words)})

    def without_words(self, tag: str, words: Iterable[str]) -> Dictionary:
        if tag not in self.words:
            raise ValueError(f"unknown tag {tag}")
        return Dictionary({**self.words, tag: self.words[tag] - frozenset(words)})


def save_dictionary(d: Dictionary, spark: SparkSession, path: str) -> None:
    """JSON lines of tag and words."""
    d.table(spark).groupBy("tag").agg(F.array_sort(F.collect_list("word")).alias("words")).coalesce(1).write.mode("overwrite").json(path)


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    return Dictionary.of(spark.read.schema("tag string, words array<string>").json(path).select("tag", F.explode("words").alias("word")))


def lr_spans(d: Dictionary, left: tuple[str, ...] = ("Noun", "Adjective", "Verb", "Adverb", "Exclamation"), templates: dict[str, tuple[str, ...]] | None = None) -> Callable[[str], list[Span]]:
    """Every known L of two or more characters, alone and with each R that its template allows."""
    templates = templates or {"Noun": ("Josa", "Verb", "Adjective")}
    kinds = lambda tags: {w: tuple(x for x in tags if d.has(w, x)) for x in tags for w in d.words.get(x, ())}
    lefts, rights = kinds(left), kinds(dict.fromkeys(x for tag in left for x in templates.get(tag, ())))
    l_max, r_max = max(map(len, lefts), default=0), max(map(len, rights), default=0)

    def generate(t: str) -> list[Span]:
        n, out = len(t), []
        behind: dict[int, list[tuple[int, str, tuple[str, ...]]]] = {}
        for b in range(n):
            for m in range(b + 2, min(n, b + l_max) + 1):
                if not (tags := lefts.get(l := t[b:m])):
                    continue
                if m not in behind:
                    behind[m] = [(e, r, found) for e in range(m + 1, min(n, m + r_max) + 1) if (found := rights.get(r := t[m:e]))]
                for tag in tags:
                    out.append(Span(l, tag, "", None, b, m, m))
                    if behind[m] and (allowed := templates.get(tag)):
                        out += [Span(l, tag, r, x, b, m, e) for e, r, found in behind[m] for x in allowed if x in found]
        return out

    return generate


def eojeol_readings(d: Dictionary, single: tuple[str, ...] = ("Noun", "Verb", "Adjective", "Adverb", "Exclamation"), pairs: tuple[tuple[str, str], ...] = (("Noun", "Verb"), ("Noun", "Adjective"), ("Noun", "Josa"))) -> Callable[[str], list[list[Span]]]:
    """Readings of a whole eojeol: one word, an L and an R, or a chain of shortest nouns or adverbs."""

    def chain(t: str, tag: str) -> list[Span]:
        out, b, n = [], 0, len(t)
        while b < n:
            e = next((e for e in range(b + 1, n + 1) if (b or e < n) and d.has(t[b:e], tag)), None)
            if e is None:
                return []
            out.append(Span(t[b:e], tag, "", None, b, e, e))
            b = e
        return out

    def generate(t: str) -> list[list[Span]]:
        n = len(t)
        out = [[Span(t, x, "", None, 0, n, n)] for x in single if d.has(t, x)] or [[Span(t, None, "", None, 0, n, n)]]
        out += [[Span(t[:m], a, t[m:], z, 0, m, n)] for m in range(1, n) for a, z in pairs if d.has(t[:m], a) and d.has(t[m:], z)]
        return out + [c for tag in ("Noun", "Adverb") if (c := chain(t, tag))]

    return generate


#: noun phrase, both known, adverb, adjective, each character of L and of R, L of one character
LR_WEIGHTS = (0.3, 0.15, 0.2, 0.1, 0.1, 0.1, -0.2)
#: nouns, words, any noun, unknown words, repeated adverb, compound noun, noun with particle, one noun
READING_WEIGHTS = (-0.1, -0.15, 0.2, -0.3, 0.1, -0.05, 0.1, 0.2)


def lr_score(s: Span, weights: tuple[float, ...] = LR_WEIGHTS, preference: dict[str, dict[str, float]] | None = None) -> float:
    l, l_tag, r, r_tag, b, m, e = s
    noun, both, adverb, adjective, each_l, each_r, single = weights
    out = (l_tag == "Noun") * noun + (l_tag is not None and r_tag is not None) * both + (l_tag == "Adverb") * adverb + (l_tag == "Adjective") * adjective + (m - b) * each_l + (e - m) * each_r + (m - b == 1) * single
    return out + sum(preference.get(tag, {}).get(word, 0.0) for tag, word in ((l_tag, l), (r_tag, r))) if preference else out


def reading_score(c: list[Span], weights: tuple[float, ...] = READING_WEIGHTS) -> float:
    nouns, n = sum(s.l_tag == "Noun" for s in c), len(c)
    one = n == 1 and c[0].l_tag == "Noun"
    facts = (nouns, n, nouns > 0, sum(s.l_tag is None for s in c), n > 1 and all(s.l_tag == "Adverb" for s in c), n > 1 and nouns == n, one and c[0].r_tag == "Josa", one and not c[0].r)
    return sum(f * w for f, w in zip(facts, weights))


def best_spans(found: list[Span], score: Callable[[Span], float] = lr_score) -> list[Span]:
    """Spans by descending score as long as they don't overlap, in order; equal scores by place, longer first, then tag."""
    out: list[Span] = []
    taken = 0  # a bit for each character
    for s in sorted(found, key=lambda s: (-round(score(s), 9), s[4], -s[6], s[5], s[1] or "", s[3] or "")):
        own = (1 << s[6]) - (1 << s[4])
        if not own & taken:
            out.append(s)
            taken |= own
    return sorted(out, key=lambda s: s.b)


def with_gaps(t: str, spans: list[Span], keep_unknown: bool = False) -> list[tuple[str, str | None]]:
    """(word, tag); what lies between spans has no tag.  A token without any span disappears unless it is kept."""
    if not spans and not keep_unknown:
        return []
    out: list[tuple[str, str | None]] = []
    at = 0
    for s in [*spans, Span("", None, "", None, len(t), len(t), len(t))]:
        out += [(t[at : s.b], None)] * (at < s.b) + [(s.l, s.l_tag)] * bool(s.l) + [(s.r, s.r_tag)] * bool(s.r)
        at = s.e
    return out


def lr_tagger(d: Dictionary, preference: dict[str, dict[str, float]] | None = None, keep_unknown: bool = False) -> Callable[[str], list[tuple[str, str | None]]]:
    generate = lr_spans(d)
    return lambda t: with_gaps(t, best_spans(generate(t), lambda s: lr_score(s, preference=preference)), keep_unknown)


def eojeol_tagger(d: Dictionary) -> Callable[[str], list[tuple[str, str | None]]]:
    generate = eojeol_readings(d)
    return lambda t: with_gaps(t, max(generate(t), key=reading_score), True)


def tag(sents: DataFrame, tagger: Callable[[str], list[tuple[str, str | None]]]) -> DataFrame:
    """doc_id, sent_id, pos (of the eojeol), k, word, tag."""
    done = over_distinct(token_table(sents), "tok", tagger, "array<struct<word:string,tag:string>>")
    return done.select("doc_id", "sent_id", "pos", F.posexplode("result").alias("k", "x")).select("doc_id", "sent_id", "pos", "k", "x.word", "x.tag")


def tagset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS.items()), "tag string, label string")
