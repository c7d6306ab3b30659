"""Korean predicates: surfaces of a stem with an ending, lemmas of a surface.

The rules are functions of one (stem, ending) pair; ``conjugated`` and the others apply
them in Arrow batches, to distinct pairs.  Surfaces come sorted.  A stem or ending whose
letters the rules can't take apart (null, empty, not Hangul) has no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hangul import LEADS, TAILS, VOWELS, letters_of

BRIGHT, DARK = "ㅏㅑㅗㅛ", "ㅓㅕㅜㅠ"
#: Tails that an ending can begin with.
TAIL_ENDINGS = "ㄴㄹㅁㅂㅆ"
ADJECTIVE_ENDS = ("같", "답", "롭", "만하", "스럽", "시럽", "이", "아니")
VERB_ENDS = ("거리", "당하", "당허", "시키")


class Unfit(ValueError):
    """Letters that don't make a syllable."""


def _syl(cho: str, jung: str, jong: str = " ") -> str:
    i, j, k = LEADS.find(cho), VOWELS.find(jung), TAILS.find(jong)
    if min(i, j, k) < 0 or not (cho and jung and jong):
        raise Unfit(f"{cho}{jung}{jong}")
    return chr(0xAC00 + 588 * i + 28 * j + k)


def _parts(c: str) -> tuple[str, str, str]:
    x = letters_of(c)
    if x is None:
        raise Unfit(c)
    return x


def _harmony(stem: tuple[str, str, str], ending: str) -> str:
    """The ending with the vowel that agrees with the stem."""
    first = list(_parts(ending[0]))
    vowel, silent = first[1], first[0] == "ㅇ"
    if stem[2] != "ㅂ" and silent and stem[1] in BRIGHT and vowel in DARK:
        first[1] = BRIGHT[DARK.index(vowel)]
    elif stem[2] != "ㅂ" and silent and stem[1] in DARK and vowel in BRIGHT:
        first[1] = DARK[BRIGHT.index(vowel)]
    if stem[1] in "ㅡㅣ" and first[1] in BRIGHT:
        first[1] = DARK[BRIGHT.index(first[1])]
    return _syl(*first) + ending[1:] if first[1] != vowel else ending


def _irregular(stem: str, ending: str) -> Iterator[str]:
    """Every surface that a rule gives; the regular one only where a rule keeps it."""
    front, last, rest = stem[:-1], stem[-1], ending[1:]
    cho, jung, jong = _parts(last)
    e_cho, e_jung, e_jong = _parts(ending[0])
    letter = e_jung == " "  # the ending begins with a consonant letter
    open_, silent = jong == " ", e_cho == "ㅇ" and not letter
    head = ending[0] if letter or e_cho == " " else _syl(e_cho, e_jung)
    a, eo = head == "아", head == "어"
    if ending[0] == "다":
        yield stem + ending
    if jong == "ㄷ" and e_cho == "ㅇ":  # walk: the tail softens before a vowel
        yield front + _syl(cho, jung, "ㄹ") + ending
        yield stem + ending
    if last == "르" and len(stem) > 1 and stem[-2:] != "푸르" and (a or eo):  # doubled l
        before = _parts(stem[-2])
        yield stem[:-2] + _syl(before[0], before[1], "ㄹ") + _syl("ㄹ", e_jung, e_jong) + rest
    if jong == "ㅂ":
        bare = front + _syl(cho, jung)
        if a or eo:
            dark = eo or (len(stem) > 1 and last in "답곱깝롭")
            yield bare + _syl("ㅇ", "ㅝ" if dark else "ㅘ", e_jong) + rest
        elif e_cho == "ㅇ":
            yield bare + ending
    if letter and e_cho in TAIL_ENDINGS:
        yield front + _syl(cho, jung, e_cho) + rest
    if jong == "ㅅ" and e_cho == "ㅇ":
        yield (stem if last == "벗" else front + _syl(cho, jung)) + ending
    if open_ and jung == "ㅜ" and silent and e_jung == "ㅓ":
        yield front + ("퍼" if last == "푸" else _syl(cho, "ㅝ", e_jong)) + rest
    if open_ and jung == "ㅗ" and silent and e_jung == "ㅏ":
        yield front + _syl(cho, "ㅘ", e_jong) + rest
    if open_ and jung == "ㅡ" and e_cho == "ㅇ":
        if cho == "ㅇ" and front:
            yield front + ending
        elif cho != "ㄹ":
            yield front + _syl(cho, e_jung, e_jong) + rest
    if ending[:2] in ("어라", "아라"):
        swap = {"오": (front, "와"), "우": (front, "워"), "가": (stem, "")}
        l, r = swap.get(last, (stem, "어" if jung in DARK else "아"))
        yield l + r + rest
    if last == "르" and stem[-2:] != "구르" and silent and e_jung == "ㅓ":
        yield stem + _syl("ㄹ", e_jung, e_jong) + rest
    if last == "하" and silent and e_jung in "ㅏㅓ":
        yield stem + _syl("ㅇ", "ㅕ", e_jong) + rest
        yield front + _syl("ㅎ", "ㅐ", e_jong) + rest
    if jong == "ㅎ":
        if not letter:
            yield (stem if last in "좋놓" else front + _syl(cho, jung)) + ending
        # a dark vowel contracts after any consonant
        if last != "좋" and ((silent and e_jung == "ㅏ") or e_jung == "ㅓ"):
            yield front + _syl(cho, "ㅐ" if e_jung == "ㅏ" else "ㅔ", e_jong) + rest
        if e_cho == "ㄴ" and not letter:
            yield stem + ending
    if eo and open_ and jung == "ㅣ":
        yield front + _syl(cho, "ㅕ", e_jong) + rest
        yield stem + ending


def conjugate(stem: str, ending: str, harmony: bool = False) -> set[str]:
    """Surfaces of a stem with an ending; the plain joint only if no rule applies."""
    if not stem or not ending:
        raise Unfit("empty")
    if harmony:
        ending = _harmony(_parts(stem[-1]), ending)
    out = set(_irregular(stem, ending))
    cho, jung, jong = _parts(stem[-1])
    e_cho, e_jung, e_jong = _parts(ending[0])
    if not out and e_jung != " ":
        merges = jong == " " and e_cho == "ㅇ" and e_jung == jung
        out.add(stem[:-1] + _syl(cho, jung, e_jong) + ending[1:] if merges else stem + ending)
    return out


def conjugate_chat(stem: str, ending: str, harmony: bool = False) -> set[str]:
    """As conjugate; any consonant letter becomes the stem's tail, and an empty ending leaves the stem."""
    if not ending:
        return {stem}
    out = conjugate(stem, ending, harmony)
    first = _parts(ending[0])
    if first[1] == " " and first[0] != " ":
        cho, jung, _ = _parts(stem[-1])
        out.add(stem[:-1] + _syl(cho, jung, first[0]) + ending[1:])
    return out


def stem_surfaces(stem: str) -> set[str]:
    """What the stem can look like in front of an ending, or with the ending's first letter."""
    front, last = stem[:-1], stem[-1]
    cho, jung, jong = _parts(last)
    out = {stem}
    add = lambda vowel, tails: out.update(front + _syl(cho, vowel, t) for t in tails)
    if jong == "ㄷ":
        add(jung, "ㄹ")
    if last == "르" and front:
        before = _parts(stem[-2])
        out.add(stem[:-2] + _syl(before[0], before[1], "ㄹ"))
    if jong == "ㅂ" or (jong == "ㅅ" and last != "벗"):
        add(jung, " ")
    if jong == " ":
        add(jung, "ㄴㄹㅂㅆ")
        merged = {"ㅜ": "" if last == "푸" else "ㅝ", "ㅗ": "ㅘ", "ㅡ": "ㅓ"}.get(jung)
        if merged:
            add(merged, " ㅆ")
        if jung == "ㅡ" and cho == "ㅇ" and front:
            out.add(front)
        if jung == "ㅣ":
            add("ㅕ", "ㅆ")
    if last == "하":
        out |= {front + "해", front + "했"}
    if jong == "ㅎ" and last != "좋":
        add(jung, " ㄴㄹㅆ")
        add("ㅐ", "ㅆ")
    return out


def _guesses(l: str, r: str) -> Iterator[tuple[str, str]]:
    """(stem, ending) pairs that some rule could have made l + r of."""
    front = l[:-1]
    cho, jung, jong = _parts(l[-1])
    e_cho, e_jung, e_jong = _parts(r[0]) if r else ("", "", "")
    head = _syl(e_cho, e_jung) if r and e_cho in LEADS and e_jung in VOWELS else ""
    yield l, r
    if jong == "ㄹ" and e_cho == "ㅇ":
        yield front + _syl(cho, jung, "ㄷ"), r
    if jong == "ㄹ" and head and head in "러라":
        yield front + _syl(cho, jung) + "르", _syl("ㅇ", e_jung, e_jong) + r[1:]
    if jong == " ":
        stem = front + _syl(cho, jung, "ㅂ")
        if head and head in "워와":
            yield stem, _syl("ㅇ", "ㅏ" if head == "와" else "ㅓ", e_jong) + r[1:]
        elif r[1:2] == "려":
            yield stem, _syl("ㅇ", "ㅜ", e_jong) + r[1:]
        else:
            yield stem, r
        if e_cho == "ㅇ":
            if l[-1] != "벗":
                yield front + _syl(cho, jung, "ㅅ"), r
            if e_jung and e_jung in "ㅏㅓ":
                yield l + "으", r
    if jong in TAIL_ENDINGS:
        for tail in " ㄹㅂㅎ":
            if tail != jong:
                yield front + _syl(cho, jung, tail), jong + r
    merged = {"ㅝ": ("ㅜ", "ㅓ"), "ㅘ": ("ㅗ", "ㅏ"), "ㅓ": ("ㅡ", "ㅓ"), "ㅏ": ("ㅡ", "ㅏ")}.get(jung)
    if merged:
        yield front + _syl(cho, merged[0]), _syl("ㅇ", merged[1], jong) + r
    if cho == "ㅍ" and jung == "ㅓ":
        yield front + "푸", _syl("ㅇ", jung, jong) + r
    if cho == "ㅎ" and jung == "ㅐ":
        yield front + "하", _syl("ㅇ", "ㅏ", jong) + r
    if jong in " ㄴㄹㅂㅆ":
        if jung in "ㅏㅓ":
            yield front + _syl(cho, jung, "ㅎ"), (r if jong == " " else jong + r)
        if jung in "ㅐㅔ":
            vowel = "ㅓ" if jung == "ㅔ" else "ㅏ"
            special = len(l) > 1 and l[-2] == "그" and cho == "ㄹ"
            yield front + ("렇" if special else _syl(cho, vowel, "ㅎ")), _syl("ㅇ", vowel, jong) + r
    if jung == "ㅕ" and jong in "ㅆㅅ ":
        yield front + _syl(cho, "ㅣ"), _syl("ㅇ", "ㅓ", jong) + r


def lemma_candidates(l: str, r: str, predefined: dict[str, Iterable[tuple[str, str]]] | None = None) -> set[tuple[str, str]]:
    """Guesses with an ending that conjugate to l + r, and those given for the word beforehand."""
    out, word = set(), l + r
    try:
        guesses = list(_guesses(l, r)) if l else []
    except Unfit:
        guesses = []
    for stem, ending in guesses:
        try:
            if ending and _parts(ending[0])[2] != "ㅎ" and word in conjugate(stem, ending):
                out.add((stem, ending))
        except Unfit:
            continue
    return out | {tuple(x) for x in (predefined or {}).get(word, ())}


def lemma_candidates_chat(l: str, r: str, predefined: dict | None = None) -> set[tuple[str, str]]:
    """Also without a tail that looks like an emoticon, at the end of a word."""
    out = lemma_candidates(l, r, predefined)
    x = letters_of(l[-1]) if l else None
    if not r and x and x[2] in "ㄷㅂㅅㅇㅋㅎ":
        out |= lemma_candidates(l[:-1] + _syl(x[0], x[1]), r, predefined)
    return out


def present(stem: str) -> set[str]:
    """Present forms, which only a verb has."""
    first = ("ㄴ다", "ㄴ다고") if _parts(stem[-1])[2] == " " else ("는다", "는다고")
    return set().union(*(conjugate(stem, e) for e in (*first, "고있는")))


def imperative(stem: str) -> set[str]:
    return conjugate(stem, "어라" if _parts(stem[-1])[1] in "ㅓㅕ" else "아라")


def pleasure(stem: str) -> set[str]:
    return set().union(*(conjugate(stem, e) for e in ("자", "ㄹ까", "ㄹ까봐", "까", "까봐", "을까", "을까봐")))


def rule_class(c: Column | str) -> Column:
    """'Adjective' or 'Verb' where the stem's end tells, else null."""
    c = F.col(c) if isinstance(c, str) else c
    tails = (F.right(c, F.lit(1)), F.right(c, F.lit(2)))
    among = lambda words: tails[0].isin(*words) | tails[1].isin(*words)
    return F.when(among(ADJECTIVE_ENDS), "Adjective").when(among(VERB_ENDS), "Verb")


def _safely(f, *x):  # noqa: ANN001, ANN002, ANN202
    try:
        return sorted(f(*x)) if all(v is not None for v in x) else []
    except (Unfit, IndexError):
        return []


def _surfaces(f, *columns: Column | str) -> Column:  # noqa: ANN001
    @F.pandas_udf("array<string>")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([_safely(f, *x) for x in zip(*cols)], dtype=object)

    return run(*columns)


def conjugated(stem: Column | str, ending: Column | str, harmony: bool = False, chat: bool = False) -> Column:
    """array<string>: the surfaces, sorted."""
    f = conjugate_chat if chat else conjugate
    return _surfaces(lambda s, e: f(s, e, harmony), stem, ending)


def surfaces_of_stem(stem: Column | str) -> Column:
    return _surfaces(stem_surfaces, stem)


def forms(stem: Column | str, kind: str) -> Column:
    return _surfaces({"present": present, "imperative": imperative, "pleasure": pleasure}[kind], stem)


def lemmas(l: Column | str, r: Column | str, predefined: dict | None = None, chat: bool = False) -> Column:
    """array<struct<stem,ending>> of the candidates, sorted."""
    f = lemma_candidates_chat if chat else lemma_candidates

    @F.pandas_udf("array<struct<stem:string,ending:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sorted(f(x, y, predefined)) if x and y is not None else [] for x, y in zip(a, b)], dtype=object)

    return run(l, r)


def lemmatize(words: DataFrame, stems: DataFrame, endings: DataFrame | None = None, predefined: dict | None = None, chat: bool = False) -> DataFrame:
    """word, stem, ending: candidates over all cuts of each distinct word with a known stem (and a known ending)."""
    cuts = words.select("word").where(F.length("word") > 0).distinct().select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    cuts = cuts.select("word", F.expr("substr(word, 1, i)").alias("l"), F.expr("substr(word, i + 1)").alias("r"))
    found = cuts.select("word", F.inline(lemmas("l", "r", predefined, chat))).distinct()
    out = found.join(stems.select(F.col("word").alias("stem")).distinct(), "stem", "left_semi")
    if endings is not None:
        out = out.join(endings.select(F.col("word").alias("ending")).distinct(), "ending", "left_semi")
    return out.select("word", "stem", "ending")


def stem_to_adverb(c: Column | str) -> Column:
    """-ha stems become -hi adverbs; others are null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.right(c, F.lit(1)) == "하", F.regexp_replace(c, "하$", "히"))
