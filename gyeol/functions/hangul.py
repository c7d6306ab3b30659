"""Hangul: syllables and letters as column expressions, normalisers, distances, letter encoding.

A syllable's code point is 44032 + 588 lead + 28 vowel + tail, so composing and
decomposing is arithmetic; all of it stays in generated code.  Only functions that look
at neighbouring characters, or fill a distance table, are vectorised Python (`rows`).

Null in gives null out.  A ``c`` is the first character of its column.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import SPACES, split_words, strip

FIRST, LAST = 0xAC00, 0xD7A3
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
CONSONANT, VOWEL = (0x3131, 0x314E), (0x314F, 0x3163)
HANGUL = "ㄱ-ㅎㅏ-ㅣ가-힣"
#: What counts as text.  The range from apostrophe to opening bracket leaves the hyphen out.
TEXT = HANGUL + r"a-zA-Z0-9,.?!\"'()\[\]{}"


def rows(f: Callable, kind: str, *columns: Column | str) -> Column:
    """A Python function of one row's values, in Arrow batches; null if any value is null."""

    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in x) else f(*x) for x in zip(*cols)], dtype=object)

    return run(*columns)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code(c: Column | str) -> Column:
    """Code point of the first character."""
    return F.ascii(_col(c))


def char(point: Column) -> Column:
    """The character of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def is_syllable(c: Column | str) -> Column:
    return code(c).between(FIRST, LAST)


def is_consonant(c: Column | str) -> Column:
    return code(c).between(*CONSONANT)


def is_vowel(c: Column | str) -> Column:
    return code(c).between(*VOWEL)


def is_korean(c: Column | str) -> Column:
    return is_syllable(c) | is_consonant(c) | is_vowel(c)


def is_number(c: Column | str) -> Column:
    return code(c).between(48, 57)


def is_english(c: Column | str) -> Column:
    return code(c).between(65, 90) | code(c).between(97, 122)


def is_punctuation(c: Column | str) -> Column:
    return F.substring(_col(c), 1, 1).isin(*"!\"',.?`")


def decompose(c: Column | str) -> Column:
    """struct(cho, jung, jong) with ' ' for what is absent; null for a character that isn't Hangul."""
    c = F.substring(_col(c), 1, 1)
    at = F.ascii(c) - FIRST
    pick = lambda letters, i: F.substr(F.lit(letters), (i + 1).cast("int"), F.lit(1))
    blank = F.lit(" ")
    whole = F.struct(pick(LEADS, F.floor(at / 588)).alias("cho"), pick(VOWELS, F.floor(at % 588 / 28)).alias("jung"), pick(TAILS, at % 28).alias("jong"))
    return (
        F.when(is_syllable(c), whole)
        .when(is_consonant(c), F.struct(c.alias("cho"), blank.alias("jung"), blank.alias("jong")))
        .when(is_vowel(c), F.struct(blank.alias("cho"), c.alias("jung"), blank.alias("jong")))
    )


def compose(cho: Column | str, jung: Column | str, jong: Column | str) -> Column:
    """The syllable of three letters; null for an unknown letter."""
    i, j, k = (_place(s, _col(x)) for s, x in ((LEADS, cho), (VOWELS, jung), (TAILS, jong)))
    return F.when((i > 0) & (j > 0) & (k > 0), char(F.lit(FIRST) + (i - 1) * 588 + (j - 1) * 28 + (k - 1)))


def _place(letters: str, c: Column) -> Column:
    return F.when(F.length(c) == 1, F.position(c, F.lit(letters)))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACES + "+", " "))


def repeat_pattern(least: int, unit: str = r"\w") -> str:
    return rf"(?U)({unit})\1{{{least - 1},}}"


def collapse(c: Column, n: int, least: int = 3, unit: str = r"\w") -> Column:
    """Runs of ``least`` or more equal units cut to n; untouched for n <= 0."""
    return F.regexp_replace(c, repeat_pattern(least, unit), "$1" * n) if n > 0 else c


def clean_characters(doc: Column | str, english: bool = False, number: bool = False, punctuation: bool = False, remove_repeat: int = 0, remains: str = "") -> Column:
    """Everything but Hangul and what is asked for becomes a blank; blanks are squeezed."""
    extra = "".join("\\" + c if not c.isalnum() else c for c in remains)
    keep = HANGUL + " " + "a-zA-Z" * english + "0-9" * number + "!\"',.?`" * punctuation + extra
    return squeeze(F.regexp_replace(collapse(_col(doc), remove_repeat, 4), f"[^{keep}]", " "))


def normalize(doc: Column | str, alphabet: bool = False, number: bool = False, punctuation: bool = False, symbol: bool = False, remove_repeat: int = 0) -> Column:
    """Text characters only; then letters, digits, punctuation and symbols go unless they are asked for."""
    c = F.regexp_replace(_col(doc), f"[^{TEXT}]", " ")
    for keep, kind in ((alphabet, "[a-zA-Z]"), (number, "[0-9]"), (punctuation, "[,.?!]"), (symbol, r"[()\[\]{}`]")):
        c = c if keep else F.regexp_replace(c, kind, " ")
    return squeeze(collapse(c, remove_repeat))


def remove_doublespace(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), SPACES + "+", " ")


def repeat_normalize(c: Column | str, n: int = 2) -> Column:
    return squeeze(collapse(_col(c), n))


def only_hangle(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(_col(c), f"[^{HANGUL}]", " "))


def only_hangle_number(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(_col(c), f"[^{HANGUL}0-9]", " "))


def only_text(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(_col(c), f"[^{TEXT}]", " "))


def remain_hangle_on_last(c: Column | str) -> Column:
    """Up to the last Hangul character; '' without one."""
    return strip(F.regexp_extract(_col(c), f"(?s)^.*[{HANGUL}]", 0))


def normalize_sent_for_lrgraph(c: Column | str) -> Column:
    text = F.regexp_replace(F.regexp_replace(_col(c), f"[^{TEXT}]", " "), r"[()\[\]{}`]", " ")
    return F.array_join(F.filter(F.transform(split_words(text), remain_hangle_on_last), lambda t: t != ""), " ")


# --- functions of one value, in Python -------------------------------------------------------


def letters_of(c: str) -> tuple[str, str, str] | None:
    """(lead, vowel, tail) of a character, ' ' for what is absent."""
    p = ord(c)
    if FIRST <= p <= LAST:
        p -= FIRST
        return LEADS[p // 588], VOWELS[p % 588 // 28], TAILS[p % 28]
    if CONSONANT[0] <= p <= CONSONANT[1]:
        return c, " ", " "
    return (" ", c, " ") if VOWEL[0] <= p <= VOWEL[1] else None


def syllable(cho: str, jung: str, jong: str = " ") -> str:
    return chr(FIRST + 588 * LEADS.index(cho) + 28 * VOWELS.index(jung) + TAILS.index(jong))


def _kind(c: str) -> str:
    x = letters_of(c)
    return "-" if x is None else "v" if x[0] == " " else "c" if x[1] == " " else "s"


def split_emoticons(sent: str, compat: bool = False) -> str:
    """Syllables between letters of the same sound are taken apart.

    compat: a syllable next to a consonant letter that doesn't share its sound is lost.
    """
    kinds, out = [_kind(c) for c in sent], []
    for i, (k, c) in enumerate(zip(kinds, sent)):
        left, right = kinds[i - 1] if i else "", kinds[i + 1] if i + 1 < len(sent) else ""
        if k != "s" or "c" not in (left, right):
            out.append(c)
            continue
        cho, jung, jong = letters_of(c)
        if left == "c" and right == "v":
            same = (cho, jung, jong) == (sent[i - 1], sent[i + 1], " ")
            out.append(cho + jung if same else c)
        elif right == "c":
            out.append(syllable(cho, jung) + jong if jong == sent[i + 1] else "" if compat else c)
        else:
            out.append(cho + jung if cho == sent[i - 1] else "" if compat else c)
    return "".join(out)


def emoticon_normalize(c: Column | str, n: int = 2, compat: bool = False) -> Column:
    return repeat_normalize(rows(lambda s: split_emoticons(s, compat), "string", _col(c)), n)


def _token_emoji(token: str) -> str:
    parts = [letters_of(c) for c in token]
    out = []
    for c, a, b in zip(token, parts, parts[1:]):
        if a and b and b[1] == " " and a[2] == b[0]:
            out.append((syllable(a[0], a[1]) if a[0] != " " and a[1] != " " else c) + b[0])
        elif a and b and a[2] == " " == b[0] and a[1] == b[1]:
            out.append(a[0].strip() + a[1])
        else:
            out.append(c)
    return "".join(out) + token[-1:]


def normalize_tokens(c: Column | str, n: int = 2) -> Column:
    """Token by token: emoticons taken apart, then four or more repeats of 4, 3, 2 or 1 characters cut to n."""
    x = rows(lambda s: " ".join(map(_token_emoji, s.split())), "string", _col(c))
    for size in (4, 3, 2, 1):
        x = collapse(x, n, 4, r"\w" * size)
    return x


def edit_distance(a: str, b: str, cost: Callable[[str, str], float]) -> float:
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y else cost(x, y))))
        row = new
    return row[-1]


def levenshtein(a: Column | str, b: Column | str, cost: dict[tuple[str, str], float] | None = None) -> Column:
    """Edit distance; ``cost`` has substitution costs, in either order of the strings."""
    if not cost:
        return F.levenshtein(_col(a), _col(b)).cast("double")
    return rows(lambda x, y: edit_distance(x, y, lambda p, q: cost.get((p, q), cost.get((q, p), 1.0))), "double", _col(a), _col(b))


def _letter_cost(x: str, y: str) -> float:
    p, q = letters_of(x), letters_of(y)
    return 1.0 if p is None or q is None else edit_distance(p, q, lambda *_: 1.0) / 3


def jamo_levenshtein(a: Column | str, b: Column | str) -> Column:
    """Substituting a syllable costs a third of the distance of its letters."""
    return rows(lambda x, y: edit_distance(x, y, _letter_cost), "double", _col(a), _col(b))


def _units(c: Column) -> Column:
    """Characters; also those beyond 65535, which a regular expression would cut in two."""
    return F.split(c, "")


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine of character counts; 2 if either is empty."""
    a, b = _col(a), _col(b)
    x, y = _units(a), _units(b)
    count = lambda arr, u: F.size(F.filter(arr, lambda v: v == u)).cast("double")
    total = lambda arr, f: F.aggregate(F.array_distinct(arr), F.lit(0.0), lambda s, u: s + f(u))
    dot = total(x, lambda u: count(x, u) * count(y, u))
    norm = F.sqrt(total(x, lambda u: count(x, u) * count(x, u)) * total(y, lambda u: count(y, u) * count(y, u)))
    return F.when(a.isNull() | b.isNull(), None).when((a == "") | (b == ""), 2.0).otherwise(1 - dot / norm)


def jaccard_distance(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    x, y = _units(a), _units(b)
    return F.when(a.isNull() | b.isNull(), None).when((a == "") | (b == ""), 1.0).otherwise(1 - F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


# --- 80 symbols: leads 0-18, vowels 19-39, tails 40-67, digits 68-77, blank 78, unknown 79 ----

SPACE_ID, UNKNOWN_ID, DIMENSIONS = 78, 79, 80
_SINGLE = {c: i for i, c in reversed(list(enumerate(LEADS + VOWELS + TAILS)))}
_SINGLE |= {str(d): 68 + d for d in range(10)} | {" ": SPACE_ID}


def encode(c: Column | str) -> Column:
    """array<array<int>>: three symbols for a syllable, one for anything else, after blanking what isn't Hangul or a digit."""
    text = squeeze(F.regexp_replace(_col(c), f"[^{HANGUL} 0-9]", " "))
    single = F.create_map(*[F.lit(v) for kv in _SINGLE.items() for v in kv])

    def one(u: Column) -> Column:
        at = F.ascii(u) - FIRST
        whole = F.array(F.floor(at / 588).cast("int"), (F.floor(at % 588 / 28) + 19).cast("int"), (at % 28 + 40).cast("int"))
        return F.when(is_syllable(u), whole).otherwise(F.array(F.coalesce(single[u], F.lit(UNKNOWN_ID))))

    return F.transform(F.filter(_units(text), lambda u: u != ""), one)


def decode(c: Column | str) -> Column:
    """Text of encoded symbols; '<unk>' for one that can't be read."""
    table = F.array(*[F.lit(s) for s in [*(LEADS + VOWELS + TAILS), *"0123456789", " ", "<unk>"]])

    def one(u: Column) -> Column:
        at = lambda i: F.try_element_at(u, F.lit(i))
        ok = (F.size(u) == 3) & at(1).between(0, 18) & at(2).between(19, 39) & at(3).between(40, 67)
        lone = (F.size(u) == 1) & at(1).between(0, DIMENSIONS - 1)
        return F.when(ok, char(F.lit(FIRST) + at(1) * 588 + (at(2) - 19) * 28 + at(3) - 40)).when(lone, F.try_element_at(table, at(1) + 1)).otherwise("<unk>")

    return F.array_join(F.transform(_col(c), one), "")
