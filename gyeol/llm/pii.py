"""Personal data by a semi-Markov conditional random field (operator 5).

A text's units are runs of letters and digits, and single other characters.  A
segmentation covers the units by single-unit outside segments and by entities of
at most ``LONGEST`` units.  An entity is scored by features of the whole span
(its shape, checksums, what touches it and the words before it) and by the types
of adjacent segments; dynamic programming over segment ends chooses boundaries and
types jointly.  Weights are fitted by conditional likelihood (forward-backward over
segments) on sentences made here with known spans.

An entity contains a digit or '@'; one of digits and signs alone has at most ``NUMBER``
characters, one with white space at most ``SPACED``.  There is white space inside only between digits,
signs and brackets, or between the groups of an IBAN (of digits and capitals).  So
segments are scored inside maximal runs of words that hold a digit or '@', with single
words in capitals between them; elsewhere every segmentation but the outside one is
impossible, and the scan that finds the runs is vectorised.  The best segmentation is
pushed forward from unit to unit, so that only the spans of one start are held at once.

Defined cases: rows without doc_id or text, and empty texts, give nothing.  Equal
rows give equal results, once each, and rows that share a doc_id but not the text each
give their own.  Texts of any length are scanned whole, in time and memory in proportion.
An empty table gives none.  Columns are taken by name, whatever others are called.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed
from .textcore import chunks, python_positions, tokens

TYPES = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN", "SECRET", "IBAN")
LONGEST = 16
#: Characters of an entity without a letter and '@', and of one with white space inside (an IBAN in groups).
NUMBER, SPACED = 24, 42
_UNIT = re.compile(r"[^\W_]+|\S")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[48:58] = True
_TRIGGER[ord("@")] = True
_JOIN = set("+-().")
_SSN, _FOURS = re.compile(r"\d{3}-\d{2}-\d{4}", re.ASCII), re.compile(r"\d{4}([ -]\d{4}){3}", re.ASCII)
_PHONE = re.compile(r"(\+\d{1,3}[ .-]?)?(\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}", re.ASCII)
_IBAN, _IBAN_HEAD, _IBAN_PART = re.compile(r"[A-Za-z]{2}\d\d( \w{4})+( \w{1,4})?", re.ASCII), re.compile(r"[A-Z]{2}\d\d"), re.compile(r"[A-Z0-9]{1,4}")
_HINTS = {"token": "secret", "secret": "secret", "key": "secret", "password": "secret", "apikey": "secret", "passwd": "secret", "bearer": "secret", "card": "card", "visa": "card", "credit": "card", "ssn": "ssn", "social": "ssn", "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "ip": "ip", "host": "ip", "mail": "email", "email": "email", "iban": "iban", "account": "iban", "version": "version", "v": "version", "page": "version", "chapter": "version", "order": "version", "section": "version"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    r = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in r)) % 97 == 1


@lru_cache(maxsize=50_000)
def shape_features(span: str) -> tuple[str, ...]:
    """Features of the span alone."""
    digits = [c for c in span if "0" <= c <= "9"]
    nd, letters = len(digits), sum(c.isalpha() for c in span)
    at, dots = span.count("@"), span.count(".")
    punct = "".join(sorted({c for c in span if not c.isalnum()}))[:8]
    f = [f"punct:{punct}", f"digits:{min(nd, 20) if nd < 8 else 8 + (nd - 8) // 2 * 2 if nd < 20 else 20}", f"letters:{0 if not letters else 1 if letters < 4 else 2 if letters < 16 else 3}", f"at:{min(at, 2)}", f"dots:{min(dots, 4)}"]
    if at == 1:
        name, _, domain = span.partition("@")
        parts = domain.split(".")
        ok = bool(name) and name[0].isalnum() and name[-1].isalnum() and len(parts) > 1 and all(parts) and parts[-1].isalpha() and len(parts[-1]) > 1 and not (set(span) - set("@.-_+") - {c for c in span if c.isalnum()})
        f.append(f"mail:{ok}")
    if span.count(".") == 3 and not letters and punct == ".":
        parts = span.split(".")
        f.append(f"octets:{all(p and len(p) < 4 and int(p) < 256 for p in parts)}")
    bare = re.sub(r"[ -]", "", span)
    if bare.isdigit() and bare.isascii():
        if 13 <= len(bare) <= 19:
            f += [f"luhn:{luhn(bare)}", f"card-like:{len(bare) in (15, 16)}"]
    if nd == 9 and len(span) == 11 and _SSN.fullmatch(span):
        f.append("3-2-4")
    if nd == 16 and len(span) == 19 and _FOURS.fullmatch(span):
        f.append("4-4-4-4")
    if not letters and 8 <= nd <= 15 and _PHONE.fullmatch(span):
        f.append("phone" + ("+" if span[0] == "+" else "(" if span[0] == "(" else ""))
    if span.isalnum() and span.isascii() and nd and letters:
        f.append(f"mixed:{min(len(span) // 8, 6)}")
        if re.fullmatch(r"[0-9a-fA-F]+", span):
            f.append(f"hex:{min(len(span) // 8, 6)}")
        if 15 <= len(span) <= 34 and re.fullmatch(r"[A-Za-z]{2}\d\d\w+", span):
            f.append(f"iban:{iban_ok(span.upper())}")
    elif letters > 1 and _IBAN.fullmatch(span):
        f.append(f"iban:{iban_ok(span.replace(' ', '').upper())}")
    if letters and nd and re.fullmatch(r"[\w-]{16,}", span, re.ASCII):
        f.append(f"key:{min(len(span) // 8, 6)}")
    return tuple(f)


class Island:
    """The units of one run of words, and the candidate spans from each with their features."""

    def __init__(self, text: str, before: str):
        found = list(_UNIT.finditer(text))
        self.text = text
        self.start = [m.start() for m in found]
        self.end = [m.end() for m in found]
        self.unit = [m.group() for m in found]
        words = re.findall(r"[^\W_]+", before.lower())[-3:]
        self.lead = [x for w in words if (x := _HINTS.get(w))]

    def outside(self, i: int) -> tuple[str, ...]:
        u = self.unit[i]
        return (f"o:{'d' + str(min(len(u), 5)) if u.isdigit() else 'a' if u.isalpha() else 'm' if u.isalnum() else u if u in '@.-+()' else 'p'}",)

    def _gap(self, j: int, iban: bool) -> bool:
        """True if an entity may go on over the white space before unit j."""
        v, w = self.unit[j], self.unit[j - 1]
        if self.start[j] - self.end[j - 1] > 1 or self.text[self.end[j - 1]] == "\n":
            return False
        if iban and _IBAN_PART.fullmatch(v):
            return True
        digit = lambda u: u[0].isdigit() or u in _JOIN or (u.isalnum() and any(c.isdigit() for c in u))
        return digit(w) and digit(v)

    def candidates(self, i: int) -> Iterator[tuple[int, tuple[str, ...]]]:
        """(end, features) of the entities that may start at unit i."""
        n, unit, text = len(self.unit), self.unit, self.text
        u = unit[i]
        if not (u.isalnum() or u in "+("):
            return
        trigger, plain, spaced, iban = False, True, False, _IBAN_HEAD.fullmatch(u) is not None
        tight = i > 0 and self.end[i - 1] == self.start[i]
        left = "left:" + ((unit[i - 1] if not unit[i - 1].isalnum() and unit[i - 1] in ".-@+(_/:" else "w" if unit[i - 1].isalnum() else "q") if tight else "space")
        hint = self.lead if i < 2 else [x for k in range(max(0, i - 4), i) if (x := _HINTS.get(unit[k].lower()))] or (self.lead if i < 4 else [])
        hints = tuple(f"hint:{h}" for h in hint[-1:])
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            v = unit[j - 1]
            if j - 1 > i and self.start[j - 1] > self.end[j - 2]:
                if not self._gap(j - 1, iban):
                    return
                spaced = True
            size = self.end[j - 1] - self.start[i]
            plain = plain and not (v.isalpha() or v == "@" or (v.isalnum() and not v.isdigit()))
            if size > (NUMBER if plain else SPACED if spaced else size):
                return
            trigger = trigger or v == "@" or any("0" <= c <= "9" for c in v)
            if not trigger or not v.isalnum():
                continue
            tail = j < n and self.start[j] == self.end[j - 1]
            nxt = unit[j] if tail else ""
            more = tail and j + 1 < n and self.start[j + 1] == self.end[j] and unit[j + 1].isalnum()
            right = "right:" + ("space" if not tail else "w" if nxt.isalnum() else (nxt + "w" if nxt in ".-@_/:" and more else "q"))
            yield j, (*shape_features(text[self.start[i] : self.end[j - 1]]), left, right, *hints)


class SemiCRF:
    def __init__(self) -> None:
        self.w: dict[str, np.ndarray] = {}
        self.transition = np.zeros((len(TYPES), len(TYPES)))

    def _score(self, features: tuple[str, ...], entity: bool) -> np.ndarray:
        s = np.zeros(len(TYPES))
        for f in features:
            if (v := self.w.get(f)) is not None:
                s += v
        if entity:
            s[0] = -np.inf
        else:
            s[1:] = -np.inf
        return s

    def _edges(self, x: Island) -> list[list[tuple[int, tuple[str, ...], np.ndarray]]]:
        """Segments by their end: (start, features, scores)."""
        out = [[] for _ in range(len(x.unit) + 1)]
        for i in range(len(x.unit)):
            f = x.outside(i)
            out[i + 1].append((i, f, self._score(f, False)))
            for j, f in x.candidates(i):
                out[j].append((i, f, self._score(f, True)))
        return out

    def segments(self, x: Island) -> list[tuple[int, int, int, float]]:
        """(first unit, end, type, score) of the entities of the best segmentation."""
        n, k = len(x.unit), len(TYPES)
        known: dict[tuple, np.ndarray] = {}  # scores by features: few shapes, many spans
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0
        back, kind, score = np.zeros((n + 1, k), np.int8), np.zeros((n + 1, k), np.int8), np.zeros((n + 1, k), np.float32)
        for i in range(n):
            step = best[i][:, None] + self.transition
            p = step.argmax(axis=0)
            top = step[p, np.arange(k)]
            f = x.outside(i)
            for j, f, entity in ((i + 1, f, False), *((j, f, True) for j, f in x.candidates(i))):
                s = known.get(f)
                if s is None:
                    if len(known) > 50_000:
                        known.clear()
                    s = known[f] = self._score(f, entity)
                total = top + s
                better = total > best[j]
                if better.any():
                    best[j][better] = total[better]
                    back[j][better], kind[j][better], score[j][better] = j - i, p[better], s[better]
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i = j - int(back[j, y])
            if y:
                out.append((i, j, y, float(score[j, y])))
            j, y = i, int(kind[j, y])
        return out[::-1]

    def fit(self, data: list[tuple[Island, dict[tuple[int, int], int]]], epochs: int = 6, rate: float = 0.4, l2: float = 1e-3) -> None:
        """Stochastic ascent (AdaGrad) of the conditional log-likelihood."""
        grad2: dict[str, np.ndarray] = {}
        t2 = np.full_like(self.transition, 1e-2)
        order = random.Random(5)
        for _ in range(epochs):
            order.shuffle(data)
            for x, gold in data:
                n, edges = len(x.unit), self._edges(x)
                a = np.full((n + 1, len(TYPES)), -np.inf)
                a[0, 0] = 0
                for j in range(1, n + 1):
                    a[j] = np.logaddexp.reduce([np.logaddexp.reduce(a[i][:, None] + self.transition, axis=0) + s for i, _, s in edges[j]], axis=0)
                b = np.full((n + 1, len(TYPES)), -np.inf)
                b[n] = 0
                z = np.logaddexp.reduce(a[n])
                g: dict[str, np.ndarray] = {}
                gt = np.zeros_like(self.transition)
                for j in range(n, 0, -1):
                    for i, f, s in edges[j]:
                        with np.errstate(invalid="ignore"):
                            m = np.exp(a[i][:, None] + self.transition + (s + b[j])[None] - z)
                        gt -= m
                        p = m.sum(axis=0)
                        for k in f:
                            g[k] = g.get(k, 0) - p
                        b[i] = np.logaddexp(b[i], np.logaddexp.reduce(self.transition + (s + b[j])[None], axis=1))
                at, last = 0, 0
                inside = {i: (j, y) for (i, j), y in gold.items()}
                while at < n:
                    j, y = inside.get(at, (at + 1, 0))
                    f = next((f for i, f, _ in edges[j] if i == at and len(f) > 1), None) if y else x.outside(at)
                    if f is None:
                        break
                    one = np.zeros(len(TYPES))
                    one[y] = 1
                    for k in f:
                        g[k] = g.get(k, 0) + one
                    gt[last, y] += 1
                    at, last = j, y
                if at < n:
                    continue
                for k, v in g.items():
                    w = self.w.setdefault(k, np.zeros(len(TYPES)))
                    v = v - l2 * w
                    h = grad2.setdefault(k, np.full(len(TYPES), 1e-2))
                    h += v * v
                    w += rate * v / np.sqrt(h)
                t2 += gt * gt
                self.transition += rate * gt / np.sqrt(t2)


def _examples(count: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with the spans of their entities."""
    r = random.Random(seed)
    pick = r.choice
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(pick(letters) for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(pick("0123456789") for _ in range(n))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c)) if r.random() < 0.6 else pick("0123456789")
        return d if r.random() < 0.6 else pick("- ").join(d[i : i + 4] for i in range(0, 16, 4))

    def iban() -> str:
        cc = pick(("DE", "DE", "FR", "ES", "GB", "NL", "IE"))
        bank = "".join(pick(letters).upper() for _ in range(4))
        body = {"DE": num(18), "FR": num(23), "ES": num(20), "GB": bank + num(14), "NL": bank + num(10), "IE": bank + num(14)}[cc]
        check = 98 - int("".join(str(int(c, 36)) for c in body) + "".join(str(int(c, 36)) for c in cc) + "00") % 97
        s = f"{cc}{check:02d}{body}"
        return s if r.random() < 0.6 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}"))

    def email() -> str:
        name = pick((word(), f"{word()}.{word()}", f"{word()}.{num(2)}", f"{word()}{num(r.randint(1, 3))}", f"{word()}_{word()}", f"{word()}+{word()}"))
        return f"{name}@{pick((word(), f'mail{num(1)}.{word()}', f'{word()}-{word()}'))}.{pick(('com', 'org', 'net', 'de', 'co.uk', 'fr', 'io'))}"

    def secret() -> str:
        hexa = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))
        mixed = lambda n: "".join(pick(letters + letters.upper() + "0123456789") for _ in range(n))
        return pick((hexa(40), hexa(32), hexa(64), mixed(24) + num(1), "AKIA" + mixed(15).upper() + num(1), "sk_live_" + mixed(22) + num(2), "ghp_" + mixed(35) + num(1)))

    made = {"EMAIL": email, "PHONE": phone, "IP": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "CARD": card, "SSN": lambda: f"{num(3)}-{num(2)}-{num(4)}", "SECRET": secret, "IBAN": iban}
    lead = {"EMAIL": ("mail", "contact", "email:"), "PHONE": ("phone", "call", "tel:"), "IP": ("host", "ip", "from"), "CARD": ("card", "visa:"), "SSN": ("ssn", "ssn:"), "SECRET": ("token =", "password:", "key =", "secret:"), "IBAN": ("iban", "account")}
    plain = (
        lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}", lambda: str(r.randint(1, 99999)), lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda: f"${r.randint(1, 999)}.{num(2)}", lambda: f"{r.randint(0, 23):02d}:{num(2)}", lambda: num(r.randint(6, 9)), lambda: f"{word()}{r.randint(1, 99)}", lambda: f"@{word()}", lambda: f"{r.randint(1, 99)}%", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}",
        lambda: "".join(pick("0123456789abcdef") for _ in range(7)), lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{r.randint(1, 40)}-{r.randint(41, 90)}", lambda: f"{word()}.{num(2)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: " ".join(num(r.randint(1, 3)) for _ in range(r.randint(2, 5))),
        lambda: " ".join(num(r.randint(1, 6)) for _ in range(r.randint(3, 14))), lambda: " ".join(f"{num(r.randint(1, 3))}.{num(r.randint(1, 2))}" for _ in range(r.randint(2, 8))),
    )
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(1, 3))) + " "
            if r.random() < 0.6:
                kind = pick(list(made))
                if r.random() < 0.4:
                    text += pick(lead[kind]) + " "
                s = made[kind]()
                if r.random() < 0.12 and kind in ("EMAIL", "SECRET"):
                    s = s.upper()
                quote = pick(('"', "'", "(", "<", "[", "=")) if r.random() < 0.2 else ""
                if quote == "(" and s[0] == "(":
                    quote = ""
                text += quote
                spans.append((len(text), len(text) + len(s), kind))
                text += s + (pick((".", ",", '"', ";", "!!", "***", "$$$", "###", "%%%", "&&&", ")", ">")) if r.random() < 0.45 else "")
            else:
                if r.random() < 0.3:
                    text += pick(("version", "page", "order", "chapter", "v")) + " "
                text += pick(plain)() + (pick((".", ",", "!!", "***", "$$$", ")")) if r.random() < 0.3 else "")
            text += pick((" ", " ", " ", "\n"))
        yield text, spans


def islands(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, str, str]]:
    """(row, first byte, text, text before) of the runs of words with a digit or '@'."""
    at = np.flatnonzero(_TRIGGER[data])
    if not len(at):
        return
    s, e, row = tokens(data, off)
    hot = np.unique(np.searchsorted(s, at, "right") - 1)
    # a word of up to four capitals between two such words belongs to them, too
    gap = hot[:-1][np.diff(hot) == 2] + 1
    lower = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data < 65) | (data > 90), out=lower[1:])
    gap = gap[(e[gap] - s[gap] <= 4) & (lower[e[gap]] == lower[s[gap]])]
    hot = np.union1d(hot, gap)
    same = (np.diff(hot) == 1) & (row[hot[1:]] == row[hot[:-1]])
    near = same & (s[hot[1:]] - e[hot[:-1]] == 1) & (data[np.minimum(e[hot[:-1]], len(data) - 1)] == 32)
    begin = np.flatnonzero(np.concatenate([[True], ~near]))
    end = np.append(begin[1:], len(hot)) - 1
    for a, b in zip(hot[begin], hot[end]):
        k = a
        while k and a - k < 3 and row[k - 1] == row[a]:
            k -= 1
        yield int(row[a]), int(s[a]), data[s[a] : e[b]].tobytes().decode(), data[s[k] : s[a]].tobytes().decode()


def labelled(count: int, seed: int) -> list[tuple[Island, dict[tuple[int, int], int]]]:
    out = []
    for text, spans in _examples(count, seed):
        raw = np.frombuffer(text.encode(), np.uint8)
        for _, s, part, before in islands(raw, np.array([0, len(raw)])):
            x, gold = Island(part, before), {}
            for a, b, kind in spans:
                if a - s in x.start and b - s in x.end:
                    gold[x.start.index(a - s), x.end.index(b - s) + 1] = TYPES.index(kind)
            out.append((x, gold))
    return out


@lru_cache(maxsize=2)
def model(sentences: int = 500, seed: int = 3) -> SemiCRF:
    crf = SemiCRF()
    crf.fit(labelled(sentences, seed))
    return crf


def entities(data: np.ndarray, off: np.ndarray, crf: SemiCRF) -> list[tuple[int, int, int, str, str, float]]:
    """(row, first byte, end byte, type, span, score)."""
    out = []
    for row, s, text, before in islands(data, off):
        x = Island(text, before)
        done, at = 0, s  # characters and bytes so far
        for i, j, y, score in crf.segments(x):
            a, b = x.start[i], x.end[j - 1]
            lead = at + len(text[done:a].encode())
            done, at = b, lead + len(text[a:b].encode())
            out.append((row, lead, at, TYPES[y], text[a:b], score))
    return out


def find_pii(docs: DataFrame, crf: SemiCRF | None = None) -> DataFrame:
    """doc_id, start, end (characters), type, span and score of every entity."""
    docs = keyed(docs, "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    crf = crf or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], [[] for _ in range(5)]
            for a, _, data, off in chunks(b.column(1)):
                last, pos = -1, None
                for row, s, e, y, span, score in entities(data, off, crf):
                    if row != last:
                        last, pos = row, python_positions(data[off[row] : off[row + 1]])
                    rows.append(a + row)
                    for c, v in zip(cols, (int(pos[s - off[row]]), int(pos[e - off[row]]), y, span, round(score, 4))):
                        c.append(v)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "start", "end", "type", "span", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, start int, end int, type string, span string, score double")
