"""Line dedup against a comparison of all pairs of lines."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gyeol.llm import linededup


def within(a, b):
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return 2
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return 1 if a[i + (len(a) == len(b)) :] == b[i + 1 :] else 2


def brute(rows, least):
    lines = sorted({(d, k, x.strip(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f")) for d, t, *_ in rows if d is not None and t is not None for k, x in enumerate(t.split("\n"))})
    lines = [x for x in lines if len(x[2]) >= least]
    firsts = {}
    for d, k, t in lines:
        firsts.setdefault(t, (d, k))
    out = set()
    for d, k, t in lines:
        near = [p for s, p in firsts.items() if within(s, t) <= 1]
        best = min(near)
        if best < (d, k):
            out.add((d, k, *best, 0 if firsts[t] == best else 1))
    return out


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdé 한"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 14))).strip() for _ in range(25)]

    def edit(s):
        i = r.randrange(len(s) + 1)
        return r.choice((s, s[:i] + r.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + r.choice(letters) + s[i + 1 :]))

    return [(d, "\n".join(edit(r.choice(base)) if r.random() < 0.8 else r.choice(("", " ", "short", "a unique one %d" % r.randrange(99))) for _ in range(r.randint(0, 8)))) for d in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in linededup.repeated_lines(docs, 6).collect())
    assert got == sorted(brute(rows, 6))


def test_variants_meet_within_one_edit():
    """Lines share a key as the kinds have it exactly if one edit makes them equal."""
    text = ["aaaaab", "aaaaac", "aaaaabb", "xaaaaab", "zzzzzz", "baaaac", "aaaabb"]
    arrays = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in text]
    key, line, kind = linededup.variants(arrays, np.full(len(text), 31))
    by = {}
    for k, i, what in zip(key.tolist(), line.tolist(), kind.tolist()):
        by.setdefault((k, what), set()).add(i)
    met = {(i, j) for (k, what), own in by.items() for i in own for j in (own if what == 0 else by.get((k, 3 - what), ())) if i != j}
    assert met == {(i, j) for i, x in enumerate(text) for j, y in enumerate(text) if i != j and within(x, y) == 1}


def test_one_id_with_two_texts(spark):
    """The lines of each text are judged and dropped on their own."""
    rows = [(0, "a line that is repeated\nalone here"), (1, "a line that is repeated\nonly in the first text"), (1, "a wholly unique first line\nonly in the second text\na line that is repeated")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = linededup.repeated_lines(docs, with_h=True)
    left = sorted(r["text"] for r in linededup.drop_lines(docs, found).collect())
    assert left == sorted([rows[0][1], "only in the first text", "a wholly unique first line\nonly in the second text"])


def test_half_that_many_share(spark):
    """Thousands of lines with one half in common: no group of them is made."""
    rows = [(i, f"the very same beginning of all lines {i:05d}{i * 7919 % 100_000:05d}") for i in range(4000)] + [(4000, "the very same beginning of all lines 00000000x0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in linededup.repeated_lines(docs).collect()] == sorted(brute([rows[0], rows[-1]], 6))


def test_drop_and_edge_cases(spark):
    a, b = "this is the first line", "and a second one follows"
    long = "\n".join(f"line number {i} of a very long text" * 3 for i in range(8000))
    rows = [
        (1, f"{a}\n{b}", 1, "x"), (2, f"  {a}!\nsomething of its own", 2, None), (3, a, None, "y"), (4, None, 4, "z"), (None, a, 5, "n"), (5, "", 0, "e"),
        (6, long, 6, "l"), (7, long, 7, "m"), (8, f"{a}\nrow of the second kind\n\n{a}", 8, "t"), (8, f"{a}\nrow of the second kind\n\n{a}", 8, "t"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line long, kept_doc string")
    found = linededup.repeated_lines(docs)
    got = sorted(tuple(r) for r in found.where("doc_id not in (6, 7)").collect())
    assert got == [(2, 0, 1, 0, 1), (3, 0, 1, 0, 0), (8, 0, 1, 0, 0), (8, 3, 1, 0, 0)]
    left = [(r["doc_id"], r["text"]) for r in linededup.drop_lines(docs, found).collect() if r["doc_id"] != 6]
    assert sorted(left, key=str) == sorted([(1, f"{a}\n{b}"), (2, "something of its own"), (4, None), (None, a), (5, ""), (8, "row of the second kind\n"), (8, "row of the second kind\n")], key=str)
    empty = spark.createDataFrame([], docs.schema)
    assert linededup.repeated_lines(empty).count() == 0 and linededup.drop_lines(empty, linededup.repeated_lines(empty)).count() == 0


def test_short_lines(spark):
    rows = [(1, "Les.\nx\nAnd ornd.\nab"), (2, "Les.\nac\nown line"), (3, " x \n\nAnd ornd!\nab\nxyz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = linededup.repeated_lines(docs)
    assert sorted(tuple(r) for r in found.collect()) == [(2, 0, 1, 0, 0), (3, 0, 1, 1, 0), (3, 2, 1, 2, 1), (3, 3, 1, 3, 0)]
    assert {r["doc_id"]: r["text"] for r in linededup.drop_lines(docs, found).collect()} == {1: rows[0][1], 2: "ac\nown line", 3: "\nxyz"}
