"""Substring dedup (6) and suffix-array dedup (8) against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from gyeol.llm import passages
from gyeol.llm.suffix import FMIndex, SuffixArray, WaveletMatrix, next_smaller, previous_smaller


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def brute(rows, t, across):
    """Covered tokens: windows of t tokens that another document has, or that occur earlier."""
    where = {}
    docs = {}
    for d, text in rows:
        if d is not None and text is not None:
            docs.setdefault(d, set()).add(text)
    for d, texts in docs.items():
        for text in texts:
            w = words(text)
            for i in range(len(w) - t + 1):
                where.setdefault(tuple(w[i : i + t]), []).append((d, i))
    out = set()
    for d, texts in docs.items():
        for text in texts:
            w = words(text)
            for i in range(len(w) - t + 1):
                hits = where[tuple(w[i : i + t])]
                if any(x[0] != d for x in hits) if across else any(x < (d, i) for x in hits):
                    out |= {(d, k) for k in range(i, i + t)}
    return out


def covered(df):
    return {(r["doc_id"], k) for r in df.collect() for k in range(r["start"], r["end"])}


def corpus(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)]
    shared = [[r.choice(vocab) for _ in range(r.randint(8, 60))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(r.randint(1, 5)):
            w += r.choice(shared) if r.random() < 0.4 else [r.choice(vocab) for _ in range(r.randint(0, 30))]
        if r.random() < 0.2:
            w = w + w
        rows.append((d, " ".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, "same " * 90), (103, "same " * 130), (104, ""), (105, None), (None, rows[3][1]), (106, "a b " * 60), (107, "b a " * 50)]
    rows.append((100, rows[3][1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shard, hot in ((300, 10_000), (250_000, 10_000), (300, 0), (300, 3)):
        assert covered(passages.repeated_across(docs, 12, 4, shard, hot)) == brute(rows, 12, True)
        assert covered(passages.later_copies(docs, 12, 4, shard, hot)) == brute(rows, 12, False)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert passages.repeated_across(empty).count() == 0 and passages.later_copies(empty).count() == 0
    text = " ".join(f"t{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, "New. " + text + "!", None, None)], "doc_id long, text string, anchor int, start string")
    assert sorted(map(tuple, passages.repeated_across(docs).collect())) == [(1, 0, 80), (2, 1, 81)]
    found = passages.later_copies(docs)
    assert [tuple(r) for r in found.collect()] == [(2, 1, 81)]
    left = {r["doc_id"]: r["text"] for r in passages.remove(docs, found).collect()}
    assert left == {1: text, 2: "New. !"}


def test_suffix_array_and_pointers():
    r = np.random.default_rng(4)
    for _ in range(30):
        ids = r.integers(0, 4, r.integers(1, 60))
        s = SuffixArray(ids, 100)
        suffix = lambda p: tuple(ids[p : p + s.left[p]])
        want = sorted(np.flatnonzero(ids), key=lambda p: (suffix(p), p))
        assert s.sa.tolist() == want
        lcp = s.lcp()
        for k in range(1, len(want)):
            a, b = suffix(want[k - 1]), suffix(want[k])
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        x = r.integers(0, 5, 40)
        assert previous_smaller(x).tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(40)]
        assert next_smaller(x).tolist() == [min((j for j in range(i + 1, 40) if x[j] < x[i]), default=40) for i in range(40)]


def test_wavelet_rank_and_matching_statistics():
    r = np.random.default_rng(5)
    x = r.integers(0, 11, 300)
    w = WaveletMatrix(x, 4)
    c, i = r.integers(0, 11, 200), r.integers(0, 301, 200)
    assert w.rank(c, i).tolist() == [int((x[:b] == a).sum()) for a, b in zip(c, i)]
    seqs = [r.integers(1, 4, r.integers(1, 25)) for _ in range(12)]
    ids = np.concatenate([np.append(s, 0) for s in seqs])
    size = np.array([len(s) for s in seqs])
    begin = np.cumsum(size + 1) - size - 1
    doc = np.arange(12) // 2
    got = FMIndex(ids, np.repeat(doc, size + 1), 30).matching_statistics(ids, begin, size)
    text = ["".join(map(str, s)) for s in seqs]
    for k, s in enumerate(text):
        for p in range(len(s)):
            n = max((n for n in range(len(s) - p + 1) if any(s[p : p + n] in text[j] for j in range(12) if doc[j] != doc[k])), default=0)
            assert got[begin[k] + p] == n


def test_one_id_with_two_texts(spark):
    shared = " ".join(f"t{i}" for i in range(60))
    rows = [(1, "start " + shared), (1, "another text with " + shared), (2, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages.repeated_across(docs).count() == 2
    left = [r["text"] for r in passages.remove(docs, passages.later_copies(docs, with_h=True)).collect()]
    assert sorted(left) in (sorted(["start ", rows[1][1], "a b c"]), sorted([rows[0][1], "another text with ", "a b c"]))
