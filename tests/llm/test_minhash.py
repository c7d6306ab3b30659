"""Near duplicates against exact Jaccard similarity and a brute-force signature comparison."""

from __future__ import annotations

import random
import re

import numpy as np

from gyeol.llm import minhash


def shingles(text):
    w = re.findall(r"[a-z0-9]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def corpus():
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows, of = [], {}
    for g in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(60, 200))]
        for k in range(r.choice((1, 1, 2, 4))):
            w = list(base)
            for _ in range(k and r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocab)
            of[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    return rows, of


def test_groups_and_similarity(spark):
    rows, of = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["keep_id"], r["similarity"]) for r in minhash.near_duplicates(docs).collect()}
    text = dict(rows)
    first = {g: min(i for i, x in of.items() if x == g) for g in of.values()}
    want = {i: first[g] for i, g in of.items() if i != first[g]}
    assert {i: k for i, (k, _) in got.items()} == want
    for i, (k, s) in got.items():
        assert abs(s - jaccard(text[i], text[k])) < 0.2
    kept = {r["doc_id"] for r in minhash.keep_one(docs).collect()}
    assert kept == set(first.values())


def test_links_equal_brute_force(spark):
    """Hub comparison and cells link what all pairs of the bucket would link, whatever the size of a cell."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (5, minhash.HASHES // 2), dtype=np.uint8)
    sig = base[rng.integers(0, 5, 60)].copy()
    noise = rng.random(sig.shape) < rng.choice([0.0, 0.2, 0.5], 60)[:, None]
    sig[noise] = rng.integers(0, 256, int(noise.sum()), dtype=np.uint8)
    keys = [sorted({0 if i < 25 else 1, int(rng.integers(2, 9))}) for i in range(60)]

    def groups(pairs):
        root = list(range(60))
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[find(a)] = find(b)
        return [find(i) == find(j) for i in range(60) for j in range(60)]

    every = [(i, j) for i in range(60) for j in range(i) if set(keys[i]) & set(keys[j]) and minhash.similarity(sig[i], sig[j]) >= 0.4]
    nodes = spark.createDataFrame([(i, sig[i].tobytes(), keys[i]) for i in range(60)], "id long, sig binary, keys array<bigint>").repartition(3)
    for block in (20_000, 4):
        got = minhash.edges(nodes, 0.4, block).collect()
        assert all((x["b"], x["a"]) in every for x in got)
        assert groups((x["a"], x["b"]) for x in got) == groups(every)


def test_low_bits_estimate():
    m = np.arange(2 * minhash.HASHES, dtype=np.uint64).reshape(2, -1)
    m[1, : minhash.HASHES // 2] = m[0, : minhash.HASHES // 2]
    s = minhash.packed(m)
    assert s.shape == (2, minhash.HASHES * minhash.BITS // 8)
    assert minhash.similarity(s[0], s[0]) == 1 and 0.35 < minhash.similarity(s[0], s[1]) < 0.65


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(150_000))
    rows = [(1, "", "a", 1), (2, "", None, 2), (3, None, "b", 3), (None, "some words in here", "c", 4), (4, "!!!", "d", None), (5, long, "e", 5), (6, long + " end", "f", 6), (7, "one", "g", 7), (7, "one", "h", 8), (8, "One.", "i", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, gone_doc long")
    got = {r["doc_id"]: r["keep_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {2: 1, 6: 5, 8: 7}  # 4 has no word either, but another text
    left = minhash.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 3, 4, 5, 7]
    empty = spark.createDataFrame([], docs.schema)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["root"] for r in minhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[101] == 100


def test_one_id_with_two_texts(spark):
    """Only the text that repeats another goes, and groups don't merge through the id."""
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    docs = spark.createDataFrame([(0, x), (1, x), (1, y), (2, "+++ ---"), (3, "=== ***"), (4, "+++ ---"), (5, y)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"]) for r in minhash.near_duplicates(docs).collect()) == [(1, 0), (4, 2), (5, 1)]
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep_one(docs).collect()) == [(0, x), (1, y), (2, "+++ ---"), (3, "=== ***")]
    named = docs.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert minhash.keep_one(named).count() == 4


def test_workers_need_no_pandas(spark, monkeypatch):
    """The import costs each worker 48 MB, and powers of the hash were kept for twice the text at once."""
    from gyeol.llm import linededup, textcore

    monkeypatch.setattr(minhash.F, "pandas_udf", None)
    rows, of = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == len(of) - len(set(of.values()))
    lines = spark.createDataFrame([(1, "one line of text"), (2, "one line of texts"), (3, "one line of text")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["distance"]) for r in linededup.repeated_lines(lines).collect()) == [(2, 1), (3, 0)]
    monkeypatch.setattr(textcore, "_pow", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    textcore._powers(10)
    assert len(textcore._pow[0]) <= textcore.CHUNK + 1
