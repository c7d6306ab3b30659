"""Mixing: every token once, the draw and the permutations by hand."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from gyeol.llm import mixing


def corpus():
    r = random.Random(2)
    rows = [(d, " ".join(f"{r.choice('abc')}{r.randint(0, 99)}" for _ in range(r.randint(0, 60))) + r.choice(("", "\n", "  ")), r.choice(("x", "x", "x", "y", None))) for d in range(80)]
    return rows + [(200, None, "x"), (201, "", "y"), (202, " \n ", "y"), (None, "no id here", "x"), (203, "long text " * 20_000, "y"), (5, rows[5][1], rows[5][2])]


def test_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(p.tolist()) == list(range(n))
    assert mixing.permute(np.arange(500), 500, 1).tolist() != mixing.permute(np.arange(500), 500, 2).tolist()


def test_blocks_and_shards(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 7, "q") for r in rows], "doc_id long, text string, source string, block long, piece string").repartition(3)
    block, per = 50, 40
    out = mixing.mix_sources(docs, block=block, per_shard=per, bucket_chars=60_000).collect()
    total = Counter()
    for _, t, s in rows:
        total[s or ""] += len((t or "").split())
    blocks = {s: -(-n // block) for s, n in total.items()}
    assert len(out) == sum(blocks.values())
    assert sorted((r["shard"], r["slot"]) for r in out) == [(i // per, i % per) for i in range(len(out))]
    # the multinomial draw of each shard
    names = sorted(total)
    w = np.array([total[s] ** mixing.ALPHA for s in names])
    for shard in range(-(-len(out) // per)):
        size = min(per, len(out) - shard * per)
        want = np.random.default_rng([mixing.SEED, shard]).multinomial(size, w / w.sum())
        got = Counter(r["source"] for r in out if r["shard"] == shard)
        assert [got[s] for s in names] == want.tolist()
    # a pass over a source takes each block once
    for s in names:
        seen = Counter((r["epoch"], r["block"]) for r in out if r["source"] == s)
        assert not seen or max(seen.values()) == 1
        n = sum(1 for r in out if r["source"] == s)
        for e in range(n // blocks[s]):
            assert {b for x, b in seen if x == e} == set(range(blocks[s]))
    for r in out:
        assert r["n_tokens"] == block or r["block"] == blocks[r["source"]] - 1
        assert sum(len(p.split()) for p in r["text"].split(mixing.SEPARATOR)) == r["n_tokens"]


def test_no_text_is_lost(spark):
    """One source of weight takes all of its blocks; put together they are its documents."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    first = mixing.mix_sources(docs, {"y": 1.0}, block=50, bucket_chars=60_000).where("epoch = 0").orderBy("block").collect()
    assert {r["source"] for r in first} == {"y"}
    tokens = [t for r in first for p in r["text"].split(mixing.SEPARATOR) for t in p.split()]
    want = [t for _, x, s in rows if s == "y" for t in (x or "").split()]
    assert Counter(tokens) == Counter(want) and {d for r in first for d in r["doc_ids"]} == {d for d, x, s in rows if s == "y" and (x or "").split()}
    again = mixing.mix_sources(docs.repartition(7), {"y": 1.0}, block=50, bucket_chars=60_000).where("epoch = 0").orderBy("block").collect()
    assert [r["text"] for r in again] == [r["text"] for r in first]


def test_buckets_change_nothing_and_ids_are_of_any_type(spark):
    rows = [(f"d{d}", t, s) for d, t, s in corpus()]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(5)
    got = [sorted(map(str, mixing.mix_sources(docs, block=50, per_shard=40, bucket_chars=c).collect())) for c in (3_000, 50_000_000)]
    assert got[0] == got[1] and len(got[0]) > 500 and "'d203'" in got[0][0] + got[0][-1]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).count() == 0
    blank = spark.createDataFrame([(1, " ", "x"), (2, None, None)], docs.schema)
    assert mixing.mix_sources(blank).count() == 0
