"""Decontamination against a search for all sub-sequences."""

from __future__ import annotations

import random
import re

from gyeol.llm import decontam


def words(text):
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", text or "")]


def brute(rows, items, least, share, floor):
    """Characters to remove: matches long enough, or covering enough of an item that has them."""
    seqs = [[w for w, _, _ in words(t)] for _, t in items]
    seqs = [s for s in seqs if len(s) >= floor]
    out = set()
    for d, text, *_ in rows:
        if d is None or text is None:
            continue
        w = words(text)
        for s in seqs:
            for i in range(len(w)):
                for j in range(len(s)):
                    n = 0
                    while i + n < len(w) and j + n < len(s) and w[i + n][0] == s[j + n]:
                        n += 1
                    if n >= least or (n >= floor and n >= share * len(s)):
                        out |= {(d, c) for c in range(w[i][1], w[i + n - 1][2])}
    return out


def corpus():
    r = random.Random(6)
    vocab = [f"t{i}" for i in range(30)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(3, 30)))) for k in range(20)]
    rows = []
    for d in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 40))]
        if r.random() < 0.5:
            s = r.choice(items)[1].split()
            a = r.randrange(len(s))
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in s[a:]]
        rows.append((d, ", ".join(w)))
    return rows, items


def test_against_brute_force(spark):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs, bench, 9, 0.8, 5).collect()
    want = brute(rows, items, 9, 0.8, 5)
    assert {(r["doc_id"], c) for r in got for c in range(r["start"], r["end"])} == want and want
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["span"] for r in got)
    left = {r["doc_id"]: r["text"] for r in decontam.clean(docs, bench, 9, 0.8, 5).collect()}
    for d, t in rows:
        rest = "".join(c for k, c in enumerate(t) if (d, k) not in want)
        assert left.get(d, None) == rest or (d not in left and not words(rest) and words(t))


def test_automaton_lengths():
    r = random.Random(1)
    items = [[r.randrange(3) for _ in range(r.randint(1, 12))] for _ in range(8)]
    sam = decontam.SuffixAutomaton(items, list(range(8)))
    inside = lambda x: [s for s in items if any(s[i : i + len(x)] == x for i in range(len(s)))]
    seq = [r.randrange(4) for _ in range(200)]
    for i, n, v in sam.matches(seq):
        m = next((m for m in range(min(i + 1, 12), 0, -1) if inside(seq[i - m + 1 : i + 1])), 0)
        assert n == m
        if n:
            assert sam.short[v] == min(map(len, inside(seq[i - n + 1 : i + 1])))


def spread(rows):
    return sorted((r["doc_id"], r["start"], r["end"], r["match_tokens"], r["item_id"], r["reason"], r["span"]) for r in rows)


def test_any_number_of_automata(spark):
    """Overlapping items in one automaton or in one each: equal spans and texts."""
    r = random.Random(3)
    vocab = [f"t{i}" for i in range(14)]
    base = [r.choice(vocab) for _ in range(80)]
    items = [(f"i{k}", " ".join(base[(a := r.randrange(60)) : a + r.randint(4, 20)])) for k in range(14)] + [("i90", "t1 " * 20)]
    rows = [(f"d{d}", " ".join([r.choice(vocab) for _ in range(4)] + base[(a := r.randrange(60)) : a + r.randint(4, 30)] + [r.choice(vocab) for _ in range(4)]), d) for d in range(40)]
    rows += [(None, rows[0][1], 77), ("d0", "another text under the same id " + items[3][1], 78), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id string, text string, b0 int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole, split = decontam.leaks(docs, bench), decontam.leaks(docs, bench, tokens=20)
    assert len(decontam.detectors(bench, 0.8, 6, 20)) > 3
    assert spread(whole.collect()) == spread(split.collect()) and whole.count() > 20
    assert {(x["doc_id"], c) for x in whole.where("doc_id <> 'd0'").collect() for c in range(x["start"], x["end"])} == {x for x in brute(rows, items, 13, 0.8, 6) if x[0] != "d0"}
    one, many = decontam.clean(docs, bench).collect(), decontam.clean(docs, bench, tokens=20).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and {x["b0"] for x in one} >= {77, 78}


def test_items_that_overlap_in_a_document(spark):
    """Two items whose matches overlap leave no token behind."""
    first, second = " ".join(f"t{k}" for k in range(20)), " ".join(f"t{k}" for k in range(10, 30))
    docs = spark.createDataFrame([(1, "start " + " ".join(f"t{k}" for k in range(30)) + " end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    for tokens in (500_000, 2):
        assert [(x["span"].split()[0], x["span"].split()[-1], x["item_id"]) for x in decontam.leaks(docs, bench, tokens=tokens).collect()] == [("t0", "t29", 1)]
        assert [x["text"] for x in decontam.clean(docs, bench, tokens=tokens).collect()] == ["start  end"]


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, item, "q"), (1, item, "q"), (2, None, "r"), (3, "", None), (None, "null item text of some words here", "s")], "item_id long, text string, span string")
    long = "filler words without end " * 60_000
    rows = [(1, f"See: {item.title()}! End", 30, "a"), (2, None, None, "b"), (3, "", 0, None), (None, item, 5, "c"), (4, long + item, 7, "d"), (5, item, 9, "e"), (1, f"See: {item.title()}! End", 30, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, reason string")
    got = decontam.leaks(docs, bench).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 4, 5] and {r["item_id"] for r in got} == {1}
    left = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in decontam.clean(docs, bench).where("doc_id is null or doc_id <> 4").collect()), key=str)
    assert left == sorted([(1, "See: ! End", 10), (1, "See: ! End", 10), (2, None, None), (3, "", 0)], key=str)
    assert decontam.leaks(docs, bench.where("false")).count() == 0 and decontam.clean(docs.where("false"), bench).count() == 0


def test_items_that_share_text(spark):
    short = "a b c d e f g"
    items = [(1, "x " + short + " " + " ".join(f"w{k}" for k in range(32))), (2, short)]
    docs = spark.createDataFrame([(1, f"before x {short} after"), (2, "x a b c d e nothing")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [(r["doc_id"], r["span"], r["match_tokens"], r["item_id"], r["reason"]) for r in decontam.leaks(docs, bench).collect()] == [(1, short, 7, 2, "coverage")]
    r = random.Random(8)
    vocab = [f"t{i}" for i in range(12)]
    base = [r.choice(vocab) for _ in range(60)]
    cuts = [sorted((r.randrange(60), r.randrange(60))) for _ in range(40)]
    items = [(k, " ".join(base[a:b])) for k, (a, b) in enumerate(cuts)]
    rows = [(d, " ".join([r.choice(vocab) for _ in range(5)] + base[(a := r.randrange(55)) : a + r.randint(4, 12)] + [r.choice(vocab) for _ in range(5)])) for d in range(60)]
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], c) for x in got for c in range(x["start"], x["end"])} == brute(rows, items, 13, 0.8, 6)
