"""Co-occurrence by numbers, tables in place of checkpoints, tokens that are split once."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from gyeol import session
from gyeol.functions.tokens import BLANKS
from gyeol.operators import context, phrase, wordstats
from gyeol.sources import corpus


@pytest.mark.parametrize("dynamic", [False, True])
@pytest.mark.parametrize("broadcast", [True, False])
def test_pairs_by_number(spark, monkeypatch, dynamic, broadcast):
    """Against counts by hand; batches of three pairs and of four rows, unknown tokens, equal neighbours, a vocabulary too large to send."""
    monkeypatch.setattr(context, "PAIRS", 3)
    monkeypatch.setattr(context, "MAX_TERMS", 1_000 if broadcast else 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "c", "d", "d", "x" + str(i)]) for _ in range(r.randint(0, 12))) for i in range(40)]
    try:
        s = spark.createDataFrame([(i, 0, t) for i, t in enumerate([*texts, None])], "doc_id long, sent_id int, sent string").repartition(3)
        v = context.vocabulary(s, 5)
        got = {(x["word"], x["context"]): x["weight"] for x in context.cooccurrence(s, v, 3, dynamic).collect()}
        ids = context.cooccurrence_ids(s, v, 3, dynamic)
        again = {(x["i"], x["j"]): x["weight"] for x in context.indexed(context.cooccurrence(s, v, 3, dynamic), v).collect()}
        assert {(x["word"], x["context"]): x["weight"] for x in ids.collect()} == again
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: Counter = Counter()
    for t in texts:
        w = t.split()
        for i, a in enumerate(w):
            for d in range(1, 4):
                if i + d < len(w) and {a, w[i + d]} <= set("abcd"):
                    for p in ((a, w[i + d]), (w[i + d], a)):
                        want[p] += (4 - d) / 3 if dynamic else 1
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cut_is_a_table(spark):
    t = session.cut(spark.range(1000).selectExpr("id", "id % 3 as k"))
    path = t.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert t.count() == 1000 and all(not x.endswith("-checkpoint") for x in os.listdir(path)) and any(x.endswith(".parquet") for x in os.listdir(path))
    session.drop(t)
    assert not os.path.exists(path)


def test_text_is_split_once(spark):
    """A filter of the optimiser's on the generated array would split again."""
    docs = spark.createDataFrame([(0, BLANKS.replace("\n", "") + "a　b" + BLANKS + "\x85c d ")], "doc_id long, text string")
    s = corpus.sentences(docs)
    assert [x["sent"] for x in s.collect()] == ["a　b", "c d"]
    for df in (corpus.token_counts(s), corpus.token_table(s), wordstats.neighbour_counts(s), phrase.bigrams(s, 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(sent") == 1


def test_tokens_and_neighbours_in_one_pass(spark):
    s = spark.createDataFrame([(0, 0, "ab cd"), (1, 0, "ab"), (2, 0, " "), (3, 0, None)], "doc_id long, sent_id int, sent string")
    got = {(x["tok"], x["after"], x["before"]): x["n"] for x in wordstats.all_neighbour_counts(s).collect()}
    assert got == {("ab", "c", "d"): 1, ("cd", "a", "b"): 1, ("ab", None, None): 1}
    assert wordstats.neighbour_counts(s).count() == 2
