"""Word statistics, L-R graph, phrases, vectors and contexts: small corpora with counts by hand, nulls, empty tables, files."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gyeol.operators import context, lrgraph, nouns, phrase, vectorizer, wordstats
from gyeol.sources import corpus


def sents(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, sent_id int, sent string")


def pairs(df, *columns):
    return {tuple(r[c] for c in columns[:-1]) if len(columns) > 2 else r[columns[0]]: r[columns[-1]] for r in df.collect()}


def test_word_counts_and_scores(spark, tmp_path):
    s = sents(spark, "ab abc", "abd", None, "")
    w = wordstats.WordStats(s, min_frequency=1)
    assert pairs(w.left, "word", "n") == {"a": 3, "ab": 3, "abc": 1, "abd": 1}
    assert pairs(w.right, "word", "n") == {"b": 1, "c": 1, "bc": 1, "d": 1, "bd": 1}
    assert w.after.count() == 0 and w.before.count() == 0  # extensions that occur once don't count
    assert pairs(wordstats.right_extensions(s, least=1), "root", "ext", "n") == {(r, "a"): 1 for r in ("ab", "b", "abc", "c", "bc")}
    c = {r["word"]: r for r in w.cohesion().collect()}
    assert c["ab"]["cohesion_forward"] == 1 and abs(c["abc"]["cohesion_forward"] - 3**-0.5) < 1e-9 and c["bc"]["cohesion_backward"] == 1
    b = {r["word"]: r for r in w.boundary().collect()}
    assert b["a"]["right_accessor_variety"] == 1 and b["ab"]["right_accessor_variety"] == 2 and abs(b["ab"]["right_branching_entropy"] - math.log(2)) < 1e-9
    wordstats.save(w, str(tmp_path / "w"))
    again = wordstats.load(spark, str(tmp_path / "w"))
    assert (again.max_left, again.max_right, again.min_frequency) == (10, 6, 1) and sorted(again.scores().collect()) == sorted(w.scores().collect())
    assert pairs(wordstats.cumulate(w.left, again.left), "word", "n") == {"a": 6, "ab": 6, "abc": 2, "abd": 2}
    assert wordstats.WordStats(s.limit(0)).scores().count() == 0


def test_lr_graph(spark, tmp_path):
    c = lrgraph.eojeol_counts(sents(spark, "school schools", "school", None), 10)
    assert pairs(c, "eojeol", "count") == {"school": 2, "schools": 1}
    g = lrgraph.lr_graph(c, 6, 3)
    assert pairs(g, "l", "r", "count") == {("sch", "ool"): 2, ("scho", "ol"): 2, ("schoo", "l"): 2, ("school", ""): 2, ("scho", "ols"): 1, ("schoo", "ls"): 1, ("school", "s"): 1}
    assert pairs(lrgraph.remove_pairs(g, spark.createDataFrame([("scho", "ol", 2), ("x", "y", 1)], "l string, r string, count long")), "l", "r", "count").get(("scho", "ol")) is None
    assert lrgraph.add_pairs(g, g).where("l = 'sch'").first()["count"] == 4
    lrgraph.write_graph_text(g, str(tmp_path / "g"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "g/lrgraph")).collect())
    assert "> school (3)\n  - : 2\n  - s: 1" in text
    assert pairs(lrgraph.read_graph_text(spark, str(tmp_path / "g")), "l", "r", "count") == pairs(g, "l", "r", "count")
    none = c.limit(0)
    assert lrgraph.lr_graph(none).count() == 0 and lrgraph.summary(none).first()["total"] == 0


def test_hits(spark):
    rows = [("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("c", "", 9)]
    got = {(r["side"], r["word"]): r["rank"] for r in lrgraph.hits(spark.createDataFrame(rows, "l string, r string, count long"), tolerance=0.0).collect()}
    l, total_l, total_r = {"a": 1.0, "b": 1.0}, {"a": 4, "b": 2}, {"x": 5, "y": 1}
    edges = [x for x in rows if x[1]]
    for k in range(11):
        r = {y: 0.1 + 0.9 * sum(c / total_l[i] * l[i] for i, j, c in edges if j == y) for y in total_r}
        if k < 10:
            l = {y: 0.1 + 0.9 * sum(c / total_r[j] * r[j] for i, j, c in edges if i == y) for y in total_l}
    want = {("L", k): v for k, v in l.items()} | {("R", k): v for k, v in r.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bigrams(spark):
    p = phrase.bigrams(sents(spark, "a b", "a b", "a c", None, "d"), 1)
    assert pairs(p, "w0", "w1", "frequency") == {("a", "b"): 2, ("a", "c"): 1}
    assert {k: round(v, 6) for k, v in pairs(phrase.extract(p), "w0", "w1", "score").items()} == {("a", "b"): round(math.log(6), 6), ("a", "c"): round(math.log(3), 6)}
    assert pairs(phrase.extract(p, "mikolov", min_frequency=1), "w0", "w1", "score") == {("a", "b"): 0.5, ("a", "c"): 0.0}
    assert [r["w1"] for r in phrase.extract(p, "frequency", topk=1).collect()] == ["b"]
    from pyspark.sql import functions as F

    assert pairs(phrase.bigrams(sents(spark, "abc"), 1, F.split("sent", "")), "w0", "w1", "frequency") == {("a", "b"): 1, ("b", "c"): 1}
    with pytest.raises(ValueError):
        phrase.extract(p, "other")
    assert phrase.extract(p.limit(0)).count() == 0


def test_vectors_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a a b"), (1, "b c"), (2, None)], "doc_id long, text string")
    terms = vectorizer.analyse(docs)
    v = vectorizer.fit(terms, docs.selectExpr("count(*) as n"))
    assert pairs(v, "term", "idx") == {"b": 0, "a": 1, "c": 2}
    m = vectorizer.transform(terms, v)
    assert pairs(m, "doc_id", "idx", "n") == {(0, 1): 2, (0, 0): 1, (1, 0): 1, (1, 2): 1}
    assert pairs(vectorizer.decode_list(vectorizer.encode_list(terms, v), v), "doc_id", "terms") == {0: ["a", "a", "b"], 1: ["b", "c"]}
    vectorizer.save_vocabulary(v, str(tmp_path / "v"))
    assert pairs(vectorizer.load_vocabulary(spark, str(tmp_path / "v")), "term", "idx") == {"b": 0, "a": 1, "c": 2}
    vectorizer.write_matrix_market(m, str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m/header")).collect()][2] == "2 3 4"
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m/body")).collect()) == ["1 1 1", "1 2 2", "2 1 1", "2 3 1"]
    assert vectorizer.transform(terms.limit(0), v.limit(0)).count() == 0


def test_dense_index_without_reused_exchanges(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        t = spark.range(3000).selectExpr("concat('t', id) as term", "cast(id % 7 as long) as n").repartition(5)
        got = vectorizer._dense_index(t, "n").select("idx", "n", "term").orderBy("idx").collect()
        assert [r["idx"] for r in got] == list(range(3000)) and [(-r["n"], r["term"]) for r in got] == sorted((-r["n"], r["term"]) for r in got)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_contexts(spark):
    s = sents(spark, "a b", "a b", "a c", None, "")
    v = context.vocabulary(s, 1)
    m = context.cooccurrence(s, v, 1)
    assert pairs(m, "word", "context", "weight") == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1}
    assert all(abs(x - math.log(2)) < 1e-9 for x in pairs(context.pmi(m), "word", "context", "pmi").values())
    assert context.pmi(m.limit(0)).count() == 0
    with pytest.raises(ValueError):
        context.pmi(m, beta=0)


def test_svd(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(40, 30)) * (r.random((40, 30)) < 0.4), 3)
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    values, u = context.svd(spark.createDataFrame(rows, "i long, j long, weight double").repartition(3), 4)
    full = np.linalg.svd(x)
    assert np.allclose(values, full[1][:4], atol=1e-5)
    got = np.zeros((40, 4))
    for row in u.collect():
        got[row["i"]] = row["vector"]
    assert np.allclose(np.abs(np.sum(got * full[0][:, :4], axis=0)), 1, atol=1e-3)
    with pytest.raises(ValueError):
        context.svd(spark.createDataFrame([(0, 0, 1.0)], "i long, j long, weight double"), 1)


def test_domain_features(spark):
    heads = [a + b for a in "가나다라마바사" for b in "기니디리"]
    counts = spark.createDataFrame([(h + "으로", 50) for h in heads] + [(h + "는", 50) for h in heads] + [("먹으로", 3)], "eojeol string, count long")
    feats = nouns.features(spark.createDataFrame([("는",)], "feature string"), spark.createDataFrame([("었다",)], "feature string"))
    found = nouns.domain_features(counts, spark.createDataFrame([(h,) for h in heads], "noun string"), feats)
    got = {r["feature"]: (round(r["score"], 6), r["frequency"]) for r in found.collect()}
    assert got["으로"] == (round((1400 - 3) / 1403, 6), 1400)


def test_is_noun(spark):
    found = spark.createDataFrame([("학교", 0.9), ("가", 0.2)], "noun string, score double")
    words = spark.createDataFrame([("학교",), ("가",), ("나",), ("학교",)], "word string")
    assert {r["word"]: r["is_noun"] for r in nouns.is_noun(words, found).collect()} == {"학교": True, "가": False, "나": False}


def test_lines_of_several_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}  x\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = corpus.read_doublespace(spark, str(tmp_path / "*.txt"), skip_header=1)
        ids = sorted((r["text"][0], r["doc_id"], r["text"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == [(n, i, f"{n}{i}  x") for n in "ab" for i in range(1, 5000)]
