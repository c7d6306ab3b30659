"""Predicates and parts of speech: registered fixtures against their pinned rows, rounds against one by one, empty tables."""

from __future__ import annotations

import random

import pytest

from gyeol.operators import pos, predicates
from gyeol.plans import predicates as plans


def words(spark, *w):
    return spark.createDataFrame([(v,) for v in w], "word string")


def test_mined_stems(spark):
    found = {r["stem"] for r in plans.j13_stems(spark, "").collect()}
    assert "달리" in found and not found & set(plans.ADJECTIVES + plans.VERBS)


def test_rounds_equal_one_by_one(spark):
    """Endings are predicted longest first, each on what longer ones left."""
    r = random.Random(4)
    stems, nouns = {"가", "나다", "다", "라가"}, {"가나", "라"}
    counts = {"".join(r.choice("가나다라") for _ in range(r.randint(2, 6))): r.randint(1, 9) for _ in range(150)}
    left, want = dict(counts), {}
    wanted = {w[i:] for w in counts for i in range(1, len(w)) if w[:i] in stems}
    for k in range(6, 0, -1):
        taken = set()
        for e in (w for w in wanted if len(w) == k):
            pos_, neg, unk, own = 0, 0, 0, 0
            for w, c in left.items():
                if not w.endswith(e) or len(w) == k:
                    continue
                head = w[:-k]
                longer = any(w[:i] in stems for i in range(len(head) + 1, len(w) + 1))
                own += head in stems and not longer
                if w in nouns or longer:
                    continue
                if head in stems or (head[0] in nouns and head[1:] in stems):
                    pos_ += c
                elif any(head[i:] in stems for i in range(1, len(head))):
                    unk += c
                else:
                    neg += c
            score = (pos_ - neg) / (pos_ + neg) if pos_ + neg else 0.0
            want[e] = ((pos_ if score >= 0.3 else neg) + unk, score) if own >= 2 else (0, 0.0)
            if want[e][1] >= 0.3:
                taken |= {w for w in left if w.endswith(e) and (w[:-k] in stems or (w[:-k] and w[0] in nouns and w[1:-k] in stems))}
        left = {w: c for w, c in left.items() if w not in taken}
    table = spark.createDataFrame(list(counts.items()), "eojeol string, count long")
    forms = spark.createDataFrame([(s,) for s in stems], "l string")
    got = {x["r"]: (x["support"], x["score"]) for x in predicates.endings_longest_first(table, forms, words(spark, *nouns), min_features=2).collect()}
    assert got.keys() == want.keys() and all(got[e][0] == want[e][0] and abs(got[e][1] - want[e][1]) < 1e-9 for e in want)


def test_derived_stems(spark):
    found = spark.createDataFrame([("달리",), ("달리기",), ("가고",), ("새롭",)], "l string")
    left = predicates.drop_derived(found, spark.createDataFrame([("가",)], "l string"), spark.createDataFrame([("고",)], "r string"))
    assert sorted(r[0] for r in left.collect()) == ["달리", "새롭"]


def test_nouns_that_start_stems(spark):
    left = predicates.without_stem_fronts(words(spark, "공부", "학교", "조용", "공"), words(spark, "공부하", "조용하", "학교에가"))
    assert sorted(r[0] for r in left.collect()) == ["공"]  # 학교에가 less two is 학교


def test_wrong_in_chat(spark):
    lemmas = spark.createDataFrame([("가", "ㅋㅋ", 9), ("가", "고", 1), ("먹", "고", 5), ("먹", "ㅋ", 4)], "stem string, ending string, count long")
    assert [r[0] for r in pos.wrong_stems(lemmas).collect()] == ["가"]
    rows = spark.createDataFrame([("먹고가", "먹고", "가"), ("보고가", "보고", "가"), ("학가", "학", "가"), ("먹네", "먹", "네")], "word string, stem string, ending string")
    assert [r[0] for r in pos.wrong_endings(rows, spark.createDataFrame([("먹고가",), ("보고가",)], "eojeol string")).collect()] == ["가"]
    assert sorted(r["word"] for r in pos.without_stems(rows, words(spark, "먹고", "학")).collect()) == ["먹네", "보고가"]
    nouns = spark.createDataFrame([("학교에", 3), ("학교", 9), ("나무들", 2)], "word string, count long")
    assert [r["word"] for r in pos.noun_phrases(nouns, words(spark, "에", "교")).collect()] == ["학교에"]


def test_syllables_that_cannot_stand_together(spark):
    df = spark.createDataFrame([("먹고살", "ㄴ다"), ("먹고가", "자"), ("크", "어"), ("업", "고"), ("가", "x")], "stem string, ending string")
    assert [bool(r[0]) for r in df.select(pos.joinable()).collect()] == [False, True, False, True, False]
    assert [bool(r[0]) for r in df.select(pos.joinable(chat=True)).collect()] == [False, True, False, False, False]


@pytest.mark.parametrize("chat", [False, True])
def test_empty(spark, chat):
    eojeols = spark.createDataFrame([("", 3), (None, 1)], "eojeol string, count long")
    none = words(spark)
    x = predicates.PredicateExtractor(none, none, none, none, none, mine_endings=True, mine_stems=True).train(eojeols)
    found = x.extract()
    assert found.count() == 0
    out, lemmas, _ = pos.tag_words(eojeols, none, found, none, none, none, none, none, chat)
    assert out.count() == 0 and lemmas.count() == 0
