"""News nouns: scores and each rule by definition, on a small corpus with known counts."""

from __future__ import annotations

import pytest

from gyeol.operators import news_nouns as n

SENTS = [("학교 학교는 학교를 학교의 학교가", 6), ("친구 친구는 친구를 친구의 친구들", 5), ("학교친구 학교친구", 3), ("친구먹었다 친구먹었다", 2), ("대학생으로 대학생으로 대학생은 대학생이 대학생", 4), ("나무 나무는 나무로", 1), (None, 1), ("", 2)]
WEIGHTS = [("는", 0.9), ("를", 0.8), ("의", 0.5), ("가", 0.7), ("로", 0.6), ("으로", 0.6), ("은", 0.9), ("이", 0.6), ("이", 0.2), ("었다", -0.8), ("들", 0.2)]


@pytest.fixture(scope="module")
def x(spark):
    rows = [(i, 0, t) for i, (t, k) in enumerate(SENTS) for _ in range(k)]
    sents = spark.createDataFrame(rows, "doc_id long, sent_id int, sent string")
    verbs = spark.createDataFrame([("먹었다",), ("먹었다",), (None,)], "word string")
    return n.NewsNounExtractor(spark.createDataFrame(WEIGHTS, "feature string, weight double"), verbs).train(sents)


def words(spark, *w):
    return spark.createDataFrame([(v,) for v in w], "l string")


def got(df):
    return sorted(r[0] for r in df.collect())


def test_scores(x):
    s = {r["l"]: tuple(round(v, 6) for v in list(r)[1:]) for r in x.scores.collect()}
    assert s["학교"] == (0.725, 36, 0.8, round(6 / 36, 6), 4, 1.0)
    assert s["친구"][:2] == (0.6, 29) and s["대학생"] == (0.675, 20, 1.0, 0.2, 3, 1.0) and s["학교친"] == (0.0, 6, 0.0, 0.0, 0, 0.0)
    assert got(x.predict(x.scores.select("l").limit(0))) == []


def test_rules(spark, x):
    none = words(spark)
    assert got(x.nouns_before_verbs()) == ["친구"]  # 친구먹었다 is always whole
    assert got(x.noun_part_and_josa(words(spark, "대학생으", "학교", "없는말"), none)) == ["대학생으"]
    assert got(x.nouns_with_josa(words(spark, "나무로", "나무"))) == ["나무"]  # three times as frequent
    known = words(spark, "학교", "친구", "나무")
    assert got(x.compounds(words(spark, "학교친구", "학교", "나무학교친구", "학교먹"), known)) == ["나무학교친구", "학교친구"]
    assert got(x.noun_and_josa(words(spark, "학교", "학교는", "학교었다", "새"), known)) == ["학교", "학교는"]
    assert got(x.noun_and_verb(words(spark, "친구먹었다", "친구들"), known)) == ["친구먹었다"]
    assert got(x.bad_tails(words(spark, "먹었다", "대학생으", "대학생이", "학교들이", "나무로", "대학생으로", "아으로"), words(spark, "대학생"))) == ["대학생으", "대학생으로", "먹었다", "아으로", "학교들이"]
    assert got(x.far_rarer_than_head(words(spark, "학교가", "나무로"), known)) == []


def test_rare_words_with_one_particle(spark, x):
    scored = x.scores.where("l in ('나무', '학교친', '학교')")
    # 학교 is frequent; what follows 학교친 isn't a particle; 나무 has 는 and 로, two positive features
    assert got(x.one_josa(scored, words(spark, "나무"))) == ["학교친"]


def test_extraction(x):
    found = {r["noun"]: r["frequency"] for r in x.extract().collect()}
    assert found == {"학교": 36, "친구": 29, "대학생": 20, "나무": 3, "학교친구": 6}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, sent_id int, sent string")
    x = n.NewsNounExtractor(spark.createDataFrame([], "feature string, weight double"), spark.createDataFrame([], "word string"))
    assert x.train_extract(none).count() == 0
