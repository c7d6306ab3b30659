"""Queries that once ran on an inline sentence read the documents; the inline sentences are checked here."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from gyeol.operators import tagger, tokenize


@pytest.mark.parametrize("name", ["b07_repeat_normalize", "h03_max_score", "h04_lr_tokenize", "h05_h06_noun_tokens", "j26_tag"])
def test_runs_on_documents(spark, tmp_path, name):
    texts = [(i, f"The cats and dogs walked past the towers{i}. Loooong days, cats walking") for i in range(7)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = e.queries()[name](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(range(7))


def test_inline_sentences(spark):
    fixture = lambda text: spark.createDataFrame([(1, 0, text)], "doc_id long, sent_id int, sent string")
    pieces = lambda df: [[tuple(p) for p in w] for w in df.first()["words"]]
    scores = spark.createDataFrame([("파스", 0.3), ("파스타", 0.7), ("좋아요", 0.2), ("좋아", 0.5)], "word string, score double")
    assert pieces(tokenize.max_score_tokenize(fixture("난파스타가 좋아요"), scores)) == [[("난", 0, 1, 0.0, 1), ("파스타", 1, 4, 0.7, 3), ("가", 4, 5, 0.0, 1)], [("좋아", 0, 2, 0.5, 2), ("요", 2, 3, 0.0, 1)]]
    lr = tokenize.LRTokenizer({"데이터": 1.0, "노래": 0.9}, {"는": 1.0, "의": 1.0})
    assert pieces(tokenize.lr_tokenize(fixture("데이터는 새노래의"), lr)) == [[("데이터", "L"), ("는", "R")], [("새", "L"), ("노래", "L"), ("의", "R")]]
    s, n = fixture("데이터센터의 새데이터 데이터는"), spark.createDataFrame([("데이터", 1.0), ("센터", 1.0)], "word string, score double")
    j = F.array_join("tokens", " ")
    assert tokenize.noun_prefix_tokenize(s, n).select(j).first()[0] == "데이터센터 데이터"
    assert tokenize.noun_match_tokenize(s, n).select(j).first()[0] == "데이터센터 데이터 데이터"
    d = tagger.Dictionary({"Adverb": ["너무", "매우"], "Noun": ["너무너무너무", "아이오아이", "아이", "노래", "오", "이", "고양"], "Josa": ["는", "의", "이다", "입니다", "이", "이는", "를", "라", "라는"]})
    got = tagger.tag(fixture("너무너무너무는아이오아이의노래입니다!!"), tagger.lr_tagger(d)).orderBy("pos", "k").select("word", "tag").collect()
    assert list(map(tuple, got)) == [("너무너무너무", "Noun"), ("는", "Josa"), ("아이오아이", "Noun"), ("의", "Josa"), ("노래", "Noun"), ("입니다", "Josa"), ("!!", None)]
