"""Conjugation, lemmas and tagging against pinned and hand-derived values."""

from __future__ import annotations

import pytest

from gyeol.functions import morph as m
from gyeol.operators import tagger as t

SURFACES = {
    ("깨닫", "아"): "깨달아 깨닫아", ("구르", "어"): "굴러", ("덥", "어"): "더워", ("곱", "아"): "고와", ("아름답", "았다"): "아름다웠다", ("이", "ㅂ니다"): "입니다", ("벗", "어서"): "벗어서", ("긋", "었어"): "그었어",
    ("푸", "어"): "퍼", ("주", "었다"): "줬다", ("오", "았어"): "왔어", ("끄", "었다"): "껐다", ("들", "었다"): "들었다", ("가", "아라"): "가라", ("돌아오", "아라"): "돌아와라", ("푸르", "어"): "푸르러",
    ("하", "았다"): "하였다 했다", ("파랗", "면"): "파라면", ("동그랗", "ㄴ"): "동그란", ("그렇", "네"): "그러네 그렇네", ("좋", "아"): "좋아", ("좋아지", "었던"): "좋아졌던 좋아지었던", ("새롭", "운"): "새로운", ("내려놓", "은"): "내려놓은", ("먹", "고"): "먹고",
}
STEMS = {"하": "한 했 하 할 핬 해 합", "낫": "낫 나", "아름답": "아름답 아름다", "주": "줘 줐 준 줄 줍 줬 주", "가": "갑 가 갈 갔 간", "좋": "좋", "푸": "풌 풉 푼 푸 풀", "오": "옸 올 온 왔 와 오 옵", "파랗": "파랗 파라 파랄 파랐 파랬 파란", "들": "들", "깨닫": "깨달 깨닫", "끄": "끕 끌 끈 껐 꺼 끘 끄", "벗": "벗", "덥": "덥 더"}


@pytest.mark.parametrize("pair", SURFACES)
def test_surfaces(pair):
    assert m.conjugate(*pair) == set(SURFACES[pair].split())


@pytest.mark.parametrize("stem", STEMS)
def test_stem_surfaces(stem):
    assert m.stem_surfaces(stem) == set(STEMS[stem].split())


@pytest.mark.parametrize("pair", SURFACES)
def test_a_surface_has_its_lemma(pair):
    """Some cut of each surface of the irregular kinds gives the pair back."""
    found = {w: set().union(*(m.lemma_candidates(w[:i], w[i:]) for i in range(1, len(w) + 1))) for w in m.conjugate(*pair)}
    skip = {("가", "아라"), ("돌아오", "아라"), ("푸르", "어"), ("하", "았다"), ("아름답", "았다")}  # another ending has the same surface
    assert pair in skip or any(pair in x for x in found.values())
    assert all(w in m.conjugate(*x) for w, xs in found.items() for x in xs)


def test_frames(spark):
    df = spark.createDataFrame([("이", "ㅂ니다"), (None, "어"), ("a", "어"), ("", "어"), ("먹", "")], "s string, e string")
    assert [r[0] for r in df.select(m.conjugated("s", "e")).collect()] == [["입니다"], [], [], [], []]
    assert [r[0] for r in df.select(m.conjugated("s", "e", chat=True)).collect()][-1] == ["먹"]
    stems, ends = spark.createDataFrame([("이",), ("예쁘",)], "word string"), spark.createDataFrame([("ㅂ니다",), ("었다",)], "word string")
    words = spark.createDataFrame([("입니다",), ("예뻤다",), ("학교",), ("abc",), (None,), ("",), ("입니다",)], "word string")
    assert sorted(map(tuple, m.lemmatize(words, stems, ends).collect())) == [("예뻤다", "예쁘", "었다"), ("입니다", "이", "ㅂ니다")]
    kinds = spark.createDataFrame([("아름답",), ("거들먹거리",), ("먹",), (None,)], "s string")
    assert [r[0] for r in kinds.select(m.rule_class("s")).collect()] == ["Adjective", "Verb", None, None]
    assert [r[0] for r in kinds.select(m.forms("s", "present")).collect()][2] == ["먹고있는", "먹는다", "먹는다고"]
    assert spark.createDataFrame([("조용하",), ("먹",)], "s string").select(m.stem_to_adverb("s")).collect()[0][0] == "조용히"


PINNED = {"Adverb": {"너무", "매우"}, "Noun": {"너무너무너무", "아이오아이", "아이", "노래", "오", "이", "고양"}, "Josa": {"는", "의", "이다", "입니다", "이", "이는", "를", "라", "라는"}, "Verb": {"하는", "하다", "하고"}, "Adjective": {"예쁜", "예쁘다"}, "Exclamation": {"우와"}}


def test_tagger(spark, tmp_path):
    d = t.Dictionary(PINNED)
    want = [("너무너무너무", "Noun"), ("는", "Josa"), ("아이오아이", "Noun"), ("의", "Josa"), ("노래", "Noun"), ("입니다", "Josa"), ("!!", None)]
    assert t.lr_tagger(d)("너무너무너무는아이오아이의노래입니다!!") == want
    assert t.lr_tagger(d)("모름") == [] and t.lr_tagger(d, keep_unknown=True)("모름") == [("모름", None)]
    assert t.eojeol_tagger(d)("노래를") == [("노래", "Noun"), ("를", "Josa")] and t.eojeol_tagger(d)("너무매우") == [("너무", "Adverb"), ("매우", "Adverb")]
    sents = spark.createDataFrame([(1, 0, "아이의 노래를 모름"), (2, 0, "")], "doc_id long, sent_id int, sent string")
    got = [tuple(r)[2:] for r in t.tag(sents, t.lr_tagger(d)).orderBy("pos", "k").collect()]
    assert got == [(0, 0, "아이", "Noun"), (0, 1, "의", "Josa"), (1, 0, "노래", "Noun"), (1, 1, "를", "Josa")]
    assert sorted(d.tags("이")) == ["Josa", "Noun"] and d.has("아이오아이", "Noun") and not d.has("아이오아이", "명사")
    with pytest.raises(ValueError):
        d.with_words("New", ["x"])
    assert d.with_words("New", ["x"], True).has("x", "New") and not d.without_words("Noun", ["아이"]).has("아이", "Noun")
    t.save_dictionary(d, spark, str(tmp_path / "d"))
    assert t.load_dictionary(spark, str(tmp_path / "d")).words == d.words
    liked = t.lr_tagger(d, {"Noun": {"아이": 5.0}})("아이오아이")
    assert liked == [("아이", "Noun"), ("오", None), ("아이", "Noun")]
