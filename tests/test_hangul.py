"""Hangul functions against pinned and hand-derived values."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gyeol.functions import hangul as h


def values(spark, data, *columns):
    """Rows of expressions over a column s, in order."""
    df = spark.createDataFrame(list(enumerate(data)), "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_letters(spark):
    got = values(spark, ["간", "ㅗ", "ㅋ", "a", "감", "ㄱ", None], h.decompose("s"), h.is_korean("s"), h.is_consonant("s"), h.is_vowel("s"), h.code("s"))
    assert [tuple(g[0]) if g[0] else None for g in got] == [("ㄱ", "ㅏ", "ㄴ"), (" ", "ㅗ", " "), ("ㅋ", " ", " "), None, ("ㄱ", "ㅏ", "ㅁ"), ("ㄱ", " ", " "), None]
    assert [g[1] for g in got][:4] == [True, True, True, False] and got[2][2] and got[1][3] and got[5][4] == 12593


def test_every_syllable_round_trips(spark):
    df = spark.range(h.FIRST, h.LAST + 1).select(h.char(F.col("id")).alias("c")).withColumn("d", h.decompose("c"))
    assert df.where(h.compose("d.cho", "d.jung", "d.jong") != F.col("c")).count() == 0 and df.select("c").distinct().count() == 11172
    assert values(spark, ["x"], h.compose(F.lit("ㄱ"), F.lit("x"), F.lit(" ")))[0][0] is None


def test_normalisers(spark):
    long = "가나다ㅏㅑㅓㅋㅋ쿠ㅜㅜㅜabcd123!!아핫"
    got = values(spark, [long, "a-b(c)", "123이건테스트ab테스트", "  ", "와하하하하하하하하하핫", None], h.only_hangle("s"), h.only_hangle_number("s"), h.only_text("s"), h.clean_characters("s"), h.repeat_normalize("s"), h.remain_hangle_on_last("s"))
    assert got[0][:3] == ("가나다ㅏㅑㅓㅋㅋ쿠ㅜㅜㅜ 아핫", "가나다ㅏㅑㅓㅋㅋ쿠ㅜㅜㅜ 123 아핫", long)
    assert got[1][2] == "a b(c)" and got[2][3] == "이건테스트 테스트" and got[4][4] == "와하하핫" and got[2][5] == "123이건테스트ab테스트" and got[1][5] == ""
    assert got[3][0] == "" and got[5] == (None,) * 6
    assert values(spark, ["학교를 (갔다)!! abc 오늘..", ""], h.normalize_sent_for_lrgraph("s")) == [("학교를 갔다 오늘",), ("",)]
    assert values(spark, ["가 1a,[나]"], h.normalize("s"), h.normalize("s", True, True, True, True)) == [("가 나", "가 1a,[나]")]


def test_emoticons(spark):
    got = values(spark, ["ㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋ쿠ㅜㅜㅜㅜㅜㅜ", "요ㅋㅋ", "앜ㅋㅋ", ""], h.emoticon_normalize("s", 3), h.emoticon_normalize("s", 2, True), h.emoticon_normalize("s", 2))
    assert got == [("ㅋㅋㅋㅜㅜㅜ", "ㅋㅋㅜㅜ", "ㅋㅋㅜㅜ"), ("요ㅋㅋ", "ㅋㅋ", "요ㅋㅋ"), ("아ㅋㅋㅋ", "아ㅋㅋ", "아ㅋㅋ"), ("", "", "")]
    assert values(spark, ["앜ㅋㅋㅋㅋ 하하하하하", "무야호무야호무야호무야호"], h.normalize_tokens("s")) == [("아ㅋㅋ 하하",), ("무야호무야호",)]


def test_distances(spark):
    df = spark.createDataFrame([("가나", "가남"), ("가나", "가나다"), ("", "가"), (None, "가")], "a string, b string")
    lev = [r[0] for r in df.select(h.levenshtein("a", "b")).collect()]
    half = [r[0] for r in df.select(h.levenshtein("a", "b", {("나", "남"): 0.1})).collect()]
    jamo = [r[0] for r in df.select(h.jamo_levenshtein("a", "b")).collect()]
    assert lev == [1, 1, 1, None] and half == [0.1, 1, 1, None] and math.isclose(jamo[0], 1 / 3) and jamo[1:] == [1, 1, None]
    cos = [r[0] for r in df.select(h.cosine_distance("a", "b")).collect()]
    jac = [r[0] for r in df.select(h.jaccard_distance("a", "b")).collect()]
    assert math.isclose(cos[0], 0.5) and math.isclose(cos[1], 1 - 2 / math.sqrt(6)) and cos[2:] == [2, None]
    assert math.isclose(jac[0], 2 / 3) and math.isclose(jac[1], 1 / 3) and jac[2:] == [1, None]


def test_encoding(spark):
    df = spark.createDataFrame([("간1 ㅋ",), ("가  a나ㄳ",)], "s string").select("s", h.encode("s").alias("e"))
    got = {r["s"]: (r["e"], r["t"]) for r in df.withColumn("t", h.decode("e")).collect()}
    assert got["간1 ㅋ"] == ([[0, 19, 44], [69], [78], [15]], "간1 ㅋ")
    assert got["가  a나ㄳ"][1] == "가 나ㄳ"


def test_characters_beyond_the_basic_plane(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    texts = ["a\U0001f44db\U00020000", "e\u0301", "", None, "가 ㅏ!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    name = "b03_character_classes"
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(e.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, e.queries()[name](spark, str(tmp_path)).collect())) == sorted(want)
    assert spark.createDataFrame([("\U0001f44da", "a")], "a string, b string").select(h.jaccard_distance("a", "b")).first()[0] == 0.5
