"""Queries of Hangul functions, tokenisers, noun extraction, morphology and tagging.

The tables hold no Hangul, so functions of Hangul run on inline rows, with results
derived by hand as their SQL; what doesn't depend on the script runs on the tables.
h03 to h06, j26 and b07 have no SQL; tests/test_tokenize.py, test_plans.py and test_hangul.py check them on small inputs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hangul as h
from ..functions import morph
from ..operators import nouns, tagger, tokenize, wordstats
from ..session import cut
from .stats import SUB, TC, TOKS, _docs, _r, _sents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lit(v: object) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"CAST({v} AS DOUBLE)"
    return f"CAST({v} AS INTEGER)" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def rows(columns: str, *values: tuple) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, v)) + ')' for v in values)}) t({columns})"


def _strings(spark, *values, name="s"):  # noqa: ANN001, ANN002, ANN202
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@query(rows("s, cho, jung, jong", ("간", "ㄱ", "ㅏ", "ㄴ"), ("ㅗ", " ", "ㅗ", " "), ("ㅋ", "ㅋ", " ", " "), ("a", None, None, None)))
def b01_decompose(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "간", "ㅗ", "ㅋ", "a").select("s", h.decompose("s").alias("d")).select("s", "d.*")


@query(rows("cho, jung, jong, syllable", ("ㄱ", "ㅏ", "ㅁ", "감"), ("ㅎ", "ㅣ", " ", "히"), ("x", "ㅣ", " ", None)))
def b02_compose(spark, sf_dir):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([("ㄱ", "ㅏ", "ㅁ"), ("ㅎ", "ㅣ", " "), ("x", "ㅣ", " ")], "cho string, jung string, jong string")
    return df.withColumn("syllable", h.compose("cho", "jung", "jong"))


@query("SELECT *, c BETWEEN 48 AND 57 AS is_number, c BETWEEN 65 AND 90 OR c BETWEEN 97 AND 122 AS is_english, ch IN ('!', '\"', '''', ',', '.', '?', '`') AS is_punctuation, c BETWEEN 44032 AND 55203 OR c BETWEEN 12593 AND 12643 AS is_korean FROM (SELECT ch, CAST(unicode(ch) AS INTEGER) AS c FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents))")
def b03_character_classes(spark, sf_dir):  # noqa: ANN001, ANN201
    ch = _docs(spark, sf_dir).select(F.explode(h._units(F.col("text"))).alias("ch")).distinct()
    code = F.when(F.col("ch") == "", -1).otherwise(h.code("ch"))  # an empty text is one empty piece
    return ch.select("ch", code.alias("c"), h.is_number("ch").alias("is_number"), h.is_english("ch").alias("is_english"), h.is_punctuation("ch").alias("is_punctuation"), h.is_korean("ch").alias("is_korean"))


@query(rows("s, clean", ("123이건테스트ab테스트", "이건테스트 테스트"), ("", "")))
def b04_clean_characters(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "123이건테스트ab테스트", "").select("s", h.clean_characters("s").alias("clean"))


_TEXT = "regexp_replace(text, '[^ㄱ-ㅎㅏ-ㅣ가-힣a-zA-Z0-9,.?!\"''()\\[\\]{}]', ' ', 'g')"


def _squeeze(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_squeeze(f'''regexp_replace(regexp_replace({_TEXT}, '[,.?!]', ' ', 'g'), '[()\\[\\]{{}}`]', ' ', 'g')''')} AS text FROM documents")
def b05_normalize(spark, sf_dir):  # noqa: ANN001, ANN201
    return _docs(spark, sf_dir).select("doc_id", h.normalize("text", alphabet=True, number=True).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents")
def b06_remove_doublespace(spark, sf_dir):  # noqa: ANN001, ANN201
    return _docs(spark, sf_dir).select("doc_id", h.remove_doublespace("text").alias("text"))


@query()
def b07_repeat_normalize(spark, sf_dir):  # noqa: ANN001, ANN201
    return _docs(spark, sf_dir).select("doc_id", h.repeat_normalize("text").alias("two"))


@query(rows("s, three, compat", ("ㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋ쿠ㅜㅜㅜㅜㅜㅜ", "ㅋㅋㅋㅜㅜㅜ", "ㅋㅋㅋㅜㅜㅜ"), ("요ㅋㅋ", "요ㅋㅋ", "ㅋㅋ")))
def b08_emoticon_normalize(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "ㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋ쿠ㅜㅜㅜㅜㅜㅜ", "요ㅋㅋ").select("s", h.emoticon_normalize("s", 3).alias("three"), h.emoticon_normalize("s", 3, True).alias("compat"))


@query(f"SELECT doc_id, {_squeeze(_TEXT)} AS text FROM documents")
def b09_only_text(spark, sf_dir):  # noqa: ANN001, ANN201
    return _docs(spark, sf_dir).select("doc_id", h.only_text("text").alias("text"))


@query(rows("s, hangle, number", ("가나다ㅏㅑㅓㅋㅋ쿠ㅜㅜㅜabcd123!!아핫", "가나다ㅏㅑㅓㅋㅋ쿠ㅜㅜㅜ 아핫", "가나다ㅏㅑㅓㅋㅋ쿠ㅜㅜㅜ 123 아핫")))
def b09_only_hangle(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "가나다ㅏㅑㅓㅋㅋ쿠ㅜㅜㅜabcd123!!아핫").select("s", h.only_hangle("s").alias("hangle"), h.only_hangle_number("s").alias("number"))


@query(rows("s, head, sent", ("학교를!!", "학교를", "학교를"), ("abc", "", ""), ("(오늘) 간다..", "(오늘) 간다", "오늘 간다")))
def b11_normalize_for_lrgraph(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "학교를!!", "abc", "(오늘) 간다..").select("s", h.remain_hangle_on_last("s").alias("head"), h.normalize_sent_for_lrgraph("s").alias("sent"))


@query(rows("s, out", ("앜ㅋㅋㅋㅋ 하하하하하", "아ㅋㅋ 하하"), ("무야호무야호무야호무야호", "무야호무야호")))
def b12_normalize_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "앜ㅋㅋㅋㅋ 하하하하하", "무야호무야호무야호무야호").select("s", h.normalize_tokens("s").alias("out"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS DOUBLE) AS distance FROM part")
def b13_levenshtein(spark, sf_dir):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", h.levenshtein("p_name", "p_type").alias("distance"))


@query(rows("a, b, plain, cost, jamo", ("가나", "가남", 1.0, 0.1, 0.333333), ("가나", "가나다", 1.0, 1.0, 1.0)))
def b14_jamo_levenshtein(spark, sf_dir):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([("가나", "가남"), ("가나", "가나다")], "a string, b string")
    return df.select("a", "b", h.levenshtein("a", "b").alias("plain"), h.levenshtein("a", "b", {("나", "남"): 0.1}).alias("cost"), F.round(h.jamo_levenshtein("a", "b"), 6).alias("jamo"))


@query("""WITH u AS (SELECT p_partkey, string_split(p_name, '') AS x, string_split(p_type, '') AS y FROM part),
c AS (SELECT p_partkey, list_sum(list_transform(list_distinct(x), lambda k: len(list_filter(x, lambda v: v = k)) * len(list_filter(y, lambda v: v = k)))) AS dot, list_sum(list_transform(list_distinct(x), lambda k: len(list_filter(x, lambda v: v = k)) ** 2)) AS xx, list_sum(list_transform(list_distinct(y), lambda k: len(list_filter(y, lambda v: v = k)) ** 2)) AS yy, len(list_intersect(list_distinct(x), list_distinct(y))) AS i, len(list_distinct(list_concat(x, y))) AS n FROM u)
SELECT p_partkey, round(1 - dot / sqrt(xx * yy), 6) + 0.0 AS cosine, round(1 - i / CAST(n AS DOUBLE), 6) + 0.0 AS jaccard FROM c""")
def b15_b16_set_distances(spark, sf_dir):  # noqa: ANN001, ANN201
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", h.cosine_distance("p_name", "p_type").alias("cosine"), h.jaccard_distance("p_name", "p_type").alias("jaccard")).select("p_partkey", _r("cosine"), _r("jaccard"))


@query(rows("s, codes, text", ("간1 ㅋ", "0,19,44 69 78 15", "간1 ㅋ"), ("가  a나", "0,19,40 78 2,19,40", "가 나")))
def b17_encode(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _strings(spark, "간1 ㅋ", "가  a나").withColumn("e", h.encode("s"))
    flat = F.array_join(F.transform("e", lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")), " ")
    return df.select("s", flat.alias("codes"), h.decode("e").alias("text"))


_REGEX = "text"
for _p in (r"[-+]?\d*\.?\d+|[-+]?\d+", "[가-힣]+", "[ㄱ-ㅎ]+", "[ㅏ-ㅣ]+", r"[a-zA-ZÀ-ÿ]+[\[\x60'']?s\]*|[a-zA-ZÀ-ÿ]+"):
    _REGEX = f"regexp_replace({_REGEX}, '{_p}', ' \\0 ', 'g')"


@query(f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({_REGEX}, '\\s+'), lambda t: t <> ''), ' ') AS tokens FROM documents")
def h01_regex_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    return _docs(spark, sf_dir).select("doc_id", F.array_join(tokenize.regex_tokens("text"), " ").alias("tokens"))


@query(f"""WITH {SUB}, sc AS (SELECT word, CAST(n * (length(word) - 1) ** 2 AS DOUBLE) AS score FROM lc),
tk AS (SELECT doc_id, sent_id, i - 1 AS pos, t[i] AS tok FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM toks)),
pre AS (SELECT tok, i, left(tok, i) AS l FROM (SELECT tok, unnest(range(2, length(tok) + 1)) AS i FROM (SELECT DISTINCT tok FROM tk WHERE length(tok) > 2))),
best AS (SELECT tok, arg_max(i, struct_pack(s := coalesce(score, 0.0), i := i)) AS i FROM pre LEFT JOIN sc ON l = word GROUP BY tok)
SELECT doc_id, sent_id, string_agg(rtrim(left(tok, coalesce(i, length(tok))) || ' ' || substr(tok, coalesce(i, length(tok)) + 1)), ' ' ORDER BY pos) AS tokens FROM tk LEFT JOIN best USING (tok) GROUP BY doc_id, sent_id""")
def h02_l_tokenize(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _sents(spark, sf_dir)
    scores = wordstats.left_counts(s).select("word", (F.col("n") * F.pow(F.length("word") - 1, F.lit(2))).cast("double").alias("score"))
    return tokenize.l_tokenize(s, scores).select("doc_id", "sent_id", F.array_join("tokens", " ").alias("tokens"))


def _lexicon(spark, sf_dir):  # noqa: ANN001, ANN202
    """The nouns of the corpus, by prediction from the features."""
    return cut(_predicted(spark, sf_dir).where("score >= 0.3").select(F.col("l").alias("word"), "score"))


def _pieces(df):  # noqa: ANN001, ANN202
    return df.select("doc_id", "sent_id", "pos", F.posexplode("result").alias("k", "x")).select("doc_id", "sent_id", "pos", "k", "x.*")


@query()
def h03_max_score(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _sents(spark, sf_dir)
    scores = wordstats.left_counts(s).select("word", (F.col("n") * F.pow(F.length("word") - 1, F.lit(2))).cast("double").alias("score"))
    return _pieces(tokenize.max_score_pieces(s, scores))


@query()
def h04_lr_tokenize(spark, sf_dir):  # noqa: ANN001, ANN201
    left = tokenize.dictionary(_lexicon(spark, sf_dir))
    return _pieces(tokenize.lr_pieces(_sents(spark, sf_dir), tokenize.LRTokenizer(left, POS)))


@query()
def h05_h06_noun_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    s, n = _sents(spark, sf_dir), _lexicon(spark, sf_dir)
    j = F.array_join("tokens", " ").alias("tokens")
    chain, match = tokenize.noun_prefix_tokenize(s, n), tokenize.noun_match_tokenize(s, n)
    return chain.select("doc_id", "sent_id", F.lit("chain").alias("kind"), j).union(match.select("doc_id", "sent_id", F.lit("match"), j))


POS, NEG, WEIGHTS = ("s", "ing", "ed", "er", "'s"), ("ly", "tion", "s", "ment"), {"s": 0.9, "ing": 0.2, "ed": -0.4, "er": 0.6, "ly": -1.0, "ment": 0.8}


def _feats(spark):  # noqa: ANN001, ANN202
    one = lambda words: spark.createDataFrame([(w,) for w in words], "feature string")
    return nouns.features(one(POS), one(NEG))


def _counts(spark, sf_dir):  # noqa: ANN001, ANN202
    from ..operators.lrgraph import eojeol_counts

    return eojeol_counts(_sents(spark, sf_dir), 19)


_F = "feats AS (" + " UNION ALL ".join(f"SELECT {_lit(w)} AS f, '{'common' if w in POS and w in NEG else 'pos' if w in POS else 'neg'}' AS k" for w in dict.fromkeys(POS + NEG)) + ")"
NOUN = f"""WITH {TC}, {_F}, eo AS (SELECT tok AS eojeol, CAST(n AS BIGINT) AS n FROM tc WHERE length(tok) <= 19),
mk AS (SELECT eojeol, n, coalesce(max(length(f)) FILTER (WHERE k = 'pos'), 0) AS lp, coalesce(max(length(f)) FILTER (WHERE k = 'neg'), 0) AS ln FROM eo LEFT JOIN feats ON suffix(eojeol, f) AND k <> 'common' GROUP BY eojeol, n),
sp AS (SELECT *, left(eojeol, i) AS l, substr(eojeol, i + 1) AS r FROM (SELECT *, unnest(range(greatest(1, length(eojeol) - 9), least(10, length(eojeol)) + 1)) AS i FROM mk)),
cl AS (SELECT sp.*, coalesce(k, 'unk') AS k, lp > length(r) AS gp, ln > length(r) AS gn FROM sp LEFT JOIN feats ON r = f),
cand AS (SELECT l, CAST(sum(n) AS BIGINT) AS n FROM cl WHERE k = 'pos' GROUP BY l),
t AS (SELECT l, coalesce(sum(n) FILTER (WHERE c AND k = 'pos'), 0) AS pos, coalesce(sum(n) FILTER (WHERE c AND k = 'common'), 0) AS common, coalesce(sum(n) FILTER (WHERE c AND k = 'neg'), 0) AS neg, coalesce(sum(n) FILTER (WHERE c AND k = 'unk'), 0) AS unk, coalesce(sum(n) FILTER (WHERE r = ''), 0) AS e,
  count(*) FILTER (WHERE r <> '' AND ((k = 'pos' AND NOT gp) OR (k = 'neg' AND NOT gn))) AS nf, count(DISTINCT left(r, 1)) FILTER (WHERE r <> '' AND (k IN ('neg', 'unk') OR NOT gp)) AS n1
  FROM (SELECT *, r <> '' AND NOT gp AND NOT gn AS c FROM cl) WHERE l IN (SELECT l FROM cand) GROUP BY l),
u AS (SELECT *, CASE WHEN pos + neg = 0 THEN 0 ELSE (pos - neg) / CAST(pos + neg AS DOUBLE) END AS base, CAST(pos + common + neg + unk + e AS DOUBLE) AS total, pos + common + e AS good FROM t),
v AS (SELECT *, NOT nf > 1 AND total > 0 AND NOT (e > 30 AND pos >= neg) AND (((common > 0 OR pos > 0) AND e / total >= 0.3 AND common >= neg) OR n1 >= 2) AS share FROM u),
pr AS (SELECT l, CAST(CASE WHEN share THEN good WHEN base >= 0.3 THEN pos + e + common ELSE neg + e + common END AS BIGINT) AS support, CASE WHEN nf > 1 OR (total > 0 AND e > 30 AND pos >= neg) THEN base WHEN share THEN good / total ELSE 0.0 END AS score FROM v)"""


@query(f"{NOUN} SELECT l, n FROM cand")
def i01_noun_candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    f = _feats(spark)
    return nouns.candidates(nouns._splits(_counts(spark, sf_dir), 10, 9), f)


def _predicted(spark, sf_dir, counts=None):  # noqa: ANN001, ANN202
    f = _feats(spark)
    s = nouns._splits(cut(nouns.marked(cut(_counts(spark, sf_dir)) if counts is None else counts, f)), 10, 9)
    return nouns.predict(s.join(nouns.candidates(s, f), "l", "left_semi"), f)


@query(f"{NOUN} SELECT l, support, round(score, 6) + 0.0 AS score FROM pr")
def i03_noun_prediction(spark, sf_dir):  # noqa: ANN001, ANN201
    return _predicted(spark, sf_dir).select("l", "support", _r("score"))


@query(f"{NOUN}, nn AS (SELECT l FROM pr WHERE score >= 0.3), cov AS (SELECT DISTINCT eojeol, n FROM cl WHERE l IN (SELECT l FROM nn) AND (length(l) > 1 OR r = '' OR k IN ('pos', 'common'))), s AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM eo) AS total, (SELECT CAST(sum(n) AS BIGINT) FROM cov) AS covered) SELECT total, covered, round(covered / CAST(total AS DOUBLE), 6) AS coverage FROM s")
def i07_coverage(spark, sf_dir):  # noqa: ANN001, ANN201
    n = _predicted(spark, sf_dir).where("score >= 0.3").select(F.col("l").alias("noun"))
    return nouns.covered(_counts(spark, sf_dir), n, _feats(spark)).select("total", "covered", _r("coverage"))


@query(f"{NOUN}, nn AS (SELECT l AS noun, support, score FROM pr WHERE score >= 0.3), cut AS (SELECT noun, left(noun, i) AS l, substr(noun, i + 1) AS r FROM (SELECT noun, unnest(range(2, length(noun) - 1)) AS i FROM nn WHERE length(noun) > 3)), bad AS (SELECT noun FROM cut WHERE l IN (SELECT noun FROM nn) AND r IN (SELECT f FROM feats WHERE k = 'pos')) SELECT noun, support AS frequency FROM nn WHERE noun NOT IN (SELECT noun FROM bad) AND noun NOT IN (SELECT f FROM feats WHERE k IN ('pos', 'common'))")
def i06_noun_filters(spark, sf_dir):  # noqa: ANN001, ANN201
    n = _predicted(spark, sf_dir).where("score >= 0.3").select(F.col("l").alias("noun"), F.col("support").alias("frequency"))
    f = _feats(spark)
    return nouns.ignore_features(nouns.detaching_features(n, f), f)


@query()
def i08_nouns(spark, sf_dir):  # noqa: ANN001, ANN201
    """The whole extraction in rounds by length; tests compare the rounds with one-by-one prediction."""
    return nouns.NounExtractor(_feats(spark)).extract(_counts(spark, sf_dir)).select("noun", "frequency", _r("score"))


@query(rows("stem, ending, surfaces", ("깨닫", "아", "깨닫아 깨달아"), ("덥", "어", "더워"), ("이", "ㅂ니다", "입니다"), ("푸", "어", "퍼"), ("주", "었다", "줬다"), ("", "어", "")))
def j01_conjugate(spark, sf_dir):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([("깨닫", "아"), ("덥", "어"), ("이", "ㅂ니다"), ("푸", "어"), ("주", "었다"), ("", "어")], "stem string, ending string")
    return df.select("stem", "ending", F.array_join(morph.conjugated("stem", "ending"), " ").alias("surfaces"))


@query(rows("stem, surfaces", ("덥", "더 덥"), ("좋", "좋"), ("깨닫", "깨닫 깨달"), ("가", "가 간 갈 갑 갔")))
def j03_stem_surfaces(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "덥", "좋", "깨닫", "가", name="stem").select("stem", F.array_join(morph.surfaces_of_stem("stem"), " ").alias("surfaces"))


@query(rows("word, stem, ending", ("입니다", "이", "ㅂ니다"), ("예뻤다", "예쁘", "었다"), ("더워", "덥", "어")))
def j06_lemmatize(spark, sf_dir):  # noqa: ANN001, ANN201
    return morph.lemmatize(_strings(spark, "입니다", "예뻤다", "더워", "학교", name="word"), _strings(spark, "이", "예쁘", "덥", name="word"), _strings(spark, "ㅂ니다", "었다", "어", name="word"))


@query(rows("stem, kind", ("아름답", "Adjective"), ("거들먹거리", "Verb"), ("먹", None)))
def j07_rule_class(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "아름답", "거들먹거리", "먹", name="stem").select("stem", morph.rule_class("stem").alias("kind"))


@query(rows("stem, adverb", ("조용하", "조용히"), ("먹", None)))
def j18_stem_to_adverb(spark, sf_dir):  # noqa: ANN001, ANN201
    return _strings(spark, "조용하", "먹", name="stem").select("stem", morph.stem_to_adverb("stem").alias("adverb"))


@query()
def j26_tag(spark, sf_dir):  # noqa: ANN001, ANN201
    words = _lexicon(spark, sf_dir).select(F.lit("Noun").alias("tag"), "word").union(spark.createDataFrame([("Josa", w) for w in POS], "tag string, word string"))
    return tagger.tag(_sents(spark, sf_dir), tagger.lr_tagger(tagger.Dictionary.of(words)))


@query(rows("tag, label", *tagger.LABELS.items()))
def j31_tagset(spark, sf_dir):  # noqa: ANN001, ANN201
    return tagger.tagset(spark)


@query(f"WITH {TOKS} SELECT doc_id, sent_id, array_to_string(t, ' ') AS tokens FROM toks")
def h07_split(spark, sf_dir):  # noqa: ANN001, ANN201
    from ..functions.tokens import split_words

    return _sents(spark, sf_dir).select("doc_id", "sent_id", F.array_join(split_words("sent"), " ").alias("tokens"))
