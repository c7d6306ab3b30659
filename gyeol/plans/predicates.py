"""Queries of the news variant of noun extraction, of weighted noun extraction, of predicates and of parts of speech.

What doesn't depend on the script runs on the tables; Hangul runs on inline rows, with results derived by hand as SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morph
from ..operators import news_nouns, nouns, pos, predicates, tagger
from ..session import cut
from .korean import WEIGHTS, _counts, _feats, _lit, _predicted, rows
from .stats import TC, _r, _sents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _weights(spark):  # noqa: ANN001, ANN202
    return spark.createDataFrame(list(WEIGHTS.items()), "feature string, weight double")


def _words(spark, *words):  # noqa: ANN001, ANN002, ANN202
    return spark.createDataFrame([(w,) for w in words], "word string")


# --- news nouns, on the tables -----------------------------------------------------------------------------------

ENDS = ("ing", "ed", "tion")
NEWS = f"""WITH {TC}, eo AS (SELECT tok AS eojeol, CAST(n AS BIGINT) AS n FROM tc WHERE length(tok) <= 17),
g AS (SELECT left(eojeol, i) AS l, substr(eojeol, i + 1) AS r, n FROM (SELECT *, unnest(range(greatest(1, length(eojeol) - 7), least(10, length(eojeol)) + 1)) AS i FROM eo)),
w(f, wt) AS (VALUES {', '.join(f'({_lit(k)}, {_lit(v)})' for k, v in WEIGHTS.items())}),
t AS MATERIALIZED (SELECT l, CAST(sum(n) AS BIGINT) AS frequency, coalesce(sum(n) FILTER (WHERE wt IS NOT NULL), 0) AS norm, coalesce(sum(n * wt), 0.0) AS s, count(wt) AS kinds, count(*) FILTER (WHERE wt > 0) AS k, coalesce(sum(n) FILTER (WHERE r = ''), 0) AS whole FROM g LEFT JOIN w ON r = f GROUP BY l),
sc AS MATERIALIZED (SELECT l, CASE WHEN norm > 0 THEN s / CAST(norm AS DOUBLE) ELSE 0.0 END AS score, frequency, CASE WHEN frequency > whole THEN norm / CAST(frequency - whole AS DOUBLE) ELSE 0.0 END AS feature_proportion, whole / CAST(frequency AS DOUBLE) AS eojeol_proportion, k AS n_positive_feature, CASE WHEN kinds > 0 THEN k / CAST(kinds AS DOUBLE) ELSE 0.0 END AS unique_positive_feature_proportion FROM t)"""


def _news(spark, sf_dir):  # noqa: ANN001, ANN202
    return news_nouns.NewsNounExtractor(_weights(spark), _words(spark, *ENDS)).train(_sents(spark, sf_dir))


@query(f"{NEWS} SELECT l, r, n AS count FROM g")
def i15_news_graph(spark, sf_dir):  # noqa: ANN001, ANN201
    return news_nouns.news_graph(_sents(spark, sf_dir))[1]


@query(f"{NEWS} SELECT l, round(score, 6) + 0.0 AS score, frequency, round(feature_proportion, 6) AS feature_proportion, round(eojeol_proportion, 6) AS eojeol_proportion, n_positive_feature, round(unique_positive_feature_proportion, 6) AS unique_positive_feature_proportion FROM sc")
def i16_news_scores(spark, sf_dir):  # noqa: ANN001, ANN201
    counts, graph = news_nouns.news_graph(_sents(spark, sf_dir))
    s = news_nouns.news_scores(graph, counts, _weights(spark))
    return s.select("l", _r("score"), "frequency", _r("feature_proportion"), _r("eojeol_proportion"), "n_positive_feature", _r("unique_positive_feature_proportion"))


@query(f"{NEWS} SELECT DISTINCT left(l, 2) AS l FROM sc WHERE frequency >= 3 AND eojeol_proportion >= 0.99 AND length(l) >= 4 AND substr(l, 3) IN ({', '.join(map(_lit, ENDS))}) AND left(l, 2) IN (SELECT l FROM sc WHERE score >= 0.4)")
def i17_nouns_before_verbs(spark, sf_dir):  # noqa: ANN001, ANN201
    return _news(spark, sf_dir).nouns_before_verbs()


@query()
def i18_news_filters(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tests compare each rule with its definition on a small corpus."""
    x = _news(spark, sf_dir)
    return x.postprocess(x.scored(), x.dictionary()).select("l", _r("score"), "frequency")


@query()
def i19_news_compounds(spark, sf_dir):  # noqa: ANN001, ANN201
    x = _news(spark, sf_dir)
    d, s = x.dictionary(), x.scored()
    return x.compounds_of_eojeols(s, x.postprocess(s, d), d)


@query(f"{NEWS} SELECT l, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY l")
def i20_l_frequency(spark, sf_dir):  # noqa: ANN001, ANN201
    return news_nouns.l_frequency(news_nouns.news_graph(_sents(spark, sf_dir))[1])


@query()
def i21_news_nouns(spark, sf_dir):  # noqa: ANN001, ANN201
    x = _news(spark, sf_dir).extract()
    return x.select("noun", _r("score"), "frequency", _r("feature_proportion"), _r("eojeol_proportion"), "n_positive_feature", _r("unique_positive_feature_proportion"))


# --- other parts of noun extraction, on the tables ---------------------------------------------------------------


@query()
def i04_longest_first(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tests compare the rounds with one-by-one prediction."""
    return nouns.predict_longest_first(_counts(spark, sf_dir), _feats(spark))[0].select("l", "support", _r("score"))


@query()
def i05_compounds(spark, sf_dir):  # noqa: ANN001, ANN201
    c, f = cut(_counts(spark, sf_dir)), _feats(spark)
    found = nouns.compounds(c, _predicted(spark, sf_dir, c).select("l", "support", "score"), f)
    return found.select("noun", F.array_join("parts", " ").alias("parts"), "frequency", _r("score"))


@query()
def i09_domain_features(spark, sf_dir):  # noqa: ANN001, ANN201
    c = cut(_counts(spark, sf_dir))
    n = _predicted(spark, sf_dir, c).where("score >= 0.3").select(F.col("l").alias("noun"))
    return nouns.domain_features(c, n, _feats(spark), min_frequency=100).select("feature", _r("score"), "frequency")


WEIGHTED = f"""WITH {TC}, eo AS (SELECT tok AS eojeol, CAST(n AS BIGINT) AS n FROM tc WHERE length(tok) <= 19 AND length(tok) > 0),
lc AS MATERIALIZED (SELECT l, CAST(sum(n) AS BIGINT) AS l_n FROM (SELECT n, left(eojeol, unnest(range(1, least(10, length(eojeol)) + 1))) AS l FROM eo) GROUP BY l HAVING sum(n) >= 5),
rc AS MATERIALIZED (SELECT r FROM (SELECT n, right(eojeol, unnest(range(1, least(7, length(eojeol) - 1) + 1))) AS r FROM eo) GROUP BY r HAVING sum(n) >= 5),
g AS MATERIALIZED (SELECT eojeol, l, r, n FROM (SELECT eojeol, left(eojeol, i) AS l, substr(eojeol, i + 1) AS r, n FROM (SELECT *, unnest(range(greatest(1, length(eojeol) - 7), least(10, length(eojeol)) + 1)) AS i FROM eo)) WHERE l IN (SELECT l FROM lc) AND (r = '' OR r IN (SELECT r FROM rc))),
w(f, wt) AS (VALUES {', '.join(f'({_lit(k)}, {_lit(v)})' for k, v in WEIGHTS.items())}),
long AS MATERIALIZED (SELECT eojeol, max(length(f)) AS longest FROM (SELECT DISTINCT eojeol FROM g) JOIN w ON suffix(eojeol, f) GROUP BY eojeol),
m AS (SELECT l, r, n, wt, wt IS NOT NULL AND coalesce(longest, 0) <= length(r) AS known FROM g LEFT JOIN w ON r = f LEFT JOIN long USING (eojeol) WHERE r <> ''),
t AS (SELECT l, count(*) AS kinds, coalesce(sum(n * wt) FILTER (WHERE known), 0.0) AS s, coalesce(sum(n) FILTER (WHERE known), 0) AS norm, coalesce(sum(n) FILTER (WHERE wt IS NULL), 0) AS unk FROM m GROUP BY l),
sc AS MATERIALIZED (SELECT l, CASE WHEN kinds > 1 AND norm > 0 THEN s / CAST(norm AS DOUBLE) ELSE 0.0 END AS score, CASE WHEN kinds > 1 AND norm + unk > 0 THEN norm / CAST(norm + unk AS DOUBLE) ELSE 0.0 END AS known FROM t)"""


@query(f"{WEIGHTED} SELECT l, round(score, 6) + 0.0 AS score, round(known, 6) AS known FROM sc")
def i11_weighted_score(spark, sf_dir):  # noqa: ANN001, ANN201
    return nouns.weighted_score(nouns.weighted_graph(_counts(spark, sf_dir)), _weights(spark)).select("l", _r("score"), _r("known"))


@query(f"""{WEIGHTED}, best AS (SELECT eojeol, max(length(l)) AS k, max(n) AS n FROM g WHERE l IN (SELECT l FROM sc WHERE score >= 0.5) GROUP BY eojeol)
SELECT l AS noun, CAST(coalesce(sum(n), 0) AS BIGINT) AS frequency FROM sc LEFT JOIN (SELECT left(eojeol, k) AS b, n FROM best) ON l = b WHERE score >= 0.5 GROUP BY l""")
def i13_longest_noun_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    g = nouns.weighted_graph(_counts(spark, sf_dir))
    return nouns.longest_noun_counts(g, nouns.weighted_score(g, _weights(spark)).where("score >= 0.5").select(F.col("l").alias("noun"))).select("noun", "frequency")


@query()
def i14_weighted_nouns(spark, sf_dir):  # noqa: ANN001, ANN201
    return nouns.extract_weighted(_counts(spark, sf_dir), _weights(spark)).select("noun", "frequency", _r("score"), _r("known_r_ratio"))


# --- Hangul, on inline rows --------------------------------------------------------------------------------------

ADJECTIVES, VERBS, NOUNS, JOSA = ("예쁘", "좋", "조용하"), ("먹", "가", "보"), ("학교", "친구", "고기", "먹이"), ("가", "에", "네")
ENDINGS = ("었다", "다", "고", "어", "ㄴ다", "자", "았다", "는", "는다", "아라", "ㄹ까", "네")
COUNTS = {
    "먹었다": 5, "먹고": 4, "먹는다": 3, "먹자": 2, "먹네": 6, "갔다": 7, "가고": 5, "간다": 4, "가자": 3, "가네": 4, "봤다": 4, "보고": 4, "보네": 3,
    "좋네": 5, "좋고": 5, "좋다": 9, "예쁘네": 4, "예쁘고": 3, "예뻤다": 3, "학교네": 2, "친구가": 8, "친구": 3, "학교": 4, "학교에": 6, "먹이": 3, "고기": 7,
}
MORE = {"친구예쁘네": 2, "학교먹고": 3, "조용히": 2, "먹고가자": 4, "좋네요": 1, "보았다": 2, "말가고": 1, "고": 3, "친구학교": 5, "친구학교에": 2, "음": 1, "먹고보네": 2}


def _eojeols(spark, *tables):  # noqa: ANN001, ANN002, ANN202
    return spark.createDataFrame([x for t in tables for x in t.items()], "eojeol string, count long")


def _stems(spark):  # noqa: ANN001, ANN202
    return _words(spark, *ADJECTIVES, *VERBS)


@query(rows("r, support, score", ("고", 21, 1.0), ("네", 22, 0.833333), ("다", 27, 0.542857), ("는다", 0, 0.0), ("었다", 0, 0.0), ("이", 0, 0.0), ("자", 0, 0.0)))
def j08_j09_ending_rounds(spark, sf_dir):  # noqa: ANN001, ANN201
    found = predicates.endings_longest_first(_eojeols(spark, COUNTS), predicates.surfaces(_stems(spark)), _words(spark, *NOUNS), min_features=3)
    return found.select("r", F.col("support").cast("int").alias("support"), _r("score"))


@query(rows("ending, frequency, score", ("ㄴ다", 4, 0.542857), ("ㅆ다", 7, 0.542857), ("고", 21, 1.0), ("네", 22, 0.833333), ("다", 9, 0.542857), ("았다", 4, 0.542857), ("었다", 3, 0.542857)))
def j10_endings(spark, sf_dir):  # noqa: ANN001, ANN201
    found = predicates.extract_endings(_eojeols(spark, COUNTS), _stems(spark), _words(spark, *NOUNS), min_features=3)
    return found.select("ending", F.col("frequency").cast("int").alias("frequency"), _r("score"))


@query(rows("word, l, r", *[(w, w[:k], w[k:]) for w, k in (("가고", 1), ("가네", 1), ("가자", 1), ("간다", 1), ("갔다", 1), ("먹고", 1), ("먹네", 1), ("먹는다", 1), ("먹었다", 1), ("먹자", 1), ("보고", 1), ("보네", 1), ("봤다", 1), ("예뻤다", 2), ("예쁘고", 2), ("예쁘네", 2), ("좋고", 1), ("좋네", 1), ("좋다", 1))]))
def j11_attested_conjugations(spark, sf_dir):  # noqa: ANN001, ANN201
    return predicates.attested(_eojeols(spark, COUNTS), _stems(spark), _words(spark, *ENDINGS)).select("word", "l", "r").distinct()


NEW_STEM = {"달리" + e: n for e, n in (("고", 9), ("네", 8), ("자", 7), ("다", 6))} | {"빨리": 3}


@query(rows("l, score, frequency", ("달리", 1.0, 15), ("빨리", 0.0, 0)))
def j12_stem_prediction(spark, sf_dir):  # noqa: ANN001, ANN201
    counts = _eojeols(spark, COUNTS, NEW_STEM)
    known = predicates.attested(counts, _stems(spark), _words(spark, *ENDINGS))
    words = spark.createDataFrame([("달리",), ("빨리",)], "l string")
    found = predicates.predict_stems(predicates.lr_graph(counts), words, known.select("l"), known.select("r"), min_chars=3)
    return found.select("l", _r("score"), F.col("frequency").cast("int").alias("frequency"))


@query()
def j13_stems(spark, sf_dir):  # noqa: ANN001, ANN201
    counts = _eojeols(spark, COUNTS, NEW_STEM, {"달리었다": 5})
    endings = [e for e in ENDINGS if e != "었다"]
    return predicates.extract_stems(counts, _stems(spark), _words(spark, *endings), min_frequency=10, min_chars=3).select("stem", "frequency", _r("score"))


def _extractor(spark, **options):  # noqa: ANN001, ANN003, ANN202
    return predicates.PredicateExtractor(*[_words(spark, *w) for w in (NOUNS, JOSA, ADJECTIVES, VERBS, ENDINGS)], **options)


LEMMAS = (
    ("가고", 5, "가", "고", "Verb"), ("가네", 4, "가", "네", "Verb"), ("가자", 3, "가", "자", "Verb"), ("간다", 4, "가", "ㄴ다", "Verb"), ("먹고", 4, "먹", "고", "Verb"), ("먹네", 6, "먹", "네", "Verb"), ("먹는다", 3, "먹", "는다", "Verb"),
    ("먹었다", 5, "먹", "었다", "Verb"), ("먹자", 2, "먹", "자", "Verb"), ("보고", 4, "보", "고", "Verb"), ("보네", 3, "보", "네", "Verb"), ("봤다", 4, "보", "았다", "Verb"), ("예뻤다", 3, "예쁘", "었다", "Adjective"), ("예쁘고", 3, "예쁘", "고", "Adjective"),
    ("예쁘네", 4, "예쁘", "네", "Adjective"), ("좋고", 5, "좋", "고", "Adjective"), ("좋네", 5, "좋", "네", "Adjective"), ("좋다", 9, "좋", "다", "Adjective"),
)


@query(rows("word, frequency, stem, ending, kind", *LEMMAS))
def j14_predicates(spark, sf_dir):  # noqa: ANN001, ANN201
    found = _extractor(spark).train(_eojeols(spark, COUNTS)).extract()
    return found.select("word", F.col("frequency").cast("int").alias("frequency"), "stem", "ending", "kind")


@query(rows("word, stem, ending", *[(w, s, e) for w, _, s, e, _ in LEMMAS]))
def j15_lemma_candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    found = predicates.lemma_candidates(_eojeols(spark, COUNTS), _words(spark, *NOUNS), _words(spark, *JOSA), _stems(spark), _words(spark, *ENDINGS))
    return found.select("word", "stem", "ending")


WRONG = (("가고", "고"), ("나고", "고"), ("가물", "물"), ("나물", "물"), ("다물", "물"), ("가다가", "다가"), ("나다가", "다가"), ("하기", "기"), ("나하기", "기"), ("다시", "ㅅ시"), ("또다시", "ㅅ시"))


@query(rows("kind, word, ending", ("always", None, "물"), ("pair", "가물", "물"), ("pair", "나물", "물"), ("pair", "다물", "물"), ("pair", "하기", "기"), ("pair", "다시", "ㅅ시"), ("pair", "또다시", "ㅅ시")))
def j16_wrong_endings(spark, sf_dir):  # noqa: ANN001, ANN201
    lemmas = spark.createDataFrame([(w, 1, w[:-1], e) for w, e in WRONG], "word string, frequency long, stem string, ending string")
    always, pairs = predicates.wrong_endings(lemmas, _words(spark, "나물", "가물", "하기", "다시"))
    return always.select(F.lit("always").alias("kind"), F.lit(None).cast("string").alias("word"), F.col("word").alias("ending")).union(pairs.select(F.lit("pair"), "word", "ending"))


@query(rows("stem, kind", ("먹", "Verb"), ("예쁘", "Adjective"), ("아름답", "Adjective"), ("거들먹거리", "Verb"), ("달리", "Verb"), ("푸르", "Adjective")))
def j17_adjective_or_verb(spark, sf_dir):  # noqa: ANN001, ANN201
    made = [("먹고", "먹", "고"), ("예쁘고", "예쁘", "고"), ("아름답고", "아름답", "고"), ("거들먹거리고", "거들먹거리", "고"), ("달린다", "달리", "ㄴ다"), ("달리자", "달리", "자"), ("푸르다", "푸르", "다")]
    lemmas = spark.createDataFrame([(w, 1, s, e) for w, s, e in made], "word string, frequency long, stem string, ending string")
    return predicates.adjective_or_verb(lemmas, _words(spark, "예쁘"), _words(spark, "먹")).select("stem", "kind").distinct()


def _tagged(spark, chat):  # noqa: ANN001, ANN202
    x = _extractor(spark).train(_eojeols(spark, COUNTS))
    found = x.extract()
    return pos.tag_words(_eojeols(spark, COUNTS, MORE), _words(spark, *NOUNS), found, _words(spark, *ADJECTIVES), _words(spark, *VERBS), x.endings, _words(spark, "가", "에"), _words(spark, "빨리"), chat)


COMMON = (
    ("Adjective", "예뻤다", 3), ("Adjective", "예쁘고", 3), ("Adjective", "예쁘네", 6), ("Adjective", "좋고", 5), ("Adjective", "좋네", 5), ("Adjective", "좋다", 9), ("Adverb", "조용히", 2), ("Irrecognizable", "갔다", 7), ("Irrecognizable", "보았다", 2),
    ("Irrecognizable", "좋네요", 1), ("Irrecognizable", "학교네", 2), ("Josa", "가", 8), ("Josa", "에", 6), ("Noun", "고기", 7), ("Noun", "말", 1), ("Noun", "먹이", 3), ("Noun", "친구", 13), ("Noun", "학교", 13), ("Verb", "가고", 6), ("Verb", "가네", 4),
    ("Verb", "가자", 3), ("Verb", "간다", 4), ("Verb", "먹고", 7), ("Verb", "먹고가자", 4), ("Verb", "먹고보네", 2), ("Verb", "먹네", 6), ("Verb", "먹는다", 3), ("Verb", "먹었다", 5), ("Verb", "먹자", 2), ("Verb", "보고", 4), ("Verb", "보네", 3), ("Verb", "봤다", 4),
)


@query(rows("tag, word, count", *COMMON, ("Noun", "친구학교", 7)))
def j19_news_pos(spark, sf_dir):  # noqa: ANN001, ANN201
    return _tagged(spark, False)[0].select("tag", "word", F.col("count").cast("int").alias("count"))


@query(rows("tag, word, count", *COMMON, ("Irrecognizable", "친구학교", 5), ("Irrecognizable", "친구학교에", 2)))
def j20_chat_pos(spark, sf_dir):  # noqa: ANN001, ANN201
    return _tagged(spark, True)[0].select("tag", "word", F.col("count").cast("int").alias("count"))


@query(rows("word, stem, ending", *[(w, s, e) for w, _, s, e, _ in LEMMAS], ("먹고가자", "먹고가", "자"), ("먹고보네", "먹고보", "네")))
def j19_predicate_lemmas(spark, sf_dir):  # noqa: ANN001, ANN201
    return _tagged(spark, False)[1].select("word", "stem", "ending")


@query(rows("stem, ending, surfaces", ("가", "ㅋㅋ", "갘ㅋ"), ("먹", "", "먹"), ("좋", "네", "좋네")))
def j02_conjugate_chat(spark, sf_dir):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([("가", "ㅋㅋ"), ("먹", ""), ("좋", "네")], "stem string, ending string")
    return df.select("stem", "ending", F.array_join(morph.conjugated("stem", "ending", chat=True), " ").alias("surfaces"))


@query(rows("tag, word", ("Noun", "노래"), ("Noun", "학교"), ("Josa", "의")))
def j21_dictionary(spark, sf_dir):  # noqa: ANN001, ANN201
    d = tagger.Dictionary.of(spark.createDataFrame([("Noun", "노래"), ("Noun", "나무"), ("Josa", "의")], "tag string, word string"))
    return d.with_words("Noun", ["학교"]).without_words("Noun", ["나무"]).table(spark)
