"""Queries over the tables: corpus, sub-word statistics, L-R graph, phrases, vectors, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, lrgraph, phrase, vectorizer, wordstats
from ..sources import corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query, with its SQL where there is one."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).select("doc_id", "text")


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentences(_docs(spark, sf_dir))


def _r(c: str, places: int = 6):  # noqa: ANN202
    return (F.round(c, places) + 0.0).alias(c)


SENT = r"""sent AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_id, trim(p[i]) AS sent FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(p[i]) <> '')"""
TOKS = SENT + r""", toks AS (SELECT doc_id, sent_id, list_filter(regexp_split_to_array(sent, '\s+'), lambda x: x <> '') AS t FROM sent)"""
TC = TOKS + ", tc AS MATERIALIZED (SELECT tok, count(*) AS n FROM (SELECT unnest(t) AS tok FROM toks) GROUP BY tok)"
SUB = TC + """, lc AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT left(tok, i) AS word, n FROM (SELECT tok, n, unnest(range(1, least(11, length(tok)) + 1)) AS i FROM tc WHERE length(tok) >= 2)) GROUP BY word HAVING sum(n) >= 5),
rc AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT right(tok, i) AS word, n FROM (SELECT tok, n, unnest(range(1, least(6, length(tok) - 1) + 1)) AS i FROM tc WHERE length(tok) >= 2)) GROUP BY word HAVING sum(n) >= 5)"""
EXT = SUB + """, nb AS (SELECT tok, nxt, prv, count(*) AS n FROM (SELECT t[i] AS tok, left(t[i % len(t) + 1], 1) AS nxt, right(t[(i + len(t) - 2) % len(t) + 1], 1) AS prv FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM toks WHERE len(t) >= 2)) GROUP BY ALL),
al AS (SELECT root, ext, CAST(sum(n) AS BIGINT) AS n FROM (SELECT tok AS root, nxt AS ext, n FROM nb UNION ALL SELECT right(tok, i), nxt, n FROM (SELECT *, unnest(range(1, least(6, length(tok) - 1) + 1)) AS i FROM nb)) GROUP BY ALL HAVING sum(n) > 1),
ar AS (SELECT root, ext, CAST(sum(n) AS BIGINT) AS n FROM (SELECT tok AS root, prv AS ext, n FROM nb UNION ALL SELECT left(tok, i), prv, n FROM (SELECT *, unnest(range(1, least(10, length(tok) - 1) + 1)) AS i FROM nb)) GROUP BY ALL HAVING sum(n) > 1)"""
WORDS = """, words AS (SELECT word, CAST(sum(l) AS BIGINT) AS lf, CAST(sum(r) AS BIGINT) AS rf FROM (SELECT word, n AS l, 0 AS r FROM lc WHERE length(word) <= 10 UNION ALL SELECT word, 0, n FROM rc WHERE length(word) <= 6) GROUP BY word)"""
COH = """, coh AS (SELECT word, lf, rf, CASE WHEN length(word) <= 1 OR lf = 0 THEN 0.0 ELSE pow(lf / CAST(h.n AS DOUBLE), 1.0 / (length(word) - 1)) END AS cf, CASE WHEN length(word) <= 1 OR rf = 0 THEN 0.0 ELSE pow(rf / CAST(t.n AS DOUBLE), 1.0 / (length(word) - 1)) END AS cb
FROM words LEFT JOIN (SELECT word AS hw, n FROM lc WHERE length(word) = 1) h ON left(word, 1) = hw LEFT JOIN (SELECT word AS tw, n FROM rc WHERE length(word) = 1) t ON right(word, 1) = tw)"""


def _boundary(cap: bool) -> str:
    a, b = ("WHERE length(root) <= 9", "WHERE length(root) <= 5") if cap else ("", "")
    return f""", rb AS (SELECT root AS word, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0.0) AS be, count(*) AS av FROM (SELECT left(word, length(word) - 1) AS root, n FROM lc WHERE length(word) >= 2 UNION ALL SELECT root, n FROM al) {a} GROUP BY root),
lb AS (SELECT root AS word, greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0.0) AS be, count(*) AS av FROM (SELECT substr(word, 2) AS root, n FROM rc WHERE length(word) >= 2 UNION ALL SELECT root, n FROM ar) {b} GROUP BY root),
bd AS (SELECT coalesce(lb.word, rb.word) AS word, coalesce(lb.be, 0) AS lbe, coalesce(rb.be, 0) AS rbe, coalesce(lb.av, 0) AS lav, coalesce(rb.av, 0) AS rav FROM lb FULL JOIN rb ON lb.word = rb.word)"""


SCORES = "round(cf, 6) + 0.0 AS cohesion_forward, round(cb, 6) + 0.0 AS cohesion_backward, round(coalesce(lbe, 0), 6) + 0.0 AS left_branching_entropy, round(coalesce(rbe, 0), 6) + 0.0 AS right_branching_entropy, CAST(coalesce(lav, 0) AS BIGINT) AS left_accessor_variety, CAST(coalesce(rav, 0) AS BIGINT) AS right_accessor_variety, lf AS leftside_frequency, rf AS rightside_frequency"
WS = "WITH " + EXT + WORDS + COH + _boundary(True)


@query(f"WITH {SENT} SELECT doc_id, sent_id, sent FROM sent")
def a03_sentences(spark, sf_dir):  # noqa: ANN001, ANN201
    return _sents(spark, sf_dir)


@query(f"WITH {SENT} SELECT (SELECT count(*) FROM documents) AS num_doc, CAST((SELECT count(*) FROM sent) AS BIGINT) AS num_sent")
def a02_corpus_length(spark, sf_dir):  # noqa: ANN001, ANN201
    return corpus.corpus_length(_docs(spark, sf_dir))


@query(f"WITH {TC} SELECT tok || ' ' || n AS value FROM tc WHERE length(tok) <= 15")
def a04_eojeol_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.eojeol_counts(_sents(spark, sf_dir)).select(F.concat_ws(" ", "eojeol", "count").alias("value"))


LR = TC + """, eo AS (SELECT tok AS eojeol, n AS count FROM tc WHERE length(tok) <= 15), lr AS MATERIALIZED (SELECT left(eojeol, i) AS l, substr(eojeol, i + 1) AS r, count FROM (SELECT *, unnest(range(greatest(1, length(eojeol) - 9), least(10, length(eojeol)) + 1)) AS i FROM eo))"""


def _eo(spark, sf_dir):  # noqa: ANN001, ANN202
    return lrgraph.eojeol_counts(_sents(spark, sf_dir))


def _lr(spark, sf_dir):  # noqa: ANN001, ANN202
    return lrgraph.lr_graph(_eo(spark, sf_dir))


@query(f"WITH {LR} SELECT rtrim(l || ' ' || r) || ' ' || count AS value FROM lr")
def a05_lrgraph_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    line = F.when(F.col("r") == "", F.concat_ws(" ", "l", "count")).otherwise(F.concat_ws(" ", "l", "r", "count"))
    return _lr(spark, sf_dir).select(line.alias("value"))


@query(f"WITH {SUB} SELECT 'L' AS side, word, n FROM lc UNION ALL SELECT 'R', word, n FROM rc")
def c01_substring_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _sents(spark, sf_dir)
    return wordstats.left_counts(s).select(F.lit("L").alias("side"), "word", "n").union(wordstats.right_counts(s).select(F.lit("R"), "word", "n"))


@query(f"WITH {EXT} SELECT 'aL' AS side, root, ext, n FROM al UNION ALL SELECT 'aR', root, ext, n FROM ar")
def c02_boundary_extensions(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _sents(spark, sf_dir)
    return wordstats.right_extensions(s).select(F.lit("aL").alias("side"), "root", "ext", "n").union(wordstats.left_extensions(s).select(F.lit("aR"), "root", "ext", "n"))


@query(f"WITH {SUB} SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM lc UNION ALL SELECT * FROM lc) GROUP BY word")
def c03_cumulated_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    left = wordstats.left_counts(_sents(spark, sf_dir))
    return wordstats.cumulate(left, left)


@query(f"WITH {SUB}{WORDS} SELECT word FROM words")
def c05_words(spark, sf_dir):  # noqa: ANN001, ANN201
    return wordstats.WordStats(_sents(spark, sf_dir)).words().select("word")


@query(f"WITH {SUB}{WORDS}{COH} SELECT word, round(cf, 6) + 0.0 AS cohesion_forward, round(cb, 6) + 0.0 AS cohesion_backward FROM coh WHERE cf <> 0 OR cb <> 0")
def c06_cohesion(spark, sf_dir):  # noqa: ANN001, ANN201
    c = wordstats.WordStats(_sents(spark, sf_dir)).cohesion().where("cohesion_forward <> 0 or cohesion_backward <> 0")
    return c.select("word", _r("cohesion_forward"), _r("cohesion_backward"))


def _bounds(spark, sf_dir, cap, kind):  # noqa: ANN001, ANN202
    b = wordstats.WordStats(_sents(spark, sf_dir)).boundary(cap)
    cols = [c for c in b.columns if c.endswith(kind)]
    return b.select("word", *[_r(c) if kind == "entropy" else F.col(c).cast("long") for c in cols])


ENT = "SELECT word, round(lbe, 6) + 0.0 AS left_branching_entropy, round(rbe, 6) + 0.0 AS right_branching_entropy FROM bd"


@query(f"WITH {EXT}{_boundary(True)} {ENT}")
def c07_branching_entropy(spark, sf_dir):  # noqa: ANN001, ANN201
    return _bounds(spark, sf_dir, True, "entropy")


@query(f"WITH {EXT}{_boundary(True)} SELECT word, CAST(lav AS BIGINT) AS left_accessor_variety, CAST(rav AS BIGINT) AS right_accessor_variety FROM bd")
def c08_accessor_variety(spark, sf_dir):  # noqa: ANN001, ANN201
    return _bounds(spark, sf_dir, True, "variety")


@query(f"WITH {EXT}{_boundary(False)} {ENT}")
def c09_entropy_of_any_word(spark, sf_dir):  # noqa: ANN001, ANN201
    return _bounds(spark, sf_dir, False, "entropy")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("word", *[_r(c) for c in df.columns[1:5]], *[F.col(c).cast("long") for c in df.columns[5:]])


@query(f"{WS} SELECT word, {SCORES} FROM coh LEFT JOIN bd USING (word)")
def c10_word_scores(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(wordstats.WordStats(_sents(spark, sf_dir)).scores())


ACCEPT = f"{WS}, sc AS (SELECT word, {SCORES} FROM coh LEFT JOIN bd USING (word)), ok AS (SELECT * FROM sc WHERE right_branching_entropy >= 0.5 AND greatest(leftside_frequency, rightside_frequency) >= 20 AND (length(word) < 2 OR cohesion_forward >= 0.1))"


def _accepted(spark, sf_dir, remove):  # noqa: ANN001, ANN202
    return _rounded(wordstats.WordStats(_sents(spark, sf_dir)).extract(min_cohesion_forward=0.1, min_right_branching_entropy=0.5, min_frequency=20, remove_subwords=remove, max_droprate_leftside_frequency=0.6))


@query(f"{ACCEPT} SELECT * FROM ok")
def c11_extract(spark, sf_dir):  # noqa: ANN001, ANN201
    return _accepted(spark, sf_dir, False)


@query(f"{ACCEPT} SELECT * FROM ok WHERE word NOT IN (SELECT left(o.word, length(o.word) - 1) FROM ok o JOIN lc ON lc.word = left(o.word, length(o.word) - 1) WHERE length(o.word) >= 2 AND o.leftside_frequency / CAST(lc.n AS DOUBLE) > 0.6)")
def c12_remove_subwords(spark, sf_dir):  # noqa: ANN001, ANN201
    return _accepted(spark, sf_dir, True)


@query(f"{WS} SELECT word, lf AS leftside_frequency, round(score, 6) + 0.0 AS score FROM (SELECT word, lf, cf * exp(coalesce(rbe, 0)) AS score FROM coh LEFT JOIN bd USING (word)) ORDER BY score DESC, word LIMIT 100")
def c13_ranking(spark, sf_dir):  # noqa: ANN001, ANN201
    top = wordstats.ranking(wordstats.WordStats(_sents(spark, sf_dir)).scores(), 100)
    return top.select("word", "leftside_frequency", _r("score"))


@query(f"WITH {LR} SELECT eojeol, count FROM eo WHERE count >= 2")
def d01_eojeol_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.eojeol_counts(_sents(spark, sf_dir), min_count=2)


@query(f"WITH {LR} SELECT CAST(sum(count) AS BIGINT) AS total, count(*) AS unique FROM eo")
def d02_eojeol_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.summary(_eo(spark, sf_dir))


@query(f"WITH {LR} SELECT CAST(sum(count) AS BIGINT) AS total, CAST(sum(count) FILTER (length(eojeol) > 3) AS BIGINT) AS rest, CAST(count(*) FILTER (length(eojeol) > 3) AS BIGINT) AS unique_rest, round(1 - sum(count) FILTER (length(eojeol) > 3) / CAST(sum(count) AS DOUBLE), 6) + 0.0 AS coverage FROM eo")
def d03_coverage(spark, sf_dir):  # noqa: ANN001, ANN201
    c = _eo(spark, sf_dir)
    left = lrgraph.remove_covered(c, c.where(F.length("eojeol") <= 3))
    return lrgraph.coverage(c, left).select("total", "rest", "unique_rest", _r("coverage"))


@query(f"WITH {LR} SELECT * FROM lr")
def d04_lrgraph(spark, sf_dir):  # noqa: ANN001, ANN201
    return _lr(spark, sf_dir)


@query(f"WITH {TC}, lr AS MATERIALIZED (SELECT left(tok, i) AS l, substr(tok, i + 1) AS r, n AS count FROM (SELECT *, unnest(range(greatest(1, length(tok) - 6), least(10, length(tok)) + 1)) AS i FROM tc)) SELECT * FROM lr")
def d05_lrgraph_of_sentences(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.lr_graph(lrgraph.eojeol_counts(_sents(spark, sf_dir), max_length=1 << 30), 10, 6)


@query(f"WITH {LR} SELECT r, l, count FROM lr WHERE r <> ''")
def d06_inverse_graph(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.inverse(_lr(spark, sf_dir))


@query(f"WITH {LR} SELECT l, r, count, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l ORDER BY count DESC, r) AS INTEGER) AS rank FROM lr) WHERE rank <= 3")
def d07_top_r(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.top_r(_lr(spark, sf_dir), 3)


@query(f"WITH {LR} SELECT r, l, count, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY count DESC, l) AS INTEGER) AS rank FROM lr WHERE r <> '') WHERE rank <= 3")
def d07_top_l(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.top_l(_lr(spark, sf_dir), 3)


@query(f"WITH {LR} SELECT l, r, CAST(sum(count) AS BIGINT) AS count FROM (SELECT * FROM lr UNION ALL SELECT * FROM lr WHERE length(l) = 2) GROUP BY l, r")
def d08_add_pairs(spark, sf_dir):  # noqa: ANN001, ANN201
    g = _lr(spark, sf_dir)
    return lrgraph.add_pairs(g, g.where(F.length("l") == 2))


@query(f"WITH {LR} SELECT l, r, count - CASE WHEN r = '' THEN 3 ELSE 0 END AS count FROM lr WHERE count - CASE WHEN r = '' THEN 3 ELSE 0 END > 0")
def d09_remove_pairs(spark, sf_dir):  # noqa: ANN001, ANN201
    g = _lr(spark, sf_dir)
    return lrgraph.remove_pairs(g, g.where("r = ''").select("l", "r", F.lit(3).cast("long").alias("count")))


@query(f"WITH {LR} SELECT l || r AS eojeol, max(count) AS count FROM lr GROUP BY l || r")
def d11_to_eojeol_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.to_counts(_lr(spark, sf_dir))


@query(f"WITH {TC}, lr AS MATERIALIZED (SELECT left(tok, i) AS l, substr(tok, i + 1) AS r, n AS count FROM (SELECT *, unnest(range(greatest(1, length(tok) - 6), least(10, length(tok)) + 1)) AS i FROM tc WHERE length(tok) <= 16)), lk AS MATERIALIZED (SELECT l FROM lr GROUP BY l HAVING sum(count) >= 10), rk AS MATERIALIZED (SELECT r FROM lr WHERE r <> '' GROUP BY r HAVING sum(count) >= 10 UNION ALL SELECT '') SELECT l, r, count FROM lr SEMI JOIN lk USING (l) SEMI JOIN rk USING (r)")
def d12_filtered_graph(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.filtered_graph(lrgraph.eojeol_counts(_sents(spark, sf_dir), max_length=16))


def _hits_sql(rounds: int = 10) -> str:
    parts = [LR, "lk AS MATERIALIZED (SELECT l FROM lr WHERE length(r) <= 6 GROUP BY l HAVING sum(count) >= 10)", "rk AS MATERIALIZED (SELECT r FROM lr WHERE r <> '' AND length(r) <= 6 GROUP BY r HAVING sum(count) >= 10)"]
    parts += ["g AS MATERIALIZED (SELECT l, r, count / CAST(sum(count) OVER (PARTITION BY l) AS DOUBLE) AS to_r, count / CAST(sum(count) OVER (PARTITION BY r) AS DOUBLE) AS to_l FROM lr SEMI JOIN lk USING (l) SEMI JOIN rk USING (r) WHERE length(r) <= 6)", "l0 AS MATERIALIZED (SELECT DISTINCT l, CAST(1 AS DOUBLE) AS rank FROM g)"]
    for k in range(rounds + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT r, sum(to_r * rank) * 0.9 + 0.1 AS rank FROM g JOIN l{k} USING (l) GROUP BY r)")
        if k < rounds:
            parts.append(f"l{k + 1} AS MATERIALIZED (SELECT l, sum(to_l * rank) * 0.9 + 0.1 AS rank FROM g JOIN r{k} USING (r) GROUP BY l)")
    return f"WITH {', '.join(parts)} SELECT 'L' AS side, l AS word, round(rank, 6) + 0.0 AS rank FROM l{rounds} UNION ALL SELECT 'R', r, round(rank, 6) + 0.0 FROM r{rounds}"


@query(_hits_sql())
def d13_hits(spark, sf_dir):  # noqa: ANN001, ANN201
    """Ten rounds, whether or not ranks still move."""
    return lrgraph.hits(lrgraph.filtered_graph(_eo(spark, sf_dir)), tolerance=0.0).select("side", "word", _r("rank"))


@query(f"WITH {LR} SELECT l, r, count, CAST(sum(count) OVER (PARTITION BY l) AS BIGINT) AS l_count, round(count / CAST(sum(count) OVER (PARTITION BY l) AS DOUBLE), 6) + 0.0 AS p FROM lr")
def d14_conditional(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.conditional(_lr(spark, sf_dir)).select("l", "r", "count", "l_count", _r("p"))


@query(f"WITH {LR}, lk AS MATERIALIZED (SELECT l, CAST(sum(count) AS BIGINT) AS n FROM lr GROUP BY l) SELECT a.l, a.n AS l_count, round(CASE WHEN length(a.l) > 1 AND h.n IS NOT NULL THEN pow(a.n / CAST(h.n AS DOUBLE), 1.0 / (length(a.l) - 1)) ELSE 0 END, 6) + 0.0 AS cohesion_l, round(CASE WHEN length(a.l) > 1 AND s.n IS NOT NULL THEN a.n / CAST(s.n AS DOUBLE) ELSE 0 END, 6) + 0.0 AS droprate_l FROM lk a LEFT JOIN lk h ON h.l = left(a.l, 1) LEFT JOIN lk s ON s.l = left(a.l, length(a.l) - 1)")
def d14_l_statistics(spark, sf_dir):  # noqa: ANN001, ANN201
    return lrgraph.l_statistics(_lr(spark, sf_dir)).select("l", "l_count", _r("cohesion_l"), _r("droprate_l"))


BI = TOKS + ", bi AS (SELECT w0, w1, count(*) AS frequency FROM (SELECT t[i] AS w0, t[i + 1] AS w1 FROM (SELECT t, unnest(range(1, len(t))) AS i FROM toks)) GROUP BY ALL HAVING count(*) >= 5), uni AS (SELECT w, count(*) AS u FROM (SELECT w0 AS w FROM bi UNION ALL SELECT w1 FROM bi) GROUP BY w)"


@query(f"WITH {BI} SELECT w0, w1, frequency FROM bi")
def e01_bigrams(spark, sf_dir):  # noqa: ANN001, ANN201
    return phrase.bigrams(_sents(spark, sf_dir))


@query(f"WITH {BI} SELECT w0, w1, frequency, CAST(frequency AS DOUBLE) AS score FROM bi WHERE frequency >= 10")
def e02_bigrams_by_frequency(spark, sf_dir):  # noqa: ANN001, ANN201
    return phrase.extract(phrase.bigrams(_sents(spark, sf_dir)), "frequency", 10)


@query(f"WITH {BI} SELECT w0, w1, frequency, round(s, 6) + 0.0 AS score FROM (SELECT w0, w1, frequency, ln((SELECT 2 * sum(frequency) FROM bi) * frequency / CAST(a.u * b.u AS DOUBLE)) AS s FROM bi JOIN uni a ON a.w = w0 JOIN uni b ON b.w = w1) WHERE s >= 0")
def e03_bigrams_by_pmi(spark, sf_dir):  # noqa: ANN001, ANN201
    return phrase.extract(phrase.bigrams(_sents(spark, sf_dir)), "pmi").withColumn("score", _r("score"))


@query(f"WITH {BI} SELECT w0, w1, frequency, round((frequency - 5) / CAST(a.u * b.u AS DOUBLE), 6) + 0.0 AS score FROM bi JOIN uni a ON a.w = w0 JOIN uni b ON b.w = w1")
def e04_bigrams_by_mikolov(spark, sf_dir):  # noqa: ANN001, ANN201
    return phrase.extract(phrase.bigrams(_sents(spark, sf_dir)), "mikolov").withColumn("score", _r("score"))


@query(f"WITH {BI} SELECT w0, w1, frequency, round(s, 6) + 0.0 AS score FROM (SELECT w0, w1, frequency, ln((SELECT 2 * sum(frequency) FROM bi) * frequency / CAST(a.u * b.u AS DOUBLE)) AS s FROM bi JOIN uni a ON a.w = w0 JOIN uni b ON b.w = w1) ORDER BY s DESC, w0, w1 LIMIT 50")
def e07_bigrams_topk(spark, sf_dir):  # noqa: ANN001, ANN201
    return phrase.extract(phrase.bigrams(_sents(spark, sf_dir)), "pmi", topk=50).withColumn("score", _r("score"))


VOC = r"""tk AS (SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents)),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tk GROUP BY term), voc AS (SELECT row_number() OVER (ORDER BY df DESC, term) - 1 AS idx, term, df FROM df WHERE df BETWEEN 3 AND 10000000 AND df >= floor((SELECT count(*) FROM documents) * 0.002) AND df <= floor((SELECT count(*) FROM documents) * 0.5))"""


def _terms(spark, sf_dir):  # noqa: ANN001, ANN202
    return vectorizer.analyse(_docs(spark, sf_dir))


def _voc(spark, sf_dir):  # noqa: ANN001, ANN202
    n = _docs(spark, sf_dir).agg(F.count("*").alias("n"))
    return vectorizer.fit(_terms(spark, sf_dir), n, min_tf=3, max_tf=10_000_000, min_df=0.002, max_df=0.5)


@query(f"WITH {VOC} SELECT idx, term, df FROM voc")
def f01_vocabulary(spark, sf_dir):  # noqa: ANN001, ANN201
    return _voc(spark, sf_dir)


@query(f"WITH {VOC} SELECT doc_id, idx, count(*) AS n FROM tk JOIN voc USING (term) GROUP BY ALL")
def f02_transform(spark, sf_dir):  # noqa: ANN001, ANN201
    return vectorizer.transform(_terms(spark, sf_dir), _voc(spark, sf_dir))


@query(f"WITH {VOC} SELECT doc_id, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) AS ids FROM tk JOIN voc USING (term) GROUP BY doc_id")
def f03_encode_list(spark, sf_dir):  # noqa: ANN001, ANN201
    return vectorizer.encode_list(_terms(spark, sf_dir), _voc(spark, sf_dir)).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"WITH {VOC} SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS terms FROM tk JOIN voc USING (term) GROUP BY doc_id")
def f03_decode_list(spark, sf_dir):  # noqa: ANN001, ANN201
    v = _voc(spark, sf_dir)
    d = vectorizer.decode_list(vectorizer.encode_list(_terms(spark, sf_dir), v), v)
    return d.select("doc_id", F.array_join("terms", " ").alias("terms"))


@query(f"WITH {VOC} SELECT doc_id, term, count(*) AS n FROM tk JOIN voc USING (term) GROUP BY ALL")
def f04_bow(spark, sf_dir):  # noqa: ANN001, ANN201
    v = _voc(spark, sf_dir)
    return vectorizer.decode_bow(vectorizer.encode_bow(_terms(spark, sf_dir), v), v)


@query(f"WITH {VOC} SELECT count(*) AS n_vocabs, min(term) AS first_term, max(idx) AS last_idx FROM voc")
def f05_vocabulary_size(spark, sf_dir):  # noqa: ANN001, ANN201
    return _voc(spark, sf_dir).agg(F.count("*").alias("n_vocabs"), F.min("term").alias("first_term"), F.max("idx").alias("last_idx"))


@query(r"""WITH tk AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM documents), stop AS (SELECT term FROM tk GROUP BY term HAVING count(*) >= 2000)
SELECT term, count(DISTINCT doc_id) AS df FROM tk WHERE term NOT IN (SELECT term FROM stop) GROUP BY term""")
def f06_lowercase_stopwords(spark, sf_dir):  # noqa: ANN001, ANN201
    low = vectorizer.analyse(_docs(spark, sf_dir), lowercase=True)
    stop = low.groupBy("term").count().where("count >= 2000").select("term")
    t = vectorizer.analyse(_docs(spark, sf_dir), lowercase=True, stopwords=stop)
    return t.select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {VOC}, m AS (SELECT doc_id, idx, count(*) AS n FROM tk JOIN voc USING (term) GROUP BY ALL) SELECT dense_rank() OVER (ORDER BY doc_id) || ' ' || (idx + 1) || ' ' || n AS value FROM m")
def a08_matrix_market(spark, sf_dir):  # noqa: ANN001, ANN201
    body = vectorizer.matrix_market(vectorizer.transform(_terms(spark, sf_dir), _voc(spark, sf_dir)))[1]
    return body.select(F.concat_ws(" ", "i", "j", "n").alias("value"))


CV = TOKS + ", v AS (SELECT row_number() OVER (ORDER BY tf DESC, term) - 1 AS idx, term, tf FROM (SELECT term, count(*) AS tf FROM (SELECT unnest(t) AS term FROM toks) GROUP BY term HAVING count(*) >= 20))"


def _co(dynamic: bool) -> str:
    w = "(3 - k + 1) / 3.0" if dynamic else "1.0"
    return CV + f""", one AS (SELECT t[i] AS a, t[i + k] AS b, {w} AS w FROM (SELECT t, i, unnest(range(1, 4)) AS k FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM toks)) WHERE i + k <= len(t)),
k1 AS (SELECT a, b, sum(w) AS w FROM one WHERE a IN (SELECT term FROM v) AND b IN (SELECT term FROM v) GROUP BY ALL),
co AS (SELECT word, context, sum(w) AS weight FROM (SELECT a AS word, b AS context, w FROM k1 UNION ALL SELECT b, a, w FROM k1) GROUP BY ALL)"""


def _matrix(spark, sf_dir, dynamic=False):  # noqa: ANN001, ANN202
    s = _sents(spark, sf_dir)
    return context.cooccurrence(s, context.vocabulary(s, 20), 3, dynamic)


@query(f"WITH {CV} SELECT idx, term, tf FROM v")
def g01_vocabulary(spark, sf_dir):  # noqa: ANN001, ANN201
    return context.vocabulary(_sents(spark, sf_dir), 20)


@query(f"WITH {_co(False)} SELECT word, context, CAST(round(weight, 6) AS DOUBLE) AS weight FROM co")
def g02_cooccurrence(spark, sf_dir):  # noqa: ANN001, ANN201
    return _matrix(spark, sf_dir).select("word", "context", _r("weight"))


@query(f"WITH {_co(True)} SELECT word, context, round(weight, 4) + 0.0 AS weight FROM co")
def g02_dynamic_weight(spark, sf_dir):  # noqa: ANN001, ANN201
    return _matrix(spark, sf_dir, True).select("word", "context", _r("weight", 4))


@query(f"WITH {_co(False)} SELECT a.idx AS i, b.idx AS j, CAST(round(weight, 6) AS DOUBLE) AS weight FROM co JOIN v a ON a.term = word JOIN v b ON b.term = context")
def g03_coordinates(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _sents(spark, sf_dir)
    v = context.vocabulary(s, 20)
    return context.cooccurrence_ids(s, v, 3).select(F.col("word").alias("i"), F.col("context").alias("j"), _r("weight"))


def _pmi_sql(compare: str, alpha: str, power: str) -> str:
    return f"""WITH {_co(False)}, tot AS (SELECT sum(weight) AS s FROM co), px AS (SELECT word, sum(weight) AS x FROM co GROUP BY word), p0 AS (SELECT context, pow(sum(weight) / (SELECT s FROM tot), {power}) AS p FROM co GROUP BY context), py AS (SELECT context, p / CASE WHEN {power} < 1 THEN (SELECT sum(p) FROM p0) ELSE 1 END AS p FROM p0)
SELECT word, context, round(ln(e), 4) + 0.0 AS pmi FROM (SELECT word, context, weight / (x * (p + {alpha})) AS e FROM co JOIN px USING (word) JOIN py USING (context)) WHERE e {compare}"""


def _pmi(spark, sf_dir, **options):  # noqa: ANN001, ANN003, ANN202
    s = _sents(spark, sf_dir)
    v = context.vocabulary(s, 20)
    found = context.pmi(context.cooccurrence_ids(s, v, 3), again=True, **options)
    return context.named(found, v, "pmi").select("word", "context", _r("pmi", 4))


@query(_pmi_sql(">= 1", "0.0001", "0.75"))
def g04_pmi(spark, sf_dir):  # noqa: ANN001, ANN201
    return _pmi(spark, sf_dir, alpha=0.0001, beta=0.75)


@query(_pmi_sql("> exp(1.0)", "0.0", "1.0"))
def g05_pmi_strict(spark, sf_dir):  # noqa: ANN001, ANN201
    return _pmi(spark, sf_dir, min_pmi=1.0, strict=True)


@query(f"WITH {_co(False)}, tot AS (SELECT sum(weight) AS s FROM co), px AS (SELECT word, sum(weight) AS x FROM co GROUP BY word), py AS (SELECT term AS context, tf / CAST((SELECT sum(tf) FROM v) AS DOUBLE) AS p FROM v) SELECT word, context, round(ln(e), 4) + 0.0 AS pmi FROM (SELECT word, context, weight / (x * p) AS e FROM co JOIN px USING (word) JOIN py USING (context)) WHERE e >= 1")
def g06_pmi_given_contexts(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _sents(spark, sf_dir)
    v = context.vocabulary(s, 20)
    total = v.agg(F.sum("tf").alias("s"))
    py = v.crossJoin(F.broadcast(total)).select(F.col("idx").cast("long").alias("context"), (F.col("tf") / F.col("s")).alias("p"))
    return context.named(context.pmi(context.cooccurrence_ids(s, v, 3), py=py, again=True), v, "pmi").select("word", "context", _r("pmi", 4))


@query()
def g07_svd(spark, sf_dir):  # noqa: ANN001, ANN201
    s = _sents(spark, sf_dir)
    v = context.vocabulary(s, 200)
    found = context.pmi(context.cooccurrence_ids(s, v, 3), again=True)
    values, _ = context.svd(found.select(F.col("word").alias("i"), F.col("context").alias("j"), F.col("pmi").alias("weight")), 4)
    return spark.createDataFrame([(k, round(x, 3)) for k, x in enumerate(values)], "k int, value double")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.e, b.e), 12) AS s FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query, vec_id, round(s, 4) + 0.0 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS k FROM p) WHERE k <= 10""")
def g08_most_similar(spark, sf_dir):  # noqa: ANN001, ANN201
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return context.all_similar(e, "vec_id", "embedding", queries=F.col("vec_id") % 20 == 0).select("query", "vec_id", _r("similarity", 4))
