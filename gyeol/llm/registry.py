"""Queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, linededup, lm, media, minhash, mixing, passages, pii
from .common import table


def op1_media_png_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_hashes(media.render(table(spark, sf_dir, "documents")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs)).withColumn("confidence", F.round("confidence", 6))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_across(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.later_copies(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media_png_hash, op2_minhash_near_dedup, op3_source_mixing, op4_language_id, op5_pii_spans, op6_fm_index_substrings, op7_benchmark_decontamination, op8_suffix_array_dedup, op9_lm_scoring, op10_line_dedup)
}

_TRIM = r"'^[\t\n\x0B\f\r\x1C-\x20]+|[\t\n\x0B\f\r\x1C-\x20]+$'"
#: Windows of 50 normalised tokens; key is a 64-bit hash.
_WINDOWS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z\x{{00C0}}-\x{{1FFF}}\x{{2080}}-\x{{2FFF}}\x{{3040}}-\x{{10FFFF}}]+') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS MATERIALIZED (SELECT doc_id, i, hash(array_to_string(t[i + 1 : i + {passages.MIN_TOKENS}], ' ')) AS key FROM (SELECT doc_id, t, unnest(range(0, len(t) - {passages.MIN_TOKENS - 1})) AS i FROM d)),
c AS (SELECT DISTINCT doc_id, i FROM %s),
m AS (SELECT *, CASE WHEN i <= {passages.MIN_TOKENS} + lag(i) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM m)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + {passages.MIN_TOKENS} AS INTEGER) AS "end" FROM g GROUP BY doc_id, part"""
_WORD = r"0-9A-Za-z\x{00C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}"
#: Runs of trigrams that a document and an item have in the same order; those long enough, merged.
_LEAKS = rf"""WITH d AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(text, '[^{_WORD}]*[{_WORD}]+') AS p, regexp_extract_all(text, '[{_WORD}]+') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
dt AS MATERIALIZED (SELECT doc_id, k, lower(x) AS tok, CAST(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS e, length(x) AS n FROM (SELECT doc_id, unnest(t) AS x, unnest(p) AS p, unnest(range(1, len(t) + 1)) AS k FROM d)),
i AS (SELECT min(item_id) AS item_id, t FROM (SELECT item_id, regexp_extract_all(lower(text), '[{_WORD}]+') AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(t) >= {decontam.FLOOR} GROUP BY t),
dg AS (SELECT doc_id, k, concat_ws(' ', tok, lead(tok) OVER w, lead(tok, 2) OVER w) AS g FROM dt WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
ig AS (SELECT item_id, len(t) AS size, j, array_to_string(t[j : j + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(t) - 1)) AS j FROM i)),
hit AS MATERIALIZED (SELECT doc_id, item_id, size, k, k - j AS diagonal FROM dg JOIN ig USING (g)),
isl AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k) AS r FROM hit),
runs AS (SELECT doc_id, item_id, size, min(k) AS a, max(k) + 3 AS b, count(*) + 2 AS n FROM isl GROUP BY doc_id, item_id, size, diagonal, r),
ok AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM runs WHERE n >= {decontam.MIN_TOKENS} OR (n >= {decontam.FLOOR} AND n >= {decontam.COVERAGE} * size)),
p AS (SELECT *, sum(CASE WHEN a < far THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM ok),
s AS (SELECT doc_id, min(a) AS a, max(b) AS b, min(struct_pack(n := -n, a := a, size := size, item := item_id)) AS best FROM p GROUP BY doc_id, part),
c AS (SELECT s.doc_id, x.e - CAST(x.n AS INTEGER) AS start, y.e AS "end", best FROM s JOIN dt x ON x.doc_id = s.doc_id AND x.k = s.a JOIN dt y ON y.doc_id = s.doc_id AND y.k = s.b - 1)
SELECT c.doc_id, start, "end", CAST(-best.n AS INTEGER) AS match_tokens, best.item AS item_id, CASE WHEN -best.n >= {decontam.MIN_TOKENS} THEN 'length' ELSE 'coverage' END AS reason, substr(text, start + 1, "end" - start) AS span FROM c JOIN d USING (doc_id)"""
#: Oracles by query; an operator that SQL can't express has none.
ORACLES: dict[str, str] = {
    "op7_benchmark_decontamination": _LEAKS,
    "op6_fm_index_substrings": _WINDOWS % "w SEMI JOIN (SELECT key FROM w GROUP BY key HAVING min(doc_id) <> max(doc_id)) USING (key)",
    "op8_suffix_array_dedup": _WINDOWS % "w JOIN (SELECT key, min(struct_pack(d := doc_id, i := i)) AS f FROM w GROUP BY key) USING (key) WHERE f < struct_pack(d := doc_id, i := i)",
    "op10_line_dedup": rf"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line
               FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, CAST(line AS INTEGER) AS line, regexp_replace(raw, {_TRIM}, '', 'g') AS t FROM split),
o AS (SELECT * FROM l WHERE length(t) >= 1),
firsts AS (SELECT t, length(t) AS n, min(struct_pack(d := doc_id, l := line)) AS f FROM o GROUP BY t),
near AS (SELECT a.t, min(b.f) AS f FROM firsts a JOIN firsts b ON b.n IN (a.n - 1, a.n, a.n + 1) AND a.t <> b.t AND abs(a.n - b.n) <= 1
         AND (left(a.t, least(a.n, b.n) // 2) = left(b.t, least(a.n, b.n) // 2) OR right(a.t, least(a.n, b.n) - least(a.n, b.n) // 2) = right(b.t, least(a.n, b.n) - least(a.n, b.n) // 2))
         /* one edit of a character; levenshtein() counts bytes */ WHERE least(a.n, b.n) >= {linededup.NEAR_CHARS} AND len(list_filter(range(0, greatest(a.n, b.n)), lambda i: left(a.t, i) = left(b.t, i) AND substr(a.t, i + 1 + CAST(a.n >= b.n AS INTEGER)) = substr(b.t, i + 1 + CAST(b.n >= a.n AS INTEGER)))) > 0 GROUP BY a.t),
k AS (SELECT firsts.t, firsts.f AS exact, CASE WHEN near.f IS NULL THEN firsts.f ELSE least(firsts.f, near.f) END AS keep FROM firsts LEFT JOIN near USING (t))
SELECT DISTINCT o.doc_id, o.line, keep.d AS kept_doc, keep.l AS kept_line, CAST(keep <> exact AS INTEGER) AS distance
FROM o JOIN k USING (t) WHERE keep < struct_pack(d := o.doc_id, l := o.line)""",
}
