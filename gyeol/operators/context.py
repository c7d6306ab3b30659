"""Word-context matrices, pointwise mutual information, SVD and similar items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import split_words
from ..session import cut, drop
from ..sources.corpus import token_counts
from .vectorizer import _dense_index

#: Vectors of a block; every block meets every other.
BLOCK = 4096
#: Terms of a vocabulary that is sent to all tasks.
MAX_TERMS = 4_000_000
#: Pairs that a task holds before it adds them up; pairs of a part, before they are added up; rows of a batch.
PAIRS, PART_PAIRS, ROWS = 6_000_000, 8_000_000, 100_000


def vocabulary(sents: DataFrame, min_tf: int = 10) -> DataFrame:
    """idx, term, tf."""
    t = token_counts(sents).select(F.col("tok").alias("term"), F.col("n").alias("tf"))
    return _dense_index(t.where(F.col("tf") >= min_tf), "tf")


def _hinted(df: DataFrame) -> DataFrame:
    """A table of terms, sent to all tasks unless it is too large; its joins are shuffled then."""
    return F.broadcast(df) if df.count() <= MAX_TERMS else df


def _coded(sents: DataFrame, vocab: DataFrame, tokens: Column | None = None) -> DataFrame:
    """row, pos, idx of the known tokens, by row and pos within a partition."""
    t = sents.select(F.monotonically_increasing_id().alias("row"), (split_words("sent") if tokens is None else tokens).alias("toks"))
    t = t.select("row", F.posexplode_outer("toks").alias("pos", "term"))
    known = vocab.select("term", F.col("idx").cast("long").alias("idx"))
    if known.count() <= MAX_TERMS:
        return t.join(F.broadcast(known), "term").select("row", "pos", "idx")  # the order of the left side stays
    return cut(t).join(known, "term").select("row", "pos", "idx").repartition("row").sortWithinPartitions("row", "pos")


def _summed(code: np.ndarray, weights: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of ``key * weights + weight - 1``, in order, with the sum of their weights."""
    code.sort()
    key = code // weights if weights > 1 else code
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    if weights == 1:
        return key[first], np.diff(np.append(first, len(key)))
    return key[first], np.add.reduceat(code - key * weights + 1, first) if len(key) else first


def cooccurrence_ids(sents: DataFrame, vocab: DataFrame, windows: int = 3, dynamic_weight: bool = False, tokens: Column | None = None) -> DataFrame:
    """word, context (both idx of the vocabulary), weight within ``windows`` tokens on both sides.

    Tokens are numbers before pairs are made, so a pair is one number, the lower index in front.  Each task adds up its pairs
    in batches of PAIRS; they are shuffled once, into as many parts as their number needs, and mirrored last.  What is
    shuffled is written once: the result can be read again and again.
    """
    size, known = vocab.agg(F.coalesce(F.max("idx"), F.lit(0)) + 1, F.coalesce(F.sum("tf"), F.lit(0))).first()
    weights = windows if dynamic_weight else 1
    if size * size * weights >= 1 << 63:
        raise ValueError("too large a vocabulary")

    def count(batches):  # noqa: ANN001, ANN202
        held, n, last = [], 0, [np.zeros(0, np.int64)] * 3
        for b in batches:
            start = len(last[0])
            row, pos, idx = (np.concatenate([x, y.to_numpy()]) for x, y in zip(last, b.columns))
            if np.any((row[1:] == row[:-1]) & (pos[1:] <= pos[:-1])):
                raise ValueError("tokens out of order")
            for m in range(1, windows + 1):
                at = max(start - m, 0)  # the second of a pair is new
                x, y = slice(at, max(len(row) - m, at)), slice(at + m, None)
                d = pos[y] - pos[x]
                ok = np.flatnonzero((row[y] == row[x]) & (d <= windows))
                one, two = idx[x][ok], idx[y][ok]
                code = np.minimum(one, two) * size + np.maximum(one, two)
                held.append(code * weights + (windows - d[ok]) if weights > 1 else code)
                n += len(ok)
            last = [x[-windows:].copy() for x in (row, pos, idx)]
            if n >= PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(np.concatenate(held), weights)], ["k", "n"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(np.concatenate(held), weights)], ["k", "n"])

    def add(batches):  # noqa: ANN001, ANN202
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        k, n = (np.concatenate(x) for x in zip(*got))
        del got
        o = np.argsort(k, kind="stable")
        k, n = k[o], n[o]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, n = k[first], np.add.reduceat(n, first)
        for i in range(0, len(k), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + ROWS]), pa.array(n[i : i + ROWS])], ["k", "n"])

    def mirror(batches):  # noqa: ANN001, ANN202
        for b in batches:
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy() / weights
            i, j = k // size, k % size
            same = i == j
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.where(same, 2 * n, n))], ["word", "context", "weight"])
            yield pa.RecordBatch.from_arrays([pa.array(j[~same]), pa.array(i[~same]), pa.array(n[~same])], ["word", "context", "weight"])

    parts = max(sents.sparkSession.sparkContext.defaultParallelism, -(-known * windows // PART_PAIRS))
    own = _coded(sents, vocab, tokens).mapInArrow(count, "k long, n long").repartition(parts, "k").mapInArrow(add, "k long, n long")
    return cut(own).mapInArrow(mirror, "word long, context long, weight double")


def named(matrix: DataFrame, vocab: DataFrame, value: str = "weight") -> DataFrame:
    """word and context as terms instead of numbers."""
    term = lambda c: _hinted(vocab.select(F.col("idx").cast("long").alias(c), F.col("term").alias(f"{c}_term")))
    both = matrix.join(term("word"), "word").join(term("context"), "context")
    return both.select(F.col("word_term").alias("word"), F.col("context_term").alias("context"), value)


def cooccurrence(sents: DataFrame, vocab: DataFrame, windows: int = 3, dynamic_weight: bool = False, tokens: Column | None = None) -> DataFrame:
    """word, context, weight within ``windows`` tokens on both sides; unknown tokens keep their distance."""
    return named(cooccurrence_ids(sents, vocab, windows, dynamic_weight, tokens), vocab)


def indexed(matrix: DataFrame, vocab: DataFrame) -> DataFrame:
    """i, j, weight: coordinates by vocabulary index."""
    term = lambda c, i: _hinted(vocab.select(F.col("term").alias(c), F.col("idx").alias(i)))
    return matrix.join(term("word", "i"), "word").join(term("context", "j"), "context").select("i", "j", "weight")


def pmi(matrix: DataFrame, min_pmi: float = 0.0, alpha: float = 0.0, beta: float = 1.0, py: DataFrame | None = None, strict: bool = False, again: bool = False) -> DataFrame:
    """word, context, pmi = ln p(x,y) / (p(x) (p(y) + alpha)), where it reaches min_pmi (exceeds it if strict).

    beta < 1 flattens the context distribution; py (context, p) replaces it.  again: the matrix costs little to read again.
    """
    if not 0 < beta <= 1:
        raise ValueError("beta must be in (0, 1]")
    matrix = matrix if again else cut(matrix)  # read three times
    px = cut(matrix.groupBy("word").agg(F.sum("weight").alias("x")))
    if py is None:
        total = px.agg(F.sum("x").alias("total"))
        py = matrix.groupBy("context").agg(F.sum("weight").alias("y")).crossJoin(F.broadcast(total)).select("context", (F.col("y") / F.col("total")).alias("p"))
    if beta < 1:
        py = cut(py.select("context", F.pow("p", F.lit(beta)).alias("p")))
        norm = py.agg(F.sum("p").alias("norm"))
        py = py.crossJoin(F.broadcast(norm)).select("context", (F.col("p") / F.col("norm")).alias("p"))
    both = matrix.join(_hinted(px), "word").join(_hinted(cut(py)), "context")
    ratio = F.when((F.col("x") == 0) | (F.col("p") + alpha == 0), 0.0).otherwise(F.col("weight") / (F.col("x") * (F.col("p") + alpha)))
    out = both.withColumn("e", ratio)
    bound = F.exp(F.lit(float(min_pmi)))
    return out.where((F.col("e") > bound) if strict else (F.col("e") >= bound)).select("word", "context", F.log("e").alias("pmi"))


def svd(coordinates: DataFrame, k: int, more: int = 12, most: int = 60, tolerance: float = 1e-9) -> tuple[list[float], DataFrame]:
    """Singular values and (i, vector): the k leading left singular vectors scaled by nothing.

    Subspace iteration with k + more vectors.  The entries are written twice, by row and by column; each product sums whole
    rows (or columns) in a task and sends one vector for each to the driver, nothing is shuffled.  The driver and the tasks
    hold the vectors, as long as the matrix has rows and columns.  It stops when the k values don't change any more.
    """
    entries = cut(coordinates.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("weight").cast("double").alias("w")))
    height, width, n = entries.agg(F.max("i"), F.max("j"), F.count("*")).first()
    if width is None or k >= width + 1:
        raise ValueError("k must be smaller than the number of columns")
    height, width = height + 1, width + 1
    context = entries.sparkSession.sparkContext
    parts = max(context.defaultParallelism, -(-n // PART_PAIRS))
    by = {c: cut(entries.select(c, other, "w").repartition(parts, c).sortWithinPartitions(c)) for c, other in (("i", "j"), ("j", "i"))}
    drop(entries)
    q, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(width, min(k + more, width))))

    def product(side: str, q: np.ndarray) -> DataFrame:
        """at, v: the rows (or columns) times q; one that lies in two tasks has two parts."""
        sent = context.broadcast(q)

        def run(batches):  # noqa: ANN001, ANN202
            found: dict[int, np.ndarray] = {}
            for b in batches:
                for s in range(0, b.num_rows, ROWS):
                    at, other, w = (c.to_numpy() for c in b.slice(s, ROWS).columns)
                    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    sums = np.add.reduceat(sent.value[other] * w[:, None], first, axis=0)
                    for x, v in zip(at[first].tolist(), sums):
                        found[x] = found[x] + v if x in found else v
            if found:
                off = pa.array(np.arange(0, len(found) * q.shape[1] + 1, q.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(off, pa.array(np.concatenate(list(found.values()))))], ["at", "v"])

        return by[side].mapInArrow(run, "at long, v array<double>")

    def dense(side: str, q: np.ndarray, size: int) -> np.ndarray:
        got, out = product(side, q).toArrow(), np.zeros((size, q.shape[1]))
        if got.num_rows:
            np.add.at(out, got["at"].to_numpy(), got["v"].combine_chunks().flatten().to_numpy().reshape(-1, q.shape[1]))
        return out

    seen = None
    for _ in range(most):
        y = dense("j", dense("i", q, height), width)
        value, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        sigma = np.sqrt(np.maximum(value, 0.0))
        if seen is not None and np.all(np.abs(sigma[:k] - seen) <= tolerance * max(sigma[0], 1e-300)):
            break
        seen = sigma[:k]
        right = (q @ turn)[:, :k]
        q, _ = np.linalg.qr(y)
    right = np.divide(right, sigma[:k], out=np.zeros_like(right), where=sigma[:k] > 0)
    parts_of = product("i", right).select("at", *[F.col("v")[c].alias(f"v{c}") for c in range(k)]).groupBy("at").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(k)])
    return [float(x) for x in sigma[:k]], parts_of.select(F.col("at").alias("i"), F.array(*[f"v{c}" for c in range(k)]).alias("vector"))


def most_similar(items: DataFrame, query: object, key: str, vector: str, topk: int = 10) -> DataFrame:
    """key, similarity: the items with the highest cosine to the query's vector; all of them for topk <= 0, none for an unknown query."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = items.where(F.col(key) == F.lit(query)).select(F.col(vector).alias("qv")).limit(1)
    both = items.where(F.col(key) != F.lit(query)).crossJoin(F.broadcast(q))  # one row
    norm = F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(F.col("qv"), F.col("qv")))
    out = both.select(key, F.when(norm == 0, 0.0).otherwise(dot(F.col(vector), F.col("qv")) / norm).alias("similarity"))
    return out.orderBy(F.desc("similarity"), key).limit(topk) if topk > 0 else out


def all_similar(items: DataFrame, key: str, vector: str, topk: int = 10, block: int = BLOCK, queries: Column | None = None) -> DataFrame:
    """query, key, similarity: for every item (or those of the condition ``queries``), the topk others with the highest cosine, ties by key.

    Exact products of all pairs of blocks; keys are taken as unique, rows without key or vector take no part.
    """
    kind = items.schema[key].dataType.simpleString()
    wanted = F.lit(True) if queries is None else queries
    rows = items.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), wanted.alias("wanted")).where("id is not null and v is not null")
    parts = max(1, -(-rows.count() // block))
    part, every = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asks = rows.where("wanted").select("id", "v", part.alias("a"), every.alias("b"), F.lit(True).alias("asks"))
    held = rows.select("id", "v", every.alias("a"), part.alias("b"), F.lit(False).alias("asks"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        names = ["query", "id", "similarity"]
        number = t["id"].combine_chunks().dictionary_encode().indices.to_numpy()
        ask = t["asks"].to_numpy()
        q, c = np.flatnonzero(ask), np.flatnonzero(~ask)
        if not len(q) or not len(c):
            return pa.Table.from_arrays([t["id"].slice(0, 0), t["id"].slice(0, 0), pa.array([], pa.float64())], names)
        v = np.stack(t["v"].combine_chunks().to_numpy(zero_copy_only=False))
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        sim = np.round(v[q] @ v[c].T, 12)
        sim[number[q][:, None] == number[c][None, :]] = -np.inf
        k = min(topk, len(c))
        least = np.partition(sim, len(c) - k, axis=1)[:, len(c) - k]
        i, j = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
        o = np.lexsort((j, -sim[i, j], i))  # columns are in the order of keys
        i, j = i[o], j[o]
        first = np.searchsorted(i, i)
        some = np.arange(len(i)) - first < k
        i, j = i[some], j[some]
        return pa.Table.from_arrays([t["id"].take(pa.array(q[i])), t["id"].take(pa.array(c[j])), pa.array(sim[i, j])], names)

    found = asks.unionAll(held).groupBy("a", "b").applyInArrow(compare, f"query {kind}, id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= topk).select("query", F.col("id").alias(key), "similarity")
