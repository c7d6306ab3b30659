"""Near-duplicate documents by b-bit MinHash (operator 2).

A document is the set of its word trigrams (lower-cased runs of letters and
digits; a shorter document is one shingle).  Of ``HASHES`` minima only the low
``BITS`` bits are kept, packed into a signature.  Bands of ``ROWS`` whole minima
give candidates; the similarity of a pair is estimated from the share m of equal
b-bit values, corrected for chance collisions: (m - 2^-b) / (1 - 2^-b).

Documents with equal signatures and band keys are one node.  Within a bucket, each node is
compared with the lowest one, by a join; nodes that fail are compared with every other
node of the bucket, in cells of bounded size, while those that pass are linked already.
So the components are those of all candidate pairs above the threshold, but a bucket
of n copies costs n comparisons, and no task holds a bucket.  Components come from alternating minimum-label rounds, each cut by a
checkpoint; a group keeps the document with its lowest doc_id (then text hash).

Defined cases: rows without doc_id or text take no part and stay.  Texts without a
word (empty ones, too) are duplicates only if they are equal.  Rows that repeat a
doc_id with the same text: one stays.  A row is known by doc_id and text, so of one
doc_id with several texts only those go that repeat another document or each other.
Columns are taken by name, whatever others are called; texts of any length are read
whole.  Without documents there are no duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, keyed, written
from .textcore import Hasher, chunks, fold, mix, ngrams, words

SHINGLE, HASHES, BITS, ROWS, THRESHOLD = 3, 126, 4, 3, 0.4
BANDS = HASHES // ROWS
#: Nodes on either side of a cell of a bucket.
BLOCK = 20_000
_rng = np.random.default_rng(20240817)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minima(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, HASHES) minima of each row's shingles under linear permutations."""
    low = fold(data)
    s, e, row = words(low, off)
    h = Hasher(low)(s, e)
    g, at = ngrams(h, row, SHINGLE)
    owner = row[at]
    have = np.zeros(len(off) - 1, bool)
    have[owner] = True
    lone = np.flatnonzero(~have)  # fewer words than a shingle: one shingle of what there is
    if len(lone):
        lo, hi = _outer(s, e, row, lone)
        bare = hi == lo  # no word: the whole text
        lo[bare], hi[bare] = off[:-1][lone][bare], off[1:][lone][bare]
        g = np.concatenate([g, Hasher(low)(lo, hi)])
        owner = np.concatenate([owner, lone])
        order = np.argsort(owner, kind="stable")
        g, owner = g[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    out = np.empty((HASHES, len(off) - 1), np.uint64)
    with np.errstate(over="ignore"):
        x = np.empty_like(g)
        for k in range(HASHES):
            np.multiply(g, _MUL[k], out=x)
            np.add(x, _ADD[k], out=x)
            out[k] = np.minimum.reduceat(x, start)
    return out.T


def _outer(s: np.ndarray, e: np.ndarray, row: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.searchsorted(row, rows), np.searchsorted(row, rows, "right")
    some = b > a
    lo, hi = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    lo[some], hi[some] = s[a[some]], e[b[some] - 1]
    return lo, hi


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each (mixed) minimum, two to a byte."""
    low = (mix(m) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed signatures, by counting bits of their difference."""
    d = x ^ y
    d = (d | (d >> 1)) & 0x55
    d = (d | (d >> 2)) & 0x11
    m = 1 - np.bitwise_count(d).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return np.maximum(0.0, (m - chance) / (1 - chance))


def band_keys(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = np.zeros((len(m), BANDS), np.uint64)
        for i in range(ROWS):
            k = mix(k + m[:, i::ROWS][:, :BANDS])
        return mix(k + np.arange(1, BANDS + 1, dtype=np.uint64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), sig (packed bits), keys (one for each band) and node (128 bits, equal where sig and keys are)."""
    docs = keyed(docs, "text").withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c, data, off in chunks(b.column(1)):
                m = minima(data, off)
                bits, bands = packed(m), band_keys(m).view(np.int64)
                node = [hashlib.blake2b(x.tobytes() + y.tobytes(), digest_size=16).digest() for x, y in zip(bits, bands)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                sig = pa.array([r.tobytes() for r in bits], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, c - a), b.column(2).slice(a, c - a), sig, lists, pa.array(node, pa.binary())], ["doc_id", "h", "sig", "keys", "node"])
        give_back()

    return docs.mapInArrow(run, f"doc_id {kind}, h long, sig binary, keys array<bigint>, node binary")


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def close_pairs(rest: np.ndarray, members: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of rest, row of members) of all pairs of signatures above the threshold."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, 4_000_000 // max(1, members.size))
    for u in range(0, len(rest) if len(members) else 0, step):
        i, j = np.nonzero(similarity(rest[u : u + step, None], members[None]) >= threshold)
        left.append(i + u)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def edges(nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Verified links (a < b) between nodes (id, sig, keys) that join what all pairs of a bucket above the threshold would.

    The lowest node of each bucket is compared with the others by a join.  Those that fail are compared with all of
    the bucket, in cells of about ``block`` failing nodes and ``block`` members, so that no task holds a bucket.
    """
    keys = nodes.select("id", F.explode("keys").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    linked = written(keys.join(hubs, "key").where("id <> hub"))
    sig = nodes.select("id", "sig")

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(similarity(_rows_of(x), _rows_of(y)) >= threshold if len(x) else np.zeros(0, bool))

    pairs = linked.select("id", "hub").distinct().join(sig, "id").join(sig.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    seen = written(pairs.select("id", "hub", alike("sig", "hub_sig").alias("ok")))
    failed = linked.join(seen.where("not ok").select("id", "hub"), ["id", "hub"]).select("key", "id", "hub", "n")
    per = failed.groupBy("key").agg(F.count("*").alias("r"))
    failed = written(failed.join(per, "key"))
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    place = lambda c: F.pmod(F.xxhash64("id"), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    of = failed.groupBy("key").agg(F.first("r").alias("r"), F.first("n").alias("n"), F.first("hub").alias("hub"))
    member = linked.select("key", "id").join(of, "key").select("key", "id", "r", "n")  # the hub has been compared with all
    asks = failed.select("key", "id", place("r").alias("rb"), every("n").alias("mb"), F.lit(True).alias("asks"))
    held = member.select("key", "id", every("r").alias("rb"), place("n").alias("mb"), F.lit(False).alias("asks"))
    cells = asks.unionByName(held).join(sig, "id").repartition("key", "rb", "mb").sortWithinPartitions("key", "rb", "mb").select("id", "key", "rb", "mb", "asks", "sig")
    kind = nodes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                ask = t["asks"].combine_chunks().to_numpy(zero_copy_only=False)
                q, m = np.flatnonzero(ask), np.flatnonzero(~ask)
                bits = _rows_of(t["sig"].combine_chunks())
                i, j = close_pairs(bits[q], bits[m], threshold)
                ids = t["id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[i])), ids.take(pa.array(m[j]))], ["a", "b"])
                held.clear()

        for b in batches:
            where = np.stack([b.column(k).to_numpy() for k in (1, 2, 3)])
            cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
            for u, v in zip([0, *cuts], [*cuts, b.num_rows]):
                if v > u:
                    if tuple(where[:, u]) != cell:
                        yield from close()
                        cell = tuple(where[:, u])
                    held.append(b.slice(u, v - u))
        yield from close()

    more = cells.mapInArrow(run, f"a {kind}, b {kind}").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return seen.where("ok").select(F.col("hub").alias("a"), F.col("id").alias("b")).union(more).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the lowest id of each node's component, for nodes that have a link.

    Alternates large-star and small-star rounds until no edge changes; the number of
    rounds grows with the logarithm of the component's size.
    """
    e = cut(links)
    seen = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b")
        small = large.distinct()
        down = small.groupBy("b").agg(F.min("a").alias("m"))
        star = small.join(down, "b")
        e = cut(star.select(F.col("m").alias("a"), "b").union(star.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
        seen = now


def _decided(sig: DataFrame, threshold: float) -> DataFrame:
    """doc_id, h, sig of every document that repeats another, with keep_id, keep_h and keep_sig of the one that stays."""
    nodes = sig.groupBy("node").agg(F.min(F.struct("doc_id", "h", "sig")).alias("low"), F.first("keys").alias("keys"))  # keys are equal within a node
    root = components(edges(nodes.select(F.col("node").alias("id"), "low.sig", "keys"), threshold)).select(F.col("id").alias("node"), "root")
    of = nodes.select("node", "low").join(root, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    keep = of.groupBy("root").agg(F.min("low").alias("keep"))
    kept = of.select("node", "root").join(keep, "root").select("node", F.col("keep.doc_id").alias("keep_id"), F.col("keep.h").alias("keep_h"), F.col("keep.sig").alias("keep_sig"))
    return sig.select("doc_id", "h", "sig", "node").distinct().join(kept, "node").where("doc_id <> keep_id or h <> keep_h").drop("node")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document that repeats another: doc_id, keep_id (its group's lowest doc_id) and their estimated similarity."""

    @F.arrow_udf("double")
    def estimate(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(similarity(_rows_of(x), _rows_of(y)) if len(x) else np.zeros(0))

    return _decided(cut(signatures(docs)), threshold).select("doc_id", "keep_id", F.round(estimate("sig", "keep_sig"), 6).alias("similarity"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: one of each group stays, and one of rows equal in doc_id and text."""
    sig = cut(signatures(docs))
    gone = _decided(sig, threshold).select(F.col("doc_id").alias("mark_doc"), F.col("h").alias("mark_h"), F.lit(True).alias("gone"))
    twice = sig.groupBy(F.col("doc_id").alias("mark_doc"), F.col("h").alias("mark_h")).count().where("count > 1").select("mark_doc", "mark_h", F.lit(False).alias("gone"))
    marks = gone.union(twice).groupBy("mark_doc", "mark_h").agg(F.max("gone").alias("gone"))
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of, text = inner[f"c{names.index('doc_id')}"], inner[f"c{names.index('text')}"]
    left = inner.join(marks, (of == F.col("mark_doc")) & (F.xxhash64(text) == F.col("mark_h")) & text.isNotNull(), "left").where("gone is null or not gone")
    lone = left.where("gone is null").drop("mark_doc", "mark_h", "gone")
    several = left.where("gone is not null").dropDuplicates(["mark_doc", "mark_h"]).drop("mark_doc", "mark_h", "gone")
    return lone.union(several).toDF(*names)
