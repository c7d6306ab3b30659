"""Mixing sources to target weights (operator 3).

Tokens are runs of non-white-space with the white space around them, so that the
pieces of a document put together give its text again.  Within each source, the
documents follow one another in a pseudorandom order and are packed into blocks of
``BLOCK`` tokens (the last block of a source may be shorter; none is dropped).

An output shard has ``SLOTS`` slots.  Its source counts are one multinomial draw
with the target weights; the k-th slot that a source gets over all shards is
mapped to a block by a keyed pseudorandom permutation (a Feistel network with
cycle walking) of that source's block numbers, with a new permutation for each
pass over the source.  Slots and blocks are joined by (source, block).  There are
as many slots as blocks.

Plan: one pass counts tokens by (source, bucket); one shuffle brings each bucket's
documents together in order, behind a row with the bucket's first position; one shuffle brings the pieces of a block together and
serves the join, too.  Documents are ordered by a hash, and buckets are ranges of it:
as many as keep ``BUCKET_CHARS`` characters in one if all were of one source, so a hot
source is spread, and the number of buckets changes nothing in the result.

The driver holds one row for each source, as does each task that draws.

Defined cases: a null source counts as ''.  Null or empty texts and texts of white
space have no token.  Rows without doc_id, and repeated rows, are mixed like others.
A doc_id may be of any type; ties in the order of documents go by doc_id, then the
hash of the text.  Texts of any length are cut at block bounds and nowhere else.  An
empty table, or weights of 0 for all sources, give no rows.  Columns are taken by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .textcore import Hasher, chunks, mix, tokens

BLOCK, SLOTS, ALPHA, SEED, SEPARATOR = 1024, 1024, 0.5, 11, "\n<|doc|>\n"
#: Characters of a bucket of documents, of all sources together.
BUCKET_CHARS = 16_000_000


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 applied to x, element by element."""
    x, n, key = (np.asarray(v, np.uint64) for v in np.broadcast_arrays(x, n, key))
    half = np.ones(len(x), np.uint64)
    while (small := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            k, m, h = key[todo], mask[todo], half[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in range(4):
                left, right = right, left ^ (mix(right + mix(k + np.uint64(r + 1))) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def name_key(name: str, seed: int) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    with np.errstate(over="ignore"):
        return int(mix(Hasher(raw)(np.array([0]), np.array([len(raw)])) + np.uint64(seed))[0])


def _turn() -> Column:
    """The order of documents within a source."""
    return F.xxhash64("doc_id", F.lit(1))


def _prepared(docs: DataFrame, buckets: int) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.shiftrightunsigned(_turn(), 40) * buckets / (1 << 24)).cast("int").alias("bucket"),
        F.col("doc_id"),
        F.col("text"),
    ).where(F.col("text").isNotNull())


def bucket_tokens(prepared: DataFrame) -> DataFrame:
    """Tokens of each (source, bucket), summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for a, c, data, off in chunks(b.column(2)):
                _, _, row = tokens(data, off)
                n[a:c] = np.bincount(row, minlength=c - a)
            t = pa.Table.from_arrays([b.column(0), b.column(1), pa.array(n)], ["source", "bucket", "n"]).group_by(["source", "bucket"]).aggregate([("n", "sum")])
            yield from t.select(["source", "bucket", "n_sum"]).rename_columns(["source", "bucket", "n"]).combine_chunks().to_batches()

    return prepared.select("source", "bucket", "text").mapInArrow(run, "source string, bucket int, n long").groupBy("source", "bucket").agg(F.sum("n").alias("n"))


def pieces(prepared: DataFrame, base: DataFrame, block: int) -> DataFrame:
    """source, block, at (first token in the block), n, doc_id, piece: every document cut at block bounds."""
    # a bucket's base travels as its first row; a join on the same keys would let the planner take its
    # partitioning for ours and give it up later when it turns the join into a broadcast
    kind = prepared.schema["doc_id"].dataType.simpleString()
    docs = prepared.select("source", "bucket", F.lit(None).cast("long").alias("base"), "doc_id", "text", F.shiftrightunsigned(_turn(), 1).alias("turn"), F.xxhash64("text").alias("h"))
    heads = base.select("source", "bucket", "base", *[F.lit(None).cast(t).alias(n) for n, t in (("doc_id", kind), ("text", "string"), ("turn", "long"), ("h", "long"))])
    both = docs.union(heads).repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("base").isNull(), "turn", "doc_id", "h").select("source", "bucket", "base", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            src, heads = b.column(0), dict(zip(np.flatnonzero(b.column(2).is_valid()).tolist(), b.column(2).drop_null().to_pylist()))
            for a, c, data, off in chunks(b.column(4)):
                s, _, row = tokens(data, off)
                n = np.bincount(row, minlength=c - a)
                start = np.zeros(c - a, np.int64)
                for i in range(c - a):
                    done = heads.get(a + i, done)
                    start[i] = done
                    done += int(n[i])
                first = np.cumsum(n) - n
                place = start[row] + np.arange(len(row)) - first[row]  # of each token in its source
                lead = np.ones(len(row), bool)
                lead[1:] = (row[1:] != row[:-1]) | (place[1:] % block == 0)
                at = np.flatnonzero(lead)
                own = row[at]
                head = np.concatenate([[True], own[1:] != own[:-1]]) if len(at) else np.zeros(0, bool)
                begin = np.where(head, off[own], s[at])  # white space before the first token belongs to it
                end = np.append(begin[1:], 0)
                tail = np.append(head[1:], True) if len(at) else head
                end = np.where(tail, off[own + 1], end)
                size = np.diff(np.append(at, len(row)))
                cuts = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
                keep = np.zeros(len(data) + 1, np.int64)
                np.add.at(keep, begin, 1)
                np.add.at(keep, end, -1)
                text = data[np.cumsum(keep[:-1]) > 0]
                piece = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts.tobytes()), pa.py_buffer(text.tobytes())).cast(pa.string())
                take = pa.array(a + own)
                yield pa.RecordBatch.from_arrays([src.take(take), pa.array(place[at] // block), pa.array((place[at] % block).astype(np.int32)), pa.array(size.astype(np.int32)), b.column(3).take(take), piece], ["source", "block", "at", "n", "doc_id", "piece"])

    return both.mapInArrow(run, f"source string, block long, at int, n int, doc_id {kind}, piece string")


def slots(spark, sources: list[tuple[str, int, float]], total: int, per_shard: int, seed: int) -> DataFrame:  # noqa: ANN001
    """shard, slot, source, epoch, block for every slot; sources: (name, blocks, weight)."""
    names, blocks, w = [s[0] for s in sources], np.array([s[1] for s in sources]), np.array([s[2] for s in sources], float)
    w = w / w.sum()
    keys = [name_key(n, seed) for n in names]
    shards = -(-total // per_shard)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(5)]
            for shard in b.column(0).to_pylist():
                n = min(per_shard, total - shard * per_shard)
                count = np.random.default_rng([seed, shard]).multinomial(n, w)
                got = np.flatnonzero(count)
                for c, x in zip(out, (np.full(len(got), shard), got, count[got], (np.cumsum(count) - count)[got], np.full(len(got), n))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in out], ["shard", "k", "count", "start", "size"])

    drawn = spark.range(shards).mapInArrow(draw, "shard long, k long, count long, start long, size long")
    prior = F.sum("count").over(Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    counted = drawn.withColumn("prior", F.coalesce(prior, F.lit(0)))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, k, count, start, size, before = (c.to_numpy() for c in b.columns)
            of = np.repeat(np.arange(len(k)), count)
            i = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            j, n = before[of] + i, blocks[k[of]]
            with np.errstate(over="ignore"):
                key = mix(np.array(keys, np.uint64)[k[of]] + (j // n).astype(np.uint64))
                turn = mix(shard[of].astype(np.uint64) + np.uint64(seed))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[of]), pa.array(permute(start[of] + i, size[of], turn)), pa.array(np.array(names, object)[k[of]], pa.string()), pa.array(j // n), pa.array(permute(j % n, n, key))],
                ["shard", "slot", "source", "epoch", "block"],
            )

    return counted.select("shard", "k", "count", "start", "size", "prior").mapInArrow(expand, "shard long, slot long, source string, epoch long, block long")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """shard, slot, source, epoch, block, n_tokens, doc_ids, text: the mixture.

    weights: by source; a source without one is left out.  Without weights, a source
    weighs its token count to the power alpha.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    prepared = _prepared(docs, min(1 << 22, max(1, -(-chars // bucket_chars))))
    counts = written(bucket_tokens(prepared).where("n > 0"))  # at most one row for each source and bucket
    sizes = counts.groupBy("source").agg(F.sum("n").alias("n")).collect()
    have = [(r["source"], -(-r["n"] // block), float(weights.get(r["source"], 0) if weights is not None else r["n"] ** alpha)) for r in sorted(sizes)]
    have = [x for x in have if x[2] > 0]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"shard long, slot long, source string, epoch long, block long, n_tokens int, doc_ids array<{kind}>, text string"
    if not have:
        return spark.createDataFrame([], schema)
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("source", "bucket", F.coalesce(so_far, F.lit(0)).alias("base"))
    parts = pieces(prepared, base, block)
    items = F.array_sort(F.collect_list(F.struct("at", "doc_id", "n", "piece")))
    blocks = parts.groupBy("source", "block").agg(items.alias("p"))
    total = sum(x[1] for x in have)
    wanted = slots(spark, have, total, per_shard, seed)
    # the planner takes the slots for as small as the range they are drawn from and would broadcast them,
    # though they grow with the input; blocks are partitioned by these keys already
    out = blocks.join(wanted.hint("shuffle_hash"), ["source", "block"])
    size = F.aggregate("p.n", F.lit(0), lambda x, y: x + y)
    return out.select("shard", "slot", "source", "epoch", "block", size.alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"), F.array_join("p.piece", SEPARATOR).alias("text"))
