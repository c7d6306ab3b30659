"""Passages that repeat: substring dedup by FM-index (operator 6) and suffix-array dedup (operator 8).

Tokens are lower-cased runs of letters and digits; an interval counts if a match of
at least ``MIN_TOKENS`` tokens covers it.  Comparing every document with every shard
would grow with the square of the input, so shards are made by content: anchors are
token k-grams chosen by winnowing, at least one in every MIN_TOKENS consecutive
tokens and the same ones wherever the passage occurs.  Around each anchor that
occurs again, the tokens within MIN_TOKENS on both sides form a segment, and all
segments of an anchor go to one shard.  A match that long contains an anchor whose
segment holds at least MIN_TOKENS of it around the anchor, so the union of what the
segments report is the union of all such matches: nothing is lost.

Segments of an anchor that are equal, and equally placed around it, are a class.  All
that a class of two documents has is covered at once, and so is (for operator 8) all but
its first segment; only one segment of each class goes to a shard, and only if its
anchor has other classes.  So a shard doesn't grow with the number of copies.

* Operator 6 builds a compressed FM-index of each shard (Burrows-Wheeler transform in
  a wavelet matrix) and streams the shard's segments through it by backward search; a
  token is reported if a match with another document covers it (all copies are).
* Operator 8 builds the shard's suffix array and takes, for each position, the longest
  factor that occurs earlier (by doc_id, then position) from the previous and next
  smaller positions in suffix order; a token is reported if an earlier copy covers it,
  so the first copy stays.  Earlier copies may lie in the same document.

An anchor with more than ``HOT`` classes gets no shard: its segments are cut into all
windows of MIN_TOKENS tokens, whose hashes are aggregated.  That gives the same, since an
interval is the union of such windows, and no group is held in a task.

Results are half-open intervals of token numbers.

Defined cases: rows without doc_id or text, and texts of fewer than MIN_TOKENS tokens,
give nothing.  Rows with equal doc_id and text are one document; texts that share a
doc_id are documents of their own, in the order of their hashes (``h``, which
``with_h`` returns and ``remove`` needs if ids repeat).  Of ties, the lowest doc_id,
text hash and position is the first copy.  Texts of any length are read whole, and a
passage is found wherever it lies; without documents there are no intervals.  Columns
are taken by name, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, written
from .decontam import cut_spans, token_hashes, with_text
from .suffix import FMIndex, SuffixArray, nearest_smaller_lcp
from .textcore import _powers, chunks, mix, ngrams, spans, window_min

MIN_TOKENS, GRAM = 50, 12
#: Tokens of whole anchor groups that one index holds at least, and classes of an anchor that an index may hold.
SHARD_TOKENS, HOT = 250_000, 10_000


def anchors(h: np.ndarray, row: np.ndarray, rows: int, min_tokens: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, token number in the row, row) of the winnowed k-grams of hashed tokens."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    w = min_tokens - k + 1
    g, at = ngrams(h, row, k)
    own = row[at]
    if len(g) < w:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    low = window_min(g, w)
    low[own[: len(low)] != own[w - 1 :]] = 0  # windows across rows choose nothing: no hash is below 0
    room = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    top = ~window_min(~room, w)  # the largest minimum of the windows that hold each k-gram
    pick = (top == g) & (g > 0)
    same = np.zeros(len(g), bool)  # in a run of equal k-grams every w-th will do
    same[1:] = (g[1:] == g[:-1]) & (own[1:] == own[:-1])
    run = np.arange(len(g)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
    i = np.flatnonzero(pick & (run % w == 0))
    return g[i], at[i] - first[own[i]], own[i]


def _rows(docs: DataFrame) -> DataFrame:
    return keyed(docs, "text").withColumn("h", F.xxhash64("text"))


def _token_hasher(h: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of runs of tokens, from prefix sums."""
    power, inverse = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h * power[:-1], out=sums[1:])

        def of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))

        return of


def anchor_table(docs: DataFrame, min_tokens: int, k: int) -> DataFrame:
    """doc_id, h (of the text), start, size, anchor and content (a hash) of the segment around each anchor."""
    docs = _rows(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c, data, off in chunks(b.column(1)):
                h, _, _, of = token_hashes(data, off)
                n = np.bincount(of, minlength=c - a)
                first = np.cumsum(n) - n
                g, pos, row = anchors(h, of, len(off) - 1, min_tokens, k)
                lo, hi = np.maximum(pos - min_tokens, 0), np.minimum(pos + k + min_tokens, n[row])
                content = mix(_token_hasher(h)(first[row] + lo, first[row] + hi) + (pos - lo).astype(np.uint64))
                at = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(lo.astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(content.view(np.int64))],
                    ["doc_id", "h", "start", "size", "anchor", "content"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, h long, start int, size int, anchor long, content long")


def repeated_anchors(docs: DataFrame, min_tokens: int, k: int) -> DataFrame:
    """The anchor table without anchors that occur once; rows that repeat a document count once."""
    found = written(anchor_table(docs, min_tokens, k))
    place = F.struct("doc_id", "h", "start")
    again = found.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a < z").select("anchor")
    return written(found.join(again, "anchor", "left_semi").distinct())


def classes(found: DataFrame) -> DataFrame:
    """anchor, content, size, first (doc_id, h, start), several (documents), copies, kinds (classes of the anchor)."""
    own = F.struct("doc_id", "h")
    c = found.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "h", "start")).alias("first"), F.min(own).alias("low"), F.max(own).alias("high"), F.min("size").alias("size"), F.count("*").alias("copies"))
    c = c.select("anchor", "content", "size", "first", (F.col("low") < F.col("high")).alias("several"), "copies")
    kinds = c.groupBy("anchor").agg(F.count("*").alias("kinds"))
    return written(c.join(kinds, "anchor"))


def segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, content, several, doc_id, h, start, tokens (32-bit hashes) of the first segment of each wanted class."""
    flat = wanted.select("anchor", "content", "several", "size", "first.*")
    by_doc = flat.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "content", "several", "start", "size")).alias("parts"))
    texts = _rows(docs).join(by_doc, ["doc_id", "h"]).select("doc_id", "parts", "text", "h").dropDuplicates(["doc_id", "h"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            start, long = flat.field(3).to_numpy().astype(np.int64), flat.field(4).to_numpy().astype(np.int64)
            for a, c, data, off in chunks(b.column(2)):
                h, _, _, row = token_hashes(data, off)
                h = (h >> np.uint64(32)).astype(np.uint32)
                n = np.bincount(row, minlength=c - a)
                first = np.cumsum(n) - n
                i = np.arange(ends[a], ends[c])
                own = np.repeat(np.arange(c - a), np.diff(ends[a : c + 1]))
                size = long[i]
                to = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(first[own] + start[i] - to[:-1], size) + np.arange(to[-1])
                for u in range(0, len(i), 20_000):
                    v = min(len(i), u + 20_000)
                    part = h[take[to[u] : to[v]]]
                    body = pa.BinaryArray.from_buffers(pa.binary(), v - u, [None, pa.py_buffer(((to[u : v + 1] - to[u]) * 4).astype(np.int32).tobytes()), pa.py_buffer(part.tobytes())])
                    pick, mine = pa.array(a + own[u:v]), pa.array(i[u:v])
                    yield pa.RecordBatch.from_arrays([*(flat.field(x).take(mine) for x in range(3)), b.column(0).take(pick), b.column(3).take(pick), flat.field(3).take(mine), body], ["anchor", "content", "several", "doc_id", "h", "start", "tokens"])

    return texts.mapInArrow(run, f"anchor long, content long, several boolean, doc_id {kind}, h long, start int, tokens binary")


Finder = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def by_fm_index(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, several: np.ndarray, start: np.ndarray, longest: int) -> np.ndarray:
    """Match length from each token with another document; classes of several documents are settled and only searched."""
    doc = np.where(several, -1 - np.arange(len(doc)), doc)  # such a class is another document for every other
    owner = np.repeat(doc, size + 1)
    return FMIndex(ids, owner, longest).matching_statistics(ids, begin, np.where(several, 0, size))


def by_previous_factor(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, several: np.ndarray, start: np.ndarray, longest: int) -> np.ndarray:
    """Match length from each token with an earlier place."""
    s = SuffixArray(ids, longest)
    within = np.arange(len(ids)) - np.repeat(begin, size + 1)
    place = np.repeat((doc << 32) + start, size + 1) + within
    out = np.zeros(len(ids), np.int64)
    out[s.sa] = nearest_smaller_lcp(place[s.sa], s.lcp())
    return out


def indexed(segs: DataFrame, finder: Finder, min_tokens: int, k: int, shard_tokens: int) -> DataFrame:
    """anchor, content, a, b: token intervals within the first segments of classes that matches of at least min_tokens cover."""
    longest = 2 * min_tokens + k

    def flush(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        raw, ends = t["tokens"].combine_chunks().fill_null(b""), None
        off = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
        body = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32)
        ends = (off - off[0]) // 4
        size = np.diff(ends)
        _, dense = np.unique(body, return_inverse=True)
        begin = ends[:-1] + np.arange(len(size))
        ids = np.zeros(len(body) + len(size), np.int64)
        ids[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = dense + 1
        docs, h = t["doc_id"].combine_chunks(), t["h"].to_numpy()
        code = docs.dictionary_encode()
        names = code.dictionary
        order = np.argsort(np.array(names.to_pylist(), object), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = rank[code.indices.to_numpy()]
        order = np.lexsort((h, doc))
        new = (np.diff(doc[order]) != 0) | (np.diff(h[order]) != 0)
        doc[order] = np.concatenate([[0], np.cumsum(new)])
        start = t["start"].to_numpy().astype(np.int64)
        length = finder(ids, begin, size, doc, t["several"].combine_chunks().to_numpy(zero_copy_only=False), start, longest)
        p = np.flatnonzero(length >= min_tokens)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + length[p], -1)
        s, e, seg = spans(np.cumsum(edge[:-1]) > 0, np.append(begin, len(ids)))
        pick = pa.array(seg)
        return pa.RecordBatch.from_arrays([t["anchor"].combine_chunks().take(pick), t["content"].combine_chunks().take(pick), pa.array((s - begin[seg]).astype(np.int32)), pa.array((e - begin[seg]).astype(np.int32))], ["anchor", "content", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            tokens += b.column(6).nbytes // 4
            if tokens >= shard_tokens:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t["anchor"].to_numpy()
                change = np.flatnonzero(key[1:] != key[:-1]) + 1
                per = np.frombuffer(t["tokens"].combine_chunks().buffers()[1], np.int32, t.num_rows + 1)
                done = 0
                while True:  # shards of whole groups
                    more = change[(per[change] - per[done]) // 4 >= shard_tokens] if len(change) else change
                    if not len(more):
                        break
                    yield flush(t.slice(done, int(more[0]) - done))
                    done = int(more[0])
                    change = change[change > done]
                held = t.slice(done).to_batches()
                tokens = (int(per[-1]) - int(per[done])) // 4
                if tokens >= shard_tokens and len(change):
                    yield flush(t.slice(done, int(change[-1]) - done))
                    held = t.slice(int(change[-1])).to_batches()
                    tokens = (int(per[-1]) - int(per[change[-1]])) // 4
        if held:
            yield flush(pa.Table.from_batches(held))

    return segs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, content long, a int, b int")


def windowed(segs: DataFrame, across: bool, min_tokens: int) -> DataFrame:
    """What ``indexed`` gives, from the hashes of all windows of min_tokens tokens."""
    kind = segs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in range(0, b.num_rows, 2000):
                part = b.slice(u, 2000)
                for r, body in enumerate(part.column(6)):
                    h = np.frombuffer(body.as_buffer(), np.uint32).astype(np.uint64)
                    at = np.arange(len(h) - min_tokens + 1)
                    if len(at):
                        key = _token_hasher(mix(h))(at, at + min_tokens)
                        own = pa.array(np.full(len(at), r))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(part.column(k).take(own) for k in range(6)), pa.array(at.astype(np.int32))], ["key", "anchor", "content", "several", "doc_id", "h", "start", "a"])

    made = segs.mapInArrow(cut, f"key long, anchor long, content long, several boolean, doc_id {kind}, h long, start int, a int")
    doc, place = F.struct("doc_id", "h"), F.struct("doc_id", "h", (F.col("start") + F.col("a")).alias("at"))
    if across:
        of = made.groupBy("key").agg(F.min(doc).alias("low"), F.max(doc).alias("high"), F.max("several").alias("any")).where("any or low < high").select("key")
        hit = made.where("not several").join(of, "key", "left_semi")
    else:
        of = made.groupBy("key").agg(F.min(place).alias("low"))
        hit = made.withColumn("place", place).join(of, "key").where("low < place")
    return hit.select("anchor", "content", "a", (F.col("a") + min_tokens).alias("b"))


def joined(parts: DataFrame) -> DataFrame:
    """doc_id, h, start, end: overlapping or touching intervals of a document as one."""
    w = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.distinct().withColumn("new", F.when(far.isNull() | (F.col("start") > far), 1).otherwise(0))
    return marked.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "h", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def intervals(docs: DataFrame, across: bool, min_tokens: int, k: int, shard_tokens: int, hot: int) -> DataFrame:
    """doc_id, h, start, end: merged intervals that matches of at least min_tokens cover; across: with another document, else with an earlier place."""
    found = repeated_anchors(docs, min_tokens, k)
    kinds = classes(found)
    settled = kinds.where((F.col("size") >= min_tokens) & (F.col("several") if across else F.col("copies") > 1)).select("anchor", "content", "first")
    whole = found.join(settled, ["anchor", "content"])
    if not across:
        whole = whole.where(F.col("first") < F.struct("doc_id", "h", "start"))
    whole = whole.select("doc_id", "h", "start", (F.col("start") + F.col("size")).alias("end"))
    wanted = kinds.where((F.col("size") >= min_tokens) & (F.col("kinds") > 1))
    segs = written(segments(docs, wanted.where(F.col("kinds") > hot)))
    part = indexed(segments(docs, wanted.where(F.col("kinds") <= hot)), by_fm_index if across else by_previous_factor, min_tokens, k, shard_tokens)
    if not segs.isEmpty():
        part = part.unionByName(windowed(segs, across, min_tokens))
    if across:
        # what holds for the first segment holds for all of its class (of one document here)
        of = found.select("anchor", "content", "doc_id", "h", "start").join(kinds.where("not several and kinds > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
        part = part.join(of, ["anchor", "content"]).select("doc_id", "h", "start", "a", "b")
    else:
        part = part.join(kinds.where("kinds > 1").select("anchor", "content", "first"), ["anchor", "content"]).select("first.*", "a", "b")
    return joined(whole.union(part.select("doc_id", "h", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("end"))))


def repeated_across(docs: DataFrame, min_tokens: int = MIN_TOKENS, k: int = GRAM, shard_tokens: int = SHARD_TOKENS, hot: int = HOT, with_h: bool = False) -> DataFrame:
    """Operator 6: intervals of each document that another document has."""
    found = intervals(docs, True, min_tokens, k, shard_tokens, hot)
    return found if with_h else found.drop("h")


def later_copies(docs: DataFrame, min_tokens: int = MIN_TOKENS, k: int = GRAM, shard_tokens: int = SHARD_TOKENS, hot: int = HOT, with_h: bool = False) -> DataFrame:
    """Operator 8: intervals that an earlier place has."""
    found = intervals(docs, False, min_tokens, k, shard_tokens, hot)
    return found if with_h else found.drop("h")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without the intervals, from the first byte of the first token to the last of the last.

    found: with h, if a doc_id may have several texts.
    """
    keys = ["doc_id", "h"] if "h" in found.columns else ["doc_id"]
    gone = found.groupBy(*[F.col(k).alias(f"gone_{k}") for k in keys]).agg(F.collect_list(F.struct("start", "end")).alias("gone_parts"))
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = names.index("text")
    same = F.col(f"c{names.index('doc_id')}") == F.col("gone_doc_id")
    if "h" in keys:
        same = same & (F.xxhash64(f"c{at}") == F.col("gone_h"))
    both = docs.toDF(*inner).join(gone, same, "left").select(*inner, "gone_parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts = [], []
            for i in np.flatnonzero(b.column(len(names)).is_valid().to_numpy(zero_copy_only=False)):
                raw = np.frombuffer((b.column(at)[int(i)].as_py() or "").encode(), np.uint8)
                _, s, e, _ = token_hashes(raw, np.array([0, len(raw)]))
                parts = [(int(s[p["start"]]), int(e[p["end"] - 1])) for p in b.column(len(names))[int(i)].as_py() if p["end"] <= len(s)]
                if parts:
                    rows.append(i)
                    texts.append(cut_spans(raw, np.array([0, len(raw)]), parts)[0].tobytes().decode())
            own = pa.RecordBatch.from_arrays(b.columns[: len(names)], names)
            yield pa.RecordBatch.from_arrays(with_text(own, np.array(rows, int), texts).columns, inner)

    return both.mapInArrow(run, both.drop("gone_parts").schema).toDF(*names)
