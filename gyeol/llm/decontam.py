"""Benchmark decontamination by a generalised suffix automaton (operator 7).

The automaton holds every substring of the normalised test items (lower-cased
runs of letters and digits).  Training tokens are streamed through it; the state
gives the longest match that ends at each token.  A match is removed when it has
at least ``min_tokens`` tokens, or at least ``coverage`` of some test item that
contains it (never less than ``floor`` tokens).  A shorter end of the longest match
can cover a shorter item that holds it, so the suffix links are followed for those.

Tokens can only be part of such a match inside a run of trigrams that all occur
in test items, so the automaton is run on those runs alone; this loses nothing.

Items are split by hash over automata of about ``AUTOMATON_TOKENS`` tokens.  Each is
built in a task and comes back as flat arrays, which go to the tasks one after the
other; a larger benchmark takes more passes over the documents.  Spans of all automata
are merged for each document before anything is cut out, so the result doesn't depend
on the split: of the matches in a merged span the longest is named, then the first,
then the shortest item, then the lowest item_id.

Defined cases: null or empty texts and items match nothing; a repeated item
counts once, under its lowest item_id; rows with a null doc_id are cleaned like others
but not reported.  Rows with equal doc_id and text are reported once; with one doc_id
and several texts, each text has its own spans.  Ids may be of any type that can be
ordered.  Columns are taken by name, others don't matter.  An item of fewer than
``floor`` tokens can't be found; ``floor`` is an argument.  Texts of any length are
streamed whole; without documents or items there are no spans.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .textcore import Hasher, chunks, fold, ngrams, python_positions, words

MIN_TOKENS, COVERAGE, FLOOR = 13, 0.8, 6
AUTOMATON_TOKENS = 500_000


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of the normalised tokens."""
    low = fold(data)
    s, e, row = words(low, off)
    return Hasher(low)(s, e), s, e, row


class SuffixAutomaton:
    """All substrings of a set of token sequences; each state knows its shortest item."""

    def __init__(self, items: list[list[int]], ids: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.short, self.item = [-1], [0], [1 << 60], [-1]
        for seq, name in zip(items, ids):
            last = 0
            for c in seq:
                last = self._add(last, c)
                if len(seq) < self.short[last]:
                    self.short[last], self.item[last] = len(seq), name
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            u = self.link[v]
            if self.short[v] < self.short[u]:
                self.short[u], self.item[u] = self.short[v], self.item[v]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.short.append(1 << 60)
        self.item.append(-1)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        r = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        self.link[q] = r
        return r

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return new

    def covering(self, coverage: float, floor: int) -> list[int]:
        """For each state, the longest shorter suffix (as a state) that covers enough of an item; 0 for none."""
        out = [0] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            u = self.link[v]
            out[v] = u if u and self.len[u] >= floor and self.len[u] >= coverage * self.short[u] else out[u]
        return out

    def matches(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the longest match that ends at each token."""
        v = length = 0
        for i, c in enumerate(seq):
            while v and c not in self.next[v]:
                v = self.link[v]
                length = self.len[v]
            if c in self.next[v]:
                v = self.next[v][c]
                length += 1
            yield i, length, v

    def flat(self, coverage: float, floor: int) -> dict[str, np.ndarray]:
        """The automaton as arrays; transitions are sorted by state and symbol."""
        size = np.array([len(x) for x in self.next], np.int64)
        state = np.repeat(np.arange(len(size)), size)
        symbol = np.fromiter((c for x in self.next for c in x), np.int64, int(size.sum()))
        to = np.fromiter((v for x in self.next for v in x.values()), np.int64, int(size.sum()))
        key = (state << 32) | symbol
        o = np.argsort(key)
        i32 = lambda x: np.minimum(np.array(x, np.int64), (1 << 31) - 1).astype(np.int32)
        return {"key": key[o], "to": to[o].astype(np.int32), "link": i32(self.link), "len": i32(self.len), "short": i32(self.short), "item": i32(self.item), "cover": i32(self.covering(coverage, floor))}


def build(items: list[tuple[object, str]], coverage: float, floor: int) -> dict:
    """Arrays of one automaton, with its items' trigrams and tokens; items: (id, text)."""
    seqs: dict[tuple, object] = {}
    grams = [np.zeros(0, np.uint64)]
    for name, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        h, _, _, row = token_hashes(raw, np.array([0, len(raw)]))
        seq = tuple(h.tolist())
        if len(seq) < floor:
            continue
        if seq not in seqs:
            grams.append(ngrams(h, row, 3)[0])
            seqs[seq] = name
        elif name < seqs[seq]:
            seqs[seq] = name
    vocab = np.unique(np.array([h for q in seqs for h in q], np.uint64))
    names = sorted(seqs.values())
    rank = {n: k for k, n in enumerate(names)}
    ordered = sorted(seqs, key=lambda q: rank[seqs[q]])
    sam = SuffixAutomaton([np.searchsorted(vocab, np.array(q, np.uint64)).tolist() for q in ordered], [rank[seqs[q]] for q in ordered])
    return {**sam.flat(coverage, floor), "vocab": vocab, "names": names, "grams": np.unique(np.concatenate(grams))}


class Detector:
    """Streams token runs through one automaton, all runs of a batch in step."""

    def __init__(self, arrays: dict, min_tokens: int, coverage: float, floor: int):
        self.__dict__.update(arrays)
        self.min_tokens, self.coverage, self.floor = min_tokens, coverage, floor
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.grams >> np.uint64(44)).astype(np.int64)] = True
        self.least = max(3, min(min_tokens, floor))

    def runs(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hashes, starts, ends, rows of the tokens; first token and end of each run that can hold a match)."""
        h, s, e, row = token_hashes(data, off)
        g, at = ngrams(h, row, 3)
        hit = np.flatnonzero(self.map[(g >> np.uint64(44)).astype(np.int64)])
        hit = hit[np.isin(g[hit], self.grams)]
        first = at[hit]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (row[first[1:]] != row[first[:-1]])])) if len(first) else np.zeros(0, np.int64)
        a, b = first[new], first[np.append(new[1:], len(first)) - 1] + 3 if len(first) else first
        ok = b - a >= self.least
        return h, s, e, row, a[ok], b[ok]

    def matches(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token, length, state) of the longest match that ends at each token of the runs a..b-1."""
        top = max(len(self.vocab) - 1, 0)
        t, v, n = a.copy(), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        lane = np.flatnonzero(t < b)
        while len(lane):
            x = h[t[lane]]
            c = np.minimum(np.searchsorted(self.vocab, x), top)
            known = self.vocab[c] == x
            key = (v[lane] << 32) | c
            k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            go = known & (self.key[k] == key)
            stop = ~known | (~go & (v[lane] == 0))
            up = lane[~go & ~stop]
            on = lane[go]
            v[on], n[on] = self.to[k[go]], n[on] + 1
            v[lane[stop]] = n[lane[stop]] = 0
            yield t[on], n[on].copy(), v[on].copy()
            t[on] += 1
            t[lane[stop]] += 1
            v[up] = self.link[v[up]]
            n[up] = self.len[v[up]]
            lane = lane[t[lane] < b[lane]]

    def found(self, data: np.ndarray, off: np.ndarray) -> list[tuple]:
        """(row, first token, end token, first byte, end byte, tokens, first token, length of the item, item, reason) of the merged matches to remove."""
        h, s, e, row, a, b = self.runs(data, off)
        if not len(a):
            return []
        head = np.searchsorted(row, row[a])  # first token of the row
        base = dict(zip(row[a].tolist(), head.tolist()))
        out = []
        for t, n, v in self.matches(h, a, b):
            long = n >= self.min_tokens
            own = long | ((n >= self.floor) & (n >= self.coverage * self.short[v]))
            u = np.where(own, v, self.cover[v])
            n = np.where(own, n, np.where(u > 0, self.len[u], 0))
            for i in np.flatnonzero(n > 0):
                first = int(t[i] - n[i] + 1)
                r = int(row[first])
                k = first - base[r]
                out.append((r, k, k + int(n[i]), int(s[first] - off[r]), int(e[t[i]] - off[r]), int(n[i]), k, int(self.short[u[i]]), self.names[self.item[u[i]]], "length" if long[i] else "coverage"))
        return merged(out)


def merged(found: list[tuple]) -> list[tuple]:
    """Overlapping matches as one, named after the best of them."""
    out: list[tuple] = []
    for f in sorted(found, key=lambda f: f[:3]):
        m = out[-1] if out else None
        if m and m[0] == f[0] and f[1] < m[2]:
            best = min(m, f, key=lambda x: (-x[5], *x[6:9]))
            out[-1] = (m[0], m[1], max(m[2], f[2]), m[3], max(m[4], f[4]), *best[5:])
        else:
            out.append(f)
    return out


def detectors(benchmark: DataFrame, coverage: float, floor: int, tokens: int) -> list[tuple]:
    """(name, broadcast) of each automaton's arrays, each of about ``tokens`` tokens; the driver holds one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // (6 * tokens)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(b.column(1).to_pylist(), b.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(build(rows, coverage, floor))], pa.binary())], ["arrays"])

    made = items.repartition(shards, "text").mapInArrow(make, "arrays binary")
    sent = [(uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(r[0]))) for r in made.toLocalIterator()]
    return sent or [("", spark.sparkContext.broadcast(pickle.dumps(build([], coverage, floor))))]


_last: dict[object, Detector] = {}


def _detector(sent: tuple, min_tokens: int, coverage: float, floor: int) -> Detector:
    """The detector of a broadcast; a worker keeps the one it used last."""
    key = (sent[0], min_tokens, coverage, floor)
    if key not in _last:
        _last.clear()
        _last[key] = Detector(pickle.loads(sent[1].value), min_tokens, coverage, floor)
    return _last[key]


def _pass(docs: DataFrame, benchmark: DataFrame, load: Callable[[], Detector]) -> DataFrame:
    """doc_id, h and what ``found`` gives, in characters and bytes, by one automaton."""
    from pyspark.sql.pandas.types import to_arrow_type

    own = docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    item = benchmark.schema["item_id"].dataType
    kinds = [pa.int32()] * 9 + [to_arrow_type(item), pa.string(), pa.string()]
    names = ["t0", "t1", "b0", "b1", "start", "end", "n", "first", "short", "item", "reason", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = load()
        for b in batches:
            ids, rows = [], []
            for a, _, data, off in chunks(b.column(1)):
                last, pos = -1, None
                for row, t0, t1, b0, b1, *rest in detector.found(data, off):
                    text = data[off[row] : off[row + 1]]
                    if row != last:
                        last, pos = row, python_positions(text)
                    ids.append(a + row)
                    rows.append((t0, t1, b0, b1, int(pos[b0]), int(pos[b1]), *rest, text[b0:b1].tobytes().decode()))
            take = pa.array(ids, pa.int64())
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), *cols], ["doc_id", "h", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, h long, t0 int, t1 int, b0 int, b1 int, start int, end int, n int, first int, short int, item {item.simpleString()}, reason string, span string")


def _spans(docs: DataFrame, benchmark: DataFrame, min_tokens: int, coverage: float, floor: int, tokens: int) -> DataFrame:
    """doc_id, h (of the text), start, end, b0, b1 and the best match of each span, merged over all automata."""
    sent = detectors(benchmark, coverage, floor, tokens)
    found = reduce(DataFrame.unionAll, [_pass(docs, benchmark, lambda x=x: _detector(x, min_tokens, coverage, floor)) for x in sent]).distinct()
    w = Window.partitionBy("doc_id", "h").orderBy("t0", "t1")
    far = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = F.sum(F.when(F.col("far").isNull() | (F.col("t0") >= F.col("far")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    best = F.min(F.struct((-F.col("n")).alias("m"), "first", "short", "item", "reason")).alias("best")
    pieces = F.array_sort(F.collect_list(F.struct("start", "end", "span"))).alias("pieces")
    whole = found.withColumn("far", far).withColumn("part", joined).groupBy("doc_id", "h", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), best, pieces)
    # spans of several automata overlap: each adds what lies behind the end so far
    zero = F.struct(F.lit("").alias("text"), F.col("start").alias("at"))
    step = lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(F.struct(F.concat(acc["text"], F.substr(x["span"], acc["at"] - x["start"] + 1)).alias("text"), x["end"].alias("at")))
    text = F.aggregate("pieces", zero, step, lambda acc: acc["text"])
    return whole.select("doc_id", "h", "start", "end", "b0", "b1", (-F.col("best.m")).alias("match_tokens"), F.col("best.item").alias("item_id"), F.col("best.reason").alias("reason"), text.alias("span"))


def leaks(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, coverage: float = COVERAGE, floor: int = FLOOR, tokens: int = AUTOMATON_TOKENS) -> DataFrame:
    """One row for each part of a document to remove, in characters from start to before end."""
    named = docs.where(F.col("doc_id").isNotNull())
    return _spans(named, benchmark, min_tokens, coverage, floor, tokens).select("doc_id", "start", "end", "match_tokens", "item_id", "reason", "span")


def cut_spans(data: np.ndarray, off: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The text without the byte ranges, and its new offsets."""
    gone = np.zeros(len(data) + 1, np.int64)
    for s, e in spans:
        gone[s] += 1
        gone[e] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    left = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=left[1:])
    return data[keep], left[off]


def with_text(batch: pa.RecordBatch, rows: np.ndarray, texts: list[str]) -> pa.RecordBatch:
    """The batch with the texts of some rows replaced, and their n_chars if there is such a whole-number column."""
    if not len(rows):
        return batch
    names, cols = batch.schema.names, list(batch.columns)
    mask = np.zeros(batch.num_rows, bool)
    mask[rows] = True
    k = names.index("text")
    cols[k] = pc.replace_with_mask(cols[k], pa.array(mask), pa.array(texts, cols[k].type))
    if "n_chars" in names and pa.types.is_integer(cols[n := names.index("n_chars")].type):
        cols[n] = pc.replace_with_mask(cols[n], pa.array(mask), pa.array([len(t) for t in texts], cols[n].type))
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def _without(b: pa.RecordBatch, at: int, spans: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
    """The batch with byte ranges of some rows cut out; a row that has no word left afterwards goes."""
    rows, texts, keep = sorted(spans), [], np.ones(b.num_rows, bool)
    for r in rows:
        raw = np.frombuffer(b.column(at)[r].as_py().encode(), np.uint8)
        new, off = cut_spans(raw, np.array([0, len(raw)]), spans[r])
        keep[r] = len(words(new, off)[0]) > 0
        texts.append(new.tobytes().decode())
    out = with_text(b, np.array(rows, int), texts)
    return out if keep.all() else out.filter(pa.array(keep))


def clean(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, coverage: float = COVERAGE, floor: int = FLOOR, tokens: int = AUTOMATON_TOKENS) -> DataFrame:
    """The documents without leaked parts; one that has no word left afterwards goes.

    One automaton finds and cuts in the same pass.  Of several, the merged spans are
    written and joined to the documents, which gives the same.
    """
    names = docs.columns
    at = names.index("text")
    sent = detectors(benchmark, coverage, floor, tokens)
    if len(sent) == 1:

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            detector = _detector(sent[0], min_tokens, coverage, floor)
            for b in batches:
                spans: dict[int, list[tuple[int, int]]] = {}
                for a, _, data, off in chunks(b.column(at)):
                    for row, _, _, b0, b1, *_ in detector.found(data, off):
                        spans.setdefault(a + row, []).append((b0, b1))
                yield _without(b, at, spans) if spans else b

        return docs.mapInArrow(one, docs.schema)
    found = written(_spans(docs, benchmark, min_tokens, coverage, floor, tokens))
    gone = found.groupBy(F.col("doc_id").alias("gone_doc"), F.col("h").alias("gone_h")).agg(F.collect_list(F.struct("b0", "b1")).alias("gone_parts"))
    inner = [f"c{k}" for k in range(len(names))]
    mine = docs.toDF(*inner)
    match = mine[f"c{names.index('doc_id')}"].eqNullSafe(F.col("gone_doc")) & (F.xxhash64(mine[f"c{at}"]) == F.col("gone_h"))
    both = mine.join(gone, match, "left").select(*inner, "gone_parts")

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column(len(names))
            spans = {int(r): [(p["b0"], p["b1"]) for p in parts[int(r)].as_py()] for r in np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False))}
            own = pa.RecordBatch.from_arrays(b.columns[: len(names)], names)
            yield pa.RecordBatch.from_arrays(_without(own, at, spans).columns, inner)

    return both.mapInArrow(many, mine.schema).toDF(*names)
