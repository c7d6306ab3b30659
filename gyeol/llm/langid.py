"""Language ID by a byte convolutional network (operator 4).

Bytes are embedded, filters of widths 2, 3 and 4 slide over fixed-length
windows, each filter's maximum is kept, and a softmax gives language
probabilities.  The network is trained in numpy on labelled text: a step draws
documents from at most ``TRAIN_ROWS`` labelled ones and any window of each.  Only the
windows drawn reach the driver.  A document's probabilities are the mean over all of
its windows, so the whole text counts.

For inference the embedding and the filters are folded into two tables that are
indexed by byte pairs; a window position costs two look-ups and one addition.

Defined cases: a null text, or one without a letter, has no language (null,
confidence 0, not kept).  A text shorter than a window is padded.  Documents with
equal texts get equal results.  A tie goes to the language first in order.  Rows
with a null label take no part in training; without any labelled row no language
is given and nothing is kept.  Texts of any length are read whole.  Columns are taken
by name, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .textcore import buffers, word_bytes

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 12, 8
STRIDE = WINDOW - max(WIDTHS) + 1
#: Bound on the labelled rows the classifier is fitted on; steps of training and windows in each.
TRAIN_ROWS, STEPS, BATCH = 2000, 500, 96
#: Documents whose best language has less than this mean probability are rejected.
MIN_CONFIDENCE = 0.4


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte windows, row, bytes used): windows of WINDOW bytes every STRIDE bytes cover each row."""
    n = np.diff(off)
    per = window_count(n)
    row = np.repeat(np.arange(len(n)), per)
    first = np.cumsum(per) - per
    at = off[:-1][row] + (np.arange(len(row)) - first[row]) * STRIDE
    used = np.minimum(off[1:][row] - at, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    win = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[at]
    short = np.flatnonzero(used < WINDOW)
    win[short] = np.where(np.arange(WINDOW) < used[short, None], win[short], 0)
    return win, row, used


@dataclass
class ByteConvNet:
    languages: list[str]
    first: np.ndarray  # (65536, widths x filters): bytes 0 and 1 of a position
    second: np.ndarray  # (65536, (widths - 1) x filters): bytes 2 and 3
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, win: np.ndarray) -> np.ndarray:
        got, used = [], STRIDE
        for a in range(0, len(win), 48):
            b = win[a : a + 48].astype(np.int32)
            pair = (b[:, :-1] << 8) | b[:, 1:]
            z = self.first[pair[:, :used]]
            z[:, :, FILTERS:] += self.second[pair[:, 2 : 2 + used]]
            h = np.maximum(z.max(axis=1) + self.bias, 0)
            got.append(h @ self.out + self.out_bias)
        x = np.concatenate(got) if got else np.zeros((0, len(self.languages)), np.float32)
        x = np.exp(x - x.max(axis=1, keepdims=True)) if x.size else x
        return x / x.sum(axis=1, keepdims=True)

    def documents(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities of each row; zeros for an empty one."""
        total = np.zeros((len(off) - 1, len(self.languages)))
        weight = np.zeros(len(off) - 1)
        win, row, used = windows(data, off)
        np.add.at(total, row, self.probabilities(win) * used[:, None])
        np.add.at(weight, row, used)
        return total / np.maximum(weight, 1)[:, None]


def window_count(size: np.ndarray) -> np.ndarray:
    """Windows of texts of these many bytes."""
    return np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)


def draws(sizes: np.ndarray, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window of it) for each place in each step's batch."""
    rng = np.random.default_rng(seed)
    text = rng.integers(0, max(1, len(sizes)), steps * BATCH)
    return text, (rng.random(steps * BATCH) * window_count(sizes)[text]).astype(np.int64) if len(sizes) else text * 0


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> ByteConvNet:
    """Fit on windows of these texts, which must not be empty."""
    text, window = draws(np.array([len(t) for t in texts], np.int64), steps, seed)
    cut = lambda t, k: np.frombuffer(t[k * STRIDE : k * STRIDE + WINDOW].ljust(WINDOW, b"\0"), np.uint8)
    win = np.stack([cut(texts[i], k) for i, k in zip(text.tolist(), window.tolist())]) if texts else np.zeros((0, WINDOW), np.uint8)
    return train_windows(win, [labels[i] for i in text.tolist()] if texts else [], sorted(set(labels)), seed)


def train_windows(x_all: np.ndarray, labels: list[str], languages: list[str], seed: int = 7) -> ByteConvNet:
    """Fit by Adam on the cross entropy of single windows, BATCH in a step; gradients flow through each filter's maximum."""
    rng = np.random.default_rng(seed)
    of = {x: i for i, x in enumerate(languages)}
    y_all, k = np.array([of[y] for y in labels], int), len(languages)
    f32 = np.float32
    par = {"E": rng.normal(0, 0.3, (256, DIM)).astype(f32), "U": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, k)).astype(f32), "c": np.zeros(k, f32)}
    for w in WIDTHS:
        par[f"W{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(f32)
        par[f"b{w}"] = np.zeros(FILTERS, f32)
    m = {n: np.zeros_like(v) for n, v in par.items()}
    v2 = {n: np.zeros_like(v) for n, v in par.items()}
    for step in range(1, len(x_all) // BATCH + 1 if k > 1 else 1):
        pick = slice((step - 1) * BATCH, step * BATCH)
        x, y = x_all[pick].astype(int), y_all[pick]
        cut = rng.integers(12, WINDOW + 1, BATCH)  # short texts are met in training, too
        cut[rng.random(BATCH) < 0.5] = WINDOW
        x[np.arange(WINDOW) >= cut[:, None]] = 0
        e = par["E"][x]
        hs, keep = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, i : i + STRIDE] for i in range(w)], axis=2)
            z = cols @ par[f"W{w}"] + par[f"b{w}"]
            arg = z.argmax(axis=1)
            keep.append((cols, arg))
            hs.append(np.take_along_axis(z, arg[:, None], 1)[:, 0])
        pre = np.concatenate(hs, axis=1)
        h = np.maximum(pre, 0)
        s = h @ par["U"] + par["c"]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        ds = p
        ds[np.arange(BATCH), y] -= 1
        ds /= BATCH
        g = {"U": h.T @ ds, "c": ds.sum(0), "E": np.zeros_like(par["E"])}
        dh = (ds @ par["U"].T) * (pre > 0)
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            cols, arg = keep[i]
            at = cols[np.arange(BATCH)[:, None], arg]  # (batch, filters, w x DIM)
            g[f"W{w}"] = np.einsum("bf,bfk->kf", d, at)
            g[f"b{w}"] = d.sum(0)
            de = (d[:, :, None] * par[f"W{w}"].T[None]).reshape(BATCH, FILTERS, w, DIM)
            byte = x[np.arange(BATCH)[:, None, None], arg[:, :, None] + np.arange(w)]
            np.add.at(g["E"], byte, de)
        for n, grad in g.items():
            m[n] = 0.9 * m[n] + 0.1 * grad
            v2[n] = 0.99 * v2[n] + 0.01 * grad * grad
            par[n] = (par[n] - 0.01 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v2[n] / (1 - 0.99**step)) + 1e-7)).astype(f32)
    tap = {(w, i): par["E"] @ par[f"W{w}"][i * DIM : (i + 1) * DIM] for w in WIDTHS for i in range(w)}
    pairs = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
    zero = np.zeros((256, FILTERS), f32)
    first = np.concatenate([pairs(tap[w, 0], tap[w, 1]) for w in WIDTHS], axis=1)
    second = np.concatenate([pairs(tap[3, 2], zero), pairs(tap[4, 2], tap[4, 3])], axis=1)
    return ByteConvNet(languages, np.ascontiguousarray(first), np.ascontiguousarray(second), np.concatenate([par[f"b{w}"] for w in WIDTHS]), par["U"], par["c"])


def chosen(docs: DataFrame, label: str, rows: int) -> list:
    """(doc_id, h of the text, label, bytes) of the labelled documents with the lowest hashes, at most ``rows``."""
    own = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col(label).alias("y"), F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("o"))
    own = own.where(F.col("y").isNotNull() & (F.col("size") > 0))
    n = own.count()
    share = min(1.0, (2 * rows + 100) / max(n, 1))
    while True:  # about twice the rows wanted come to the driver, whatever the input's size
        below = own if share >= 1 else own.where(F.col("o") < F.lit(int(-(1 << 63) + share * (1 << 64))))
        got = below.orderBy("o", "doc_id", "h", "y").limit(rows).collect()
        if len(got) >= min(rows, n) or share >= 1:
            return [(r["doc_id"], r["h"], r["y"], r["size"]) for r in got]
        share = min(1.0, share * 8)


def fit(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, steps: int = STEPS, seed: int = 7) -> ByteConvNet:
    """Train on at most ``rows`` labelled documents: those whose doc_id has the lowest hash."""
    spark = docs.sparkSession
    some = chosen(docs, label, rows)
    text, window = draws(np.array([r[3] for r in some], np.int64), steps, seed)
    if not some:
        return train_windows(np.zeros((0, WINDOW), np.uint8), [], [], seed)
    wanted: dict[int, set[int]] = {}
    for i, k in zip(text.tolist(), window.tolist()):
        wanted.setdefault(i, set()).add(k)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_of = spark.createDataFrame([(some[i][0], some[i][1], i, sorted(k)) for i, k in wanted.items()], f"of_doc {kind}, of_h long, i int, k array<int>")
    own = docs.select("doc_id", "text")
    both = own.join(F.broadcast(rows_of), own["doc_id"].eqNullSafe(F.col("of_doc")) & (F.xxhash64(own["text"]) == F.col("of_h")))  # at most ``rows`` of them

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, i, ks in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.as_buffer()
                part = [raw[k * STRIDE : min(k * STRIDE + WINDOW, raw.size)].to_pybytes() for k in ks]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ks), pa.int32()), pa.array(ks, pa.int32()), pa.array(part, pa.binary())], ["i", "k", "part"])

    got = {(r["i"], r["k"]): bytes(r["part"]) for r in both.select("text", "i", "k").mapInArrow(cut, "i int, k int, part binary").collect()}
    win = np.stack([np.frombuffer(got[i, k].ljust(WINDOW, b"\0"), np.uint8) for i, k in zip(text.tolist(), window.tolist())])
    return train_windows(win, [some[i][2] for i in text.tolist()], sorted({r[2] for r in some}), seed)


def score(net: ByteConvNet, text: pa.Array, min_confidence: float) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(language, confidence, keep) of each text."""
    data, off = buffers(text)
    n, p, letters = len(off) - 1, [], []
    a = 0
    while a < n:  # about 256 KB at once
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + (1 << 18), "right")) - 1))
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        p.append(net.documents(part, o))
        digit = (part >= 48) & (part <= 57)
        has = np.zeros(len(part) + 1, np.int64)
        np.cumsum(word_bytes(part) & ~digit, out=has[1:])
        letters.append(has[o[1:]] > has[o[:-1]])
        a = b
    probs = np.concatenate(p) if p else np.zeros((0, len(net.languages)))
    known = np.concatenate(letters) if letters else np.zeros(0, bool)
    if not net.languages:
        return pa.nulls(n, pa.string()), np.zeros(n), np.zeros(n, bool)
    best = probs.argmax(axis=1)
    conf = np.where(known, probs[np.arange(n), best], 0.0) if n else np.zeros(0)
    lang = pa.array([net.languages[i] if k else None for i, k in zip(best, known)], pa.string())
    return lang, conf, known & (conf >= min_confidence)


def identify(docs: DataFrame, net: ByteConvNet, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, predicted language, confidence and whether it is kept, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, conf, keep = score(net, b.column(1), min_confidence)
            yield pa.RecordBatch.from_arrays([b.column(0), lang, pa.array(conf), pa.array(keep)], ["doc_id", "predicted", "confidence", "keep"])

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, predicted string, confidence double, keep boolean")


def keep_identified(docs: DataFrame, net: ByteConvNet, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The documents whose language is identified, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(net, b.column(at), min_confidence)[2]))
        give_back()

    return docs.mapInArrow(run, docs.schema)
