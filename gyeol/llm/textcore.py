"""Vectorised text primitives shared by the training-data operators.

Everything works on the raw UTF-8 buffer of an Arrow string column: one flat
``uint8`` array plus row offsets.  Tokens, lines and their hashes come out as
flat numpy arrays, so no Python object is made per token.  Byte positions are
always positions in the original text: case folding is length preserving (ASCII
and the Latin-1 letters; other scripts keep their case).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text handled at once, so that work arrays stay in cache-sized memory.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_pow = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, CHUNK + 1)  # kept by each worker
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INV)):
                p = np.full(size, base, U64)
                p[0] = 1
                _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
        x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
        return x ^ (x >> U64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    at = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of at most ``limit`` bytes each; a longer row stands alone."""
    data, off = buffers(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case, byte for byte (ASCII and U+00C0..U+00DE)."""
    out = _FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    if len(lead):
        nxt = data[lead + 1]
        up = (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
        out[lead[up] + 1] += 32
    return out


def word_bytes(data: np.ndarray) -> np.ndarray:
    """True at bytes of letters and digits.  Latin-1, general and CJK punctuation count as separators."""
    m = _WORD[data]
    for lead, nexts, n in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(data == lead)
        if len(at):
            at = at[at + n <= len(data)]
            if nexts:
                at = at[np.isin(data[at + 1], nexts)]
            for k in range(n):
                m[at + k] = False
    return m


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of True; a run never crosses a row."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    st = mask.copy()
    st[1:] &= ~mask[:-1] | brk[1:n]
    en = mask.copy()
    en[:-1] &= ~mask[1:] | brk[1:n]
    s, e = np.flatnonzero(st), np.flatnonzero(en) + 1
    counts = np.diff(np.searchsorted(s, off))
    return s, e, np.repeat(np.arange(len(off) - 1), counts)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(word_bytes(data), off)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space."""
    return spans(~_SPACE[data], off)


class Hasher:
    """Hashes of any substrings of one buffer, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        p, self.inv = _powers(len(data) + 1)
        self.p = p
        self.sum = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(U64) + U64(1)) * p[:-1], out=self.sum[1:])

    def raw(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sum[e] - self.sum[s]) * self.inv[s]

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(self.raw(s, e) + (e - s).astype(U64))


def ngrams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of the k-grams within rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = h[:n].copy()
        for i in range(1, k):
            g = g * U64(0xD1342543DE82EF95) + h[i : n + i]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(g[at]), at


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w consecutive values, by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : len(x) - have + 1])
    return out


def characters(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each character."""
    return (data & 0xC0) != 0x80


def python_positions(data: np.ndarray) -> np.ndarray:
    """Characters before each byte position (length n + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(characters(data), out=out[1:])
    return out
