"""Suffix arrays of token sequences, longest common prefixes, smaller-value pointers and a compressed FM-index."""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """Order of the suffixes of ``ids`` that start at a token; 0 separates sequences and ends a suffix.

    Keys of several packed tokens are sorted first; then only suffixes that are still
    equal are sorted again, by the rank of what follows, over twice the length each
    time.  Suffixes equal up to ``longest`` tokens, or to their end, keep text order.
    """

    def __init__(self, ids: np.ndarray, longest: int):
        n = len(ids)
        self.ids = ids
        self.bits = max(1, int(ids.max(initial=0)).bit_length())
        self.per = max(1, 62 // self.bits)
        padded = np.concatenate([ids.astype(np.int64), np.zeros(self.per, np.int64)])
        key = np.zeros(n + 1, np.int64)
        for t in range(self.per):
            key[:n] = (key[:n] << self.bits) | padded[t : t + n]
        self.key = key
        zero = np.append(np.flatnonzero(ids == 0), n)
        self.left = np.empty(n + 1, np.int64)  # tokens up to the next separator
        self.left[:n] = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)
        self.left[n] = 0
        at = np.flatnonzero(ids)
        sa = at[np.argsort(self._own(key[at], at), kind="quicksort")]
        k = self._own(key[sa], sa)
        self.first_keys = k
        g = self._groups(np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool), np.arange(len(k)))
        rank = np.zeros(n + 1, np.int64)
        rank[sa] = g + 1
        h = self.per
        while h < longest and len(sa):
            twin = np.zeros(len(sa), bool)
            twin[1:] = g[1:] == g[:-1]
            twin[:-1] |= twin[1:]
            act = np.flatnonzero(twin & (self.left[sa] >= h))
            if not len(act):
                break
            p = sa[act]
            then = rank[np.minimum(p + h, n)]
            both = g[act] * (len(sa) + 2) + then
            o = np.argsort(both)
            p, both = p[o], both[o]
            sa[act] = p
            g[act] = self._groups(np.concatenate([[True], both[1:] != both[:-1]]), act)
            rank[p] = g[act] + 1
            h *= 2
        twin = np.zeros(len(sa), bool)
        twin[1:] = g[1:] == g[:-1]
        twin[:-1] |= twin[1:]
        act = np.flatnonzero(twin)
        if len(act):
            p = sa[act]
            sa[act] = p[np.argsort(g[act] * (n + 1) + p)]
        self.sa = sa

    def _own(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Packed keys without what lies behind a separator."""
        extra = np.maximum(0, self.per - self.left[at]) * self.bits
        return (key >> extra) << extra

    @staticmethod
    def _groups(start: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(start, place, 0)) if len(place) else place

    def lcp(self) -> np.ndarray:
        """Tokens that each suffix shares with the one before it; 0 at both ends (length n + 1)."""
        sa, n = self.sa, len(self.ids)
        out = np.zeros(len(sa) + 1, np.int64)
        if len(sa) < 2:
            return out
        a, b = sa[:-1], sa[1:]
        limit = np.minimum(self.left[a], self.left[b])
        todo, h = np.arange(len(a)), 0
        got = np.zeros(len(a), np.int64)
        while len(todo):
            same = (self.key[np.minimum(a[todo] + h, n)] == self.key[np.minimum(b[todo] + h, n)]) & (h < limit[todo])
            stop = todo[~same]
            got[stop] = h
            todo = todo[same]
            h += self.per
        ids = np.append(self.ids, 0)
        todo = np.flatnonzero(got < limit)
        for _ in range(self.per - 1):
            same = ids[np.minimum(a[todo] + got[todo], n)] == ids[np.minimum(b[todo] + got[todo], n)]
            todo = todo[same]
            got[todo] += 1
            todo = todo[got[todo] < limit[todo]]
        out[1:-1] = np.minimum(got, limit)
        return out


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each value, -1 for none; all pointers jump at once."""
    p = np.arange(len(x)) - 1
    todo = np.flatnonzero(p >= 0)
    todo = todo[x[p[todo]] >= x[todo]]
    while len(todo):
        p[todo] = p[p[todo]]
        todo = todo[p[todo] >= 0]
        todo = todo[x[p[todo]] >= x[todo]]
    return p


def next_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the right, len(x) for none."""
    return len(x) - 1 - previous_smaller(x[::-1])[::-1]


def nearest_smaller_lcp(value: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest prefix each suffix shares with one of smaller value (0 if there is none).

    value: in suffix order; lcp[k]: of suffixes k - 1 and k.  The least lcp on the way is
    carried along as the pointers jump, in both directions.
    """
    best = np.zeros(len(value), np.int64)
    for flip in (False, True):
        v = value[::-1] if flip else value
        low = (lcp[1:][::-1] if flip else lcp[:-1])[: len(v)].copy()  # shared with the neighbour to the left
        p = np.arange(len(v)) - 1
        todo = np.flatnonzero(p >= 0)
        todo = todo[v[p[todo]] >= v[todo]]
        while len(todo):
            q = p[todo]
            low[todo] = np.minimum(low[todo], low[q])
            p[todo] = p[q]
            todo = todo[p[todo] >= 0]
            todo = todo[v[p[todo]] >= v[todo]]
        low[p < 0] = 0
        best = np.maximum(best, low[::-1] if flip else low)
    return best


class WaveletMatrix:
    """Rank of any symbol in a sequence, from one bit vector (64-bit words and word counts) for each bit of the symbols."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.n = bits, len(x)
        self.words, self.counts, self.zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            bit = ((x >> b) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            count = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=count[1:])
            self.words.append(words)
            self.counts.append(count)
            self.zeros.append(int(len(bit) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.base = self._descend(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            one = (c >> (self.bits - 1 - level)) & 1
            w = i >> 6
            ones = self.counts[level][w] + np.bitwise_count(self.words[level][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(one, ones + self.zeros[level], i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self._descend(c, i) - self.base[c]


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of token sequences, with the intervals' parents."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, longest: int):
        s = SuffixArray(ids, longest)
        sa = s.sa
        self.n = len(sa)
        self.lcp = s.lcp()
        self.bwt = WaveletMatrix(np.where(sa > 0, ids[sa - 1], 0).astype(np.int64), s.bits)
        head = ids[sa]
        self.start = np.searchsorted(head, np.arange((1 << s.bits) + 1))
        # a token that ends its sequence sorts before the same token followed by another
        self.first = self.start[:-1] + np.bincount(ids[sa[s.left[sa] == 1]], minlength=1 << s.bits)
        own = owner[sa]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if self.n else np.zeros(0, int)
        ends = np.append(new[1:], self.n)
        self.other = np.append(np.repeat(ends, np.diff(np.append(new, self.n))), self.n)  # next suffix of another owner
        self.before, self.after = previous_smaller(self.lcp), next_smaller(self.lcp)

    def matching_statistics(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each token of the sequences, the longest match from there on that occurs with two owners.

        All sequences advance from right to left together; a sequence whose match can't
        be extended moves to its interval's parent and tries again.
        """
        out = np.zeros(len(flat), np.int64)
        t = start + size - 1
        lane = np.flatnonzero(size > 0)
        lo, hi, length = np.zeros(len(start), np.int64), np.full(len(start), self.n), np.zeros(len(start), np.int64)
        while len(lane):
            c, a, b, k = flat[t[lane]], lo[lane], hi[lane], length[lane]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([a, b]))
            f = self.first[c]
            x = np.where(k == 0, self.start[c], f + both[: len(lane)])
            y = np.where(k == 0, self.start[c + 1], f + both[len(lane) :])
            ok = (x < y) & (self.other[np.minimum(x, self.n)] < y)
            done = ok | (k == 0)
            d = np.maximum(self.lcp[a], self.lcp[b])
            up = np.where(self.lcp[a] == d, self.before[a], a)
            down = np.where(self.lcp[b] == d, self.after[b], b)
            root = d == 0
            lo[lane] = np.where(ok, x, np.where(root, 0, up))
            hi[lane] = np.where(ok, y, np.where(root, self.n, down))
            k = np.where(ok, k + 1, np.where(root, 0, d))
            length[lane] = k
            out[t[lane[done]]] = k[done]
            t[lane[done]] -= 1
            lane = lane[t[lane] >= start[lane]]
        return out
