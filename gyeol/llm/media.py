"""Media columns: PNG decoding and perceptual hashes (operator 1).

``decode`` reads PNG from a binary column: signature, chunks with their CRC, the
zlib stream with its Adler checksum, and the five row filters, undone in numpy.
Left, upper and upper-left neighbours are needed, so pixels of equal x + y are
undone together, over all images of similar size at once, in bands of ``BAND`` rows:
memory grows with the image, not with the square of its height.  The seven passes of
an interlaced image are undone one by one.

The hash takes the 8 x 8 lowest frequencies of the cosine transform of the image
scaled to 32 x 32 by area (both are one matrix product from each side) and sets a
bit where a coefficient exceeds the median of all but the first: 8 bytes.

Colour types 0, 2, 3, 4 and 6 with 1 to 16 bits are read; alpha is ignored.

Defined cases (``status``): 'null' for a null value; 'signature', 'chunk'
(truncated, out of order), 'crc', 'header' (impossible values), 'zlib' (broken
stream or checksum), 'size' (too few or too many bytes) and 'filter' (unknown row
filter) have null sizes and hash.  ``render`` turns text into a grey image of its
bytes: null stays null, empty text is one black row, and a text of any length is drawn
whole.  Rows are independent, so repeated rows and ids give equal rows, ids may be null,
an empty table gives none, and other columns don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcore import buffers

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
WIDTH, SCALE, LOW = 128, 32, 8
#: Bytes of pixels whose filters are undone together, and rows of an image.
GROUP, BAND = 400_000, 256
#: Width and height of the pixels' grid, and first column and row, of the passes of an interlaced image.
PASSES = ((8, 8, 0, 0), (8, 8, 4, 0), (4, 8, 0, 4), (4, 4, 2, 0), (2, 4, 0, 2), (2, 2, 1, 0), (1, 2, 0, 1))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc_ = np.abs(b - c), np.abs(a - c), np.abs(a + b - c - c)
    return np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))


def filtered(rows: np.ndarray, first: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """What ``_filtered`` gives, ``step`` rows at once."""
    kinds, bodies = [np.zeros(0, np.uint8)], [rows[:0]]
    for a in range(0, len(rows), step):
        lead = min(a, 1)  # the row above comes along
        own = first[(first >= a - lead) & (first < a + step)] - (a - lead)
        kind, body = _filtered(rows[a - lead : a + step], own)
        kinds.append(kind[lead:])
        bodies.append(body[lead:])
    return np.concatenate(kinds), np.concatenate(bodies)


def _filtered(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filter of each row, filtered rows) of grey rows, by the least sum of absolute differences; first: rows that start an image."""
    x = rows.astype(np.int16)
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    up[first] = 0
    left, corner = np.zeros_like(x), np.zeros_like(x)
    left[:, 1:] = x[:, :-1]
    corner[:, 1:] = up[:, :-1]
    best, kind, cost = rows.copy(), np.zeros(len(rows), np.uint8), np.abs(rows.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
    for k, guess in ((1, left), (2, up), (3, (left + up) >> 1), (4, _paeth(left, up, corner))):
        y = (x - guess).astype(np.uint8)
        c = np.abs(y.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        better = c < cost
        best[better], kind[better], cost[better] = y[better], k, c[better]
    return kind, best


def encode_grey(texts: list[np.ndarray], width: int = WIDTH) -> list[bytes]:
    """PNG files of byte arrays, ``width`` pixels to a row."""
    heights = np.array([max(1, -(-len(t) // width)) for t in texts])
    ends = np.cumsum(heights)
    flat = np.zeros(int(ends[-1]) * width if len(texts) else 0, np.uint8)
    for t, e, h in zip(texts, ends, heights):
        flat[(e - h) * width : (e - h) * width + len(t)] = t
    kind, body = filtered(flat.reshape(-1, width), ends - heights)
    stream = np.concatenate([kind[:, None], body], axis=1)
    out = []
    for e, h in zip(ends.tolist(), heights.tolist()):
        head = struct.pack(">IIBBBBB", width, h, 8, 0, 0, 0, 0)
        out.append(SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(stream[e - h : e].tobytes(), 1)) + _chunk(b"IEND", b""))
    return out


class Image:
    """A parsed PNG whose filters aren't undone yet."""

    def __init__(self, data: bytes):
        self.status = self._parse(data)

    def _parse(self, data: bytes) -> str:
        if data[:8] != SIGNATURE:
            return "signature"
        at, idat, self.palette, head, ended = 8, [], None, None, False
        while at < len(data) and not ended:
            if at + 12 > len(data):
                return "chunk"
            (n,) = struct.unpack_from(">I", data, at)
            kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
            if at + 12 + n > len(data) or (head is None) != (kind == b"IHDR"):
                return "chunk"
            if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
                return "crc"
            if kind == b"IHDR":
                if n != 13:
                    return "header"
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                self.palette = np.frombuffer(body[: n - n % 3], np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                idat.append(body)
            ended = kind == b"IEND"
            at += 12 + n
        if not ended or not idat:
            return "chunk"
        self.width, self.height, self.depth, self.color, method, filters, lace = head
        if not self.width or not self.height or self.depth not in DEPTHS.get(self.color, ()) or method or filters or lace > 1 or (self.color == 3 and self.palette is None):
            return "header"
        bits = self.depth * CHANNELS[self.color]
        self.step, self.row = max(1, bits // 8), -(-self.width * bits // 8)
        grids = PASSES if lace else ((1, 1, 0, 0),)
        sizes = [(-(-(self.width - x) // dx), -(-(self.height - y) // dy)) for dx, dy, x, y in grids]
        self.passes = [Pass(self, w, h, -(-w * bits // 8), g) for (w, h), g in zip(sizes, grids) if w > 0 and h > 0]
        d = zlib.decompressobj()
        want = sum((p.row + 1) * p.height for p in self.passes)
        try:
            raw = d.decompress(b"".join(idat), want + 1)
        except zlib.error:
            return "zlib"
        if len(raw) == want and not d.eof:
            try:
                raw += d.decompress(d.unconsumed_tail, 1)
            except zlib.error:
                return "zlib"
        if len(raw) != want:
            return "size" if d.eof or len(raw) > want else "zlib"
        if not d.eof:
            return "zlib"
        at = 0
        for p in self.passes:
            size = (p.row + 1) * p.height
            lines = np.frombuffer(raw, np.uint8, size, at).reshape(p.height, p.row + 1)
            p.filters, p.lines = lines[:, 0], lines[:, 1:]
            at += size
        return "filter" if any((p.filters > 4).any() for p in self.passes) else "ok"


class Pass:
    """The rows of an image, or of one pass of an interlaced one."""

    def __init__(self, image: Image, width: int, height: int, row: int, grid: tuple[int, int, int, int]):
        self.image, self.width, self.height, self.row, self.grid, self.step = image, width, height, row, grid, image.step


def unfilter(images: list[Pass]) -> list[np.ndarray]:
    """The rows of images of equal step, with the filters undone."""
    step = images[0].step
    tall, wide = max(i.height for i in images), -(-max(i.row for i in images) // step)
    out = [np.zeros((i.height, -(-i.row // step) * step), np.uint8) for i in images]
    above = np.zeros((len(images), wide, step), np.int16)  # the last row of the band before
    for top in range(0, tall, BAND):
        live = [k for k, im in enumerate(images) if im.height > top]
        block = _band([images[k] for k in live], top, min(BAND, tall - top), wide, above[live])
        for n, k in enumerate(live):
            got = block[n, : images[k].height - top].reshape(-1, wide * step)
            out[k][top : top + len(got)] = got[:, : out[k].shape[1]]
        above[live] = block[:, -1]
    return [o[:, : im.row] for o, im in zip(out, images)]


def _band(images: list[Pass], top: int, high: int, wide: int, above: np.ndarray) -> np.ndarray:
    """(image, y, x, byte of the pixel) of the rows from top on, below the rows ``above``."""
    step, steps = above.shape[2], high + wide - 1
    # (x + y, image, y, byte of the pixel)
    raw = np.zeros((steps, len(images), high, step), np.int16)
    kind = np.zeros((len(images), high, 1), np.int16)
    block = np.zeros((len(images), high, wide * step), np.uint8)
    for k, im in enumerate(images):
        rows = im.lines[top : top + high]
        kind[k, : len(rows), 0] = im.filters[top : top + high]
        block[k, : len(rows), : im.row] = rows
    block = block.reshape(len(images), high, wide, step)
    for y in range(high):
        raw[y : y + wide, :, y] = block[:, y].transpose(1, 0, 2)
    one, two, three, four = (kind == k for k in (1, 2, 3, 4))
    zero = np.zeros_like(raw[0])
    before = last = zero
    up, corner = zero.copy(), zero.copy()
    some3, some4 = three.any(), four.any()
    for d in range(steps):
        up[:, 1:], corner[:, 1:] = last[:, :-1], before[:, :-1]
        up[:, 0] = above[:, d] if d < wide else 0
        corner[:, 0] = above[:, d - 1] if 0 < d <= wide else 0
        guess = last * one + up * two
        if some3:
            guess += ((last + up) >> 1) * three
        if some4:
            guess += _paeth(last, up, corner) * four
        now = (raw[d] + guess) & 255
        # pixels left of the image stay zero, as the format has it
        if d < high - 1:
            now[:, d + 1 :] = 0
        raw[d] = now
        before, last = last, now
    for y in range(high):
        block[:, y] = raw[y : y + wide, :, y].transpose(1, 0, 2)
    return block


def grey(part: Pass, rows: np.ndarray) -> np.ndarray:
    """(rows, width) brightness from 0 to 255."""
    im, high = part.image, len(rows)
    n = CHANNELS[im.color]
    if im.depth == 16:
        px = rows.reshape(high, part.width, n, 2)[..., 0]
    elif im.depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : part.width * im.depth].reshape(high, part.width, im.depth)
        px = (bits @ (1 << np.arange(im.depth)[::-1]))[..., None]
    else:
        px = rows.reshape(high, part.width, n)
    if im.color == 3:
        px = im.palette[np.minimum(px[..., 0], len(im.palette) - 1)] if len(im.palette) else np.zeros((*px.shape[:2], 3))
    elif im.depth < 8:
        px = px * (255 // ((1 << im.depth) - 1))
    if px.shape[-1] >= 3:
        return (px[..., 0] * 299.0 + px[..., 1] * 587.0 + px[..., 2] * 114.0) / 1000.0
    return px[..., 0].astype(float)


def transform(n: int) -> np.ndarray:
    """(LOW, n): scale n pixels to SCALE by area, then the lowest cosine frequencies."""
    return _transform(n) if n <= 4096 else _transform.__wrapped__(n)


@lru_cache(maxsize=1024)
def _transform(n: int) -> np.ndarray:
    edges = np.arange(SCALE + 1) * (n / SCALE)
    lo, hi = np.arange(n), np.arange(1, n + 1)
    area = np.stack([np.clip(np.minimum(b, hi) - np.maximum(a, lo), 0, None) / (n / SCALE) for a, b in zip(edges, edges[1:])])
    k, i = np.arange(LOW)[:, None], np.arange(SCALE)
    return np.cos(np.pi * k * (2 * i + 1) / (2 * SCALE)) @ area


def _bits(c: np.ndarray) -> bytes:
    c = np.round(c, 4).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes()


def phash(image: np.ndarray) -> bytes:
    return _bits(transform(image.shape[0]) @ image @ transform(image.shape[1]).T)


def _hash(im: Image, rows: list[np.ndarray]) -> bytes:
    """The hash of an image from the rows of its passes."""
    if len(im.passes) == 1 and im.passes[0].grid == (1, 1, 0, 0):
        down, across = transform(im.height), transform(im.width)
        c = np.zeros((LOW, im.width))
        block = max(1, GROUP // im.width)
        for a in range(0, im.height, block):
            c += down[:, a : a + block] @ grey(im.passes[0], rows[0][a : a + block])
        return _bits(c @ across.T)
    image = np.zeros((im.height, im.width))
    for p, r in zip(im.passes, rows):
        dx, dy, x, y = p.grid
        image[y::dy, x::dx] = grey(p, r)
    return phash(image)


def hashes(files: list[bytes | None]) -> list[tuple[str, Image | None, bytes | None]]:
    """(status, image, hash) of each file."""
    out: list = [None] * len(files)
    groups: dict[int, list[tuple[int, int, int, Pass]]] = {}
    for k, data in enumerate(files):
        if data is None:
            out[k] = ("null", None, None)
            continue
        im = Image(data)
        if im.status != "ok":
            out[k] = (im.status, None, None)
        elif len(im.passes) == 1:
            p = im.passes[0]
            groups.setdefault(p.step, []).append((p.row, p.height, k, p))
        else:
            out[k] = ("ok", im, _hash(im, [unfilter([p])[0] for p in im.passes]))
            im.passes = None
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
        a = 0
        while a < len(members):
            b, wide, high = a, members[a][0], 0
            while b < len(members) and (b == a or (members[b][0] == wide and max(high, members[b][1]) * wide * (b - a + 1) <= GROUP and members[b][1] <= 8 + members[a][1] * 5 // 4)):
                high = max(high, members[b][1])
                b += 1
            part = members[a:b]
            for (_, _, k, p), rows in zip(part, unfilter([m[3] for m in part])):
                out[k] = ("ok", p.image, _hash(p.image, [rows]))
                p.image.passes = None
            a = b
    return out


def render(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, png: each text's bytes as a grey image."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(1))
            valid = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            a = 0
            while a < b.num_rows:
                c = min(b.num_rows, max(a + 1, int(np.searchsorted(off, off[a] + (1 << 19), "right")) - 1))
                png = encode_grey([data[off[i] : off[i + 1]] for i in range(a, c)], width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, c - a), pa.array([p if ok else None for p, ok in zip(png, valid[a:c])], pa.binary())], ["doc_id", "png"])
                a = c

    return docs.mapInArrow(run, f"doc_id {kind}, png binary")


def media_hashes(media: DataFrame, key: str = "doc_id", column: str = "png") -> DataFrame:
    """key, status, width, height, bit_depth, color_type, phash (binary) of every row."""
    media = media.select(key, column)
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                got = hashes(part.column(1).to_pylist())
                cols = [pa.array([getattr(g[1], n) if g[1] else None for g in got], pa.int32()) for n in ("width", "height", "depth", "color")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), *cols, pa.array([g[2] for g in got], pa.binary())], [key, "status", "width", "height", "bit_depth", "color_type", "phash"])

    return media.mapInArrow(run, f"{key} {kind}, status string, width int, height int, bit_depth int, color_type int, phash binary")
