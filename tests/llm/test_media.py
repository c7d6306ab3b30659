"""PNG decoding against a filter-by-filter reference, checksums, and hashes against the cosine sum."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from gyeol.llm import media


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(rows, width, depth, color, filters, palette=None, parts=1, lace=0):
    """A PNG of raw rows (height, bytes) with the given filter of each row."""
    step = max(1, depth * media.CHANNELS[color] // 8)
    out, above = b"", np.zeros(rows.shape[1], int)
    for line, f in zip(rows.astype(int), filters):
        left = np.concatenate([np.zeros(step, int), line[:-step]])[: len(line)]
        corner = np.concatenate([np.zeros(step, int), above[:-step]])[: len(line)]
        guess = [np.zeros_like(line), left, above, (left + above) // 2, np.array([paeth(*x) for x in zip(left, above, corner)])][f]
        out += bytes([f]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    z = zlib.compress(out)
    cuts = [z[i * len(z) // parts : (i + 1) * len(z) // parts] for i in range(parts)]
    head = struct.pack(">IIBBBBB", width, len(rows), depth, color, 0, 0, lace)
    return media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"gAMA", b"\0\0\0\1") + (chunk(b"PLTE", palette) if palette else b"") + b"".join(chunk(b"IDAT", c) for c in cuts) + chunk(b"IEND", b"")


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


@pytest.mark.parametrize("color,depth", [(c, d) for c, ds in media.DEPTHS.items() for d in ds])
def test_every_format(color, depth):
    r = np.random.default_rng(color * 20 + depth)
    files, want = [], []
    for width, height in ((1, 1), (7, 5), (33, 12), (40, 3)):
        rows = r.integers(0, 256, (height, -(-width * depth * media.CHANNELS[color] // 8)), dtype=np.uint8)
        pal = r.integers(0, 256, (256, 3), dtype=np.uint8)
        files.append(png(rows, width, depth, color, r.integers(0, 5, height), pal.tobytes() if color == 3 else None, parts=min(3, height)))
        want.append(rows)
    got = media.hashes(files)
    assert [g[0] for g in got] == ["ok"] * 4 and [(g[1].width, g[1].height) for g in got] == [(1, 1), (7, 5), (33, 12), (40, 3)]
    images = [media.Image(f).passes[0] for f in files]
    for rows, w in zip(media.unfilter(images), want):
        assert np.array_equal(rows, w)


@pytest.mark.parametrize("color,depth,width,height", [(0, 8, 13, 9), (2, 8, 21, 17), (0, 1, 30, 11), (6, 16, 9, 12), (3, 4, 19, 8), (0, 8, 1, 1), (0, 8, 3, 2)])
def test_interlaced(color, depth, width, height):
    """The seven passes put together are the image that a plain file of the same pixels has."""
    r = np.random.default_rng(width)
    bits = depth * media.CHANNELS[color]
    px = r.integers(0, 2, (height, width, bits), dtype=np.uint8)
    pal = r.integers(0, 256, (256, 3), dtype=np.uint8).tobytes() if color == 3 else None
    pack = lambda p: np.packbits(p.reshape(len(p), -1), axis=1)
    plain = png(pack(px), width, depth, color, r.integers(0, 5, height), pal)
    stream = b""
    for dx, dy, x, y in media.PASSES:
        part = px[y::dy, x::dx]
        if part.size:
            one = png(pack(part), part.shape[1], depth, color, r.integers(0, 5, len(part)), pal)
            at = one.index(b"IDAT")
            stream += zlib.decompress(one[at + 4 : at + 4 + struct.unpack(">I", one[at - 4 : at])[0]])
    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 1)
    laced = media.SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", pal) if pal else b"") + chunk(b"IDAT", zlib.compress(stream)) + chunk(b"IEND", b"")
    a, b = media.hashes([plain, laced])
    assert a[0] == b[0] == "ok" and a[2] == b[2] and (b[1].width, b[1].height) == (width, height)


def test_tall_images_take_memory_in_proportion():
    """Rows are undone in bands: 5 MB of text, 40,000 rows."""
    import tracemalloc

    text = np.random.default_rng(1).integers(32, 127, 5_000_000, dtype=np.uint8)
    tracemalloc.start()
    (data,) = media.encode_grey([text])
    ((status, image, _),) = media.hashes([data])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert status == "ok" and image.height == 39_063 and peak < 120e6
    assert np.array_equal(media.unfilter(media.Image(data).passes)[0].ravel()[: len(text)], text)


def test_hash_is_the_low_cosine_transform():
    r = np.random.default_rng(3)
    image = r.integers(0, 256, (50, 70)).astype(float)

    def area(n):
        m = np.zeros((32, n))
        for i in range(32):
            for j in range(n):
                m[i, j] = max(0, min((i + 1) * n / 32, j + 1) - max(i * n / 32, j)) / (n / 32)
        return m

    small = area(50) @ image @ area(70).T
    c = np.array([[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    assert media.phash(image) == np.packbits(c > np.median(c[1:])).tobytes()
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    assert bits(media.phash(image), media.phash(image + r.normal(0, 2, image.shape))) <= 6 < bits(media.phash(image), media.phash(r.integers(0, 256, (50, 70)).astype(float)))


def test_broken_files():
    rows = np.arange(60, dtype=np.uint8).reshape(6, 10)
    good = png(rows, 10, 8, 0, [0, 1, 2, 3, 4, 0])
    at = good.index(b"IDAT")
    flip = lambda i: good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]
    head = lambda **k: media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", *({"w": 10, "h": 6, "d": 8, "c": 0, "m": 0, "f": 0, "l": 0} | k).values()))
    rest = good[good.index(b"gAMA") - 4 :]
    stream = zlib.compress(b"".join(b"\0" + x.tobytes() for x in rows))
    body = lambda z: chunk(b"IDAT", z) + chunk(b"IEND", b"")
    cases = {
        "signature": b"GIF89a", "chunk": good[:-20], "crc": flip(at + 6), "header": head(d=3) + rest, "size": head(h=5) + rest,
        "zlib": head() + body(stream[:-1] + bytes([stream[-1] ^ 1])), "filter": head() + body(zlib.compress(b"".join(b"\7" + x.tobytes() for x in rows))),
    }
    assert {k: media.hashes([v])[0][0] for k, v in cases.items()} == {k: k for k in cases}
    assert media.hashes([head() + body(stream[:-3])])[0][0] == "zlib" and media.hashes([head(h=7) + rest])[0][0] == "size"
    assert [g[0] for g in media.hashes([None, good, b""])] == ["null", "ok", "signature"]


def test_text_round_trip_and_edge_cases(spark):
    long = "some ünusual text " * 9000
    rows = [(1, "hello world " * 40, "x"), (2, "", "y"), (3, None, "z"), (None, "text", None), (4, long, "l"), (1, "hello world " * 40, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, status string")
    files = media.render(docs)
    for r in files.where("png is not null").collect():
        im = media.Image(bytes(r["png"]))
        data = b"".join(x.tobytes() for x in media.unfilter(im.passes)[0])
        text = {2: "", None: "text", 1: rows[0][1], 4: long}[r["doc_id"]].encode()
        assert data == text.ljust(im.width * im.height, b"\0") and im.height == max(1, -(-len(text) // 128))
    got = sorted(((r["doc_id"] or 0, r["status"], r["width"], r["height"]) for r in media.media_hashes(files).collect()), key=str)
    assert got == sorted([(0, "ok", 128, 1), (1, "ok", 128, 4), (1, "ok", 128, 4), (2, "ok", 128, 1), (3, "null", None, None), (4, "ok", 128, -(-len(long.encode()) // 128))], key=str)
    assert media.media_hashes(media.render(docs.where("false"))).count() == 0
