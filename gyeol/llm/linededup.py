"""Line dedup by a deletion-neighbourhood join (operator 10).

A line is a repeat if an earlier line, by (doc_id, line number), is within
``MAX_EDITS`` = 1 edits of it (insert, delete or replace a character).  Lines are
trimmed of ASCII white space.  Every line that isn't empty then takes part; only
for the one edit both lines must have at least ``NEAR_CHARS`` characters.

Equal lines meet in one aggregation by hash.  For distinct lines, any edit lies
in one half, so the other half is equal: lines are keyed by each half (for either
length of the pair), and only lines that share a key go on, with their text, to
the join.  There, every variant with one character deleted (in the half that may
differ) is emitted as a hashed key, and equal variants are joined:

* lines of equal length are one replacement apart if they agree after deleting
  the same position;
* a line is one insertion apart from another if deleting a position gives it.

All lines that agree on such a key are within the bound of each other, so the
earliest line of a key is the witness of all and no list of pairs is made.  Distinct
lines with one variant are at most as many as there are characters to put back, so no
key is hot, however many lines share a half.  The edit distance to the witness is then
verified on the texts.

Plan: documents are read once for the table of lines, which is written, and once for
the text of the lines that share a half.

Defined cases: rows without doc_id or text take no part (and stay as they are).
Rows with equal doc_id and text are one document; texts that share a doc_id are
documents of their own, in the order of their hashes (``h``, which ``with_h`` returns
and ``drop_lines`` needs if ids repeat).  Of ties, the lowest doc_id, text hash and
line number stays.  Columns are taken by name; a null in any other changes nothing.
Lines and texts of any length are compared whole; an empty table has no repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, keyed, written
from .decontam import with_text
from .textcore import _SPACE, Hasher, characters, chunks, mix, spans

#: Characters that both lines of a pair must have for the one edit.
NEAR_CHARS, MAX_EDITS = 4, 1
#: Characters of lines whose variants are made at once; a longer line stands alone.
VARIANTS = 1_000_000
#: Keys of documents (8 bytes each) that are sent to all tasks as a filter; of more, all documents are shuffled.
PREFILTER = 4_000_000


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, line number in the row) of the non-empty lines, trimmed."""
    s, e, row = spans(data != 10, off)
    if not len(s):
        return s, e, row, row
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    number = breaks[s] - breaks[off[row]]
    solid = np.flatnonzero(~_SPACE[data])
    a, b = np.searchsorted(solid, s), np.searchsorted(solid, e)
    some = b > a
    s, e, row, number = solid[a[some]], solid[b[some] - 1] + 1, row[some], number[some]
    return s, e, row, number


def half_keys(data: np.ndarray, s: np.ndarray, e: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Keys of the lines: (head, tail) for pairs whose shorter line has n characters, then n - 1."""
    hasher = Hasher(data)
    first = np.flatnonzero(characters(data))
    at = np.searchsorted(first, s)
    bounds = np.append(first, len(data))
    out = []
    for shorter in (n, n - 1):
        half = shorter // 2
        head_end = bounds[at + half]
        tail_start = bounds[at + n - (shorter - half)]
        with np.errstate(over="ignore"):
            tag = shorter.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out += [mix(hasher(s, head_end) ^ tag), mix(hasher(tail_start, e) ^ mix(tag + np.uint64(1)))]
    return out


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, h (of the text), line, n, lh (of the line) and the four half keys of each line that counts."""
    docs = keyed(docs, "text").withColumn("h", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, _, data, off in chunks(b.column(1)):
                s, e, row, number = lines(data, off)
                pos = np.zeros(len(data) + 1, np.int64)
                np.cumsum(characters(data), out=pos[1:])
                n = pos[e] - pos[s]
                ok = n >= min_chars
                s, e, row, number, n = s[ok], e[ok], row[ok], number[ok], n[ok]
                at = pa.array(a + row)
                arrays = [b.column(0).take(at), b.column(2).take(at), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32))]
                keys = [Hasher(data)(s, e), *half_keys(data, s, e, n)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(k.view(np.int64)) for k in keys], ["doc_id", "h", "line", "n", "lh", "k0", "k1", "k2", "k3"])
        give_back()

    return docs.mapInArrow(run, f"doc_id {kind}, h long, line int, n int, lh long, k0 long, k1 long, k2 long, k3 long")


_BASE = 0xD1342543DE82EF95
HEAD, TAIL, WHOLE = 1, 2, 16


def _powers(n: int) -> np.ndarray:
    """The first n + 1 powers of the base modulo 2**64."""
    p = np.full(n + 1, _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def variants(text: list[np.ndarray], flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed key, line, kind) of the lines' variants; lines are code point arrays.

    Kind 0: without the character at a position, keyed with the position; 1: without it, keyed alone; 2: the whole line.
    flag: HEAD or TAIL is equal to that of a line of equal length; 4 times as much: of a shorter one; WHOLE: to that of a longer one.
    """
    n = np.array([len(t) for t in text])
    off = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate(text)
    with np.errstate(over="ignore"):
        powers = _powers(int(n.max()))
        line = np.repeat(np.arange(len(n)), n)
        p = np.arange(len(flat)) - off[line]
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat.astype(np.uint64) + np.uint64(1)) * powers[p], out=sums[1:])
        at = off[line] + p
        short = mix(sums[at] - sums[off[line]] + (sums[off[line] + n[line]] - sums[at + 1]) * inverse)
        whole = mix(sums[off[1:]] - sums[off[:-1]])
        by_place = mix(short + mix((p + 1).astype(np.uint64)))
    half, less, f = (n // 2)[line], ((n - 1) // 2)[line], flag[line]
    same = ((f & HEAD) > 0) & (p >= half) | ((f & TAIL) > 0) & (p < half)
    longer = ((f & 4 * HEAD) > 0) & (p >= less) | ((f & 4 * TAIL) > 0) & (p <= less)
    alone = np.flatnonzero(flag & WHOLE)
    kinds = np.repeat(np.array([0, 1, 2], np.int8), [same.sum(), longer.sum(), len(alone)])
    return np.concatenate([by_place[same], short[longer], whole[alone]]), np.concatenate([line[same], line[longer], alone]), kinds


def within_one_edit(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    differ = np.flatnonzero(x != y[: len(x)])
    p = int(differ[0]) if len(differ) else len(x)
    return np.array_equal(x[p + (len(x) == len(y)) :], y[p + 1 :])


def shared_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """lh, n, flag (see ``variants``), f (the earliest place) and text of the distinct lines that share a half with another."""
    keys = F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("key"), (F.col("n") - i // 2).alias("shorter"), F.lit(i).alias("i")) for i in range(4)]))
    split = first.select("lh", "n", "f", keys.alias("k")).select("lh", "n", "f", "k.*")
    w = Window.partitionBy("key", "shorter")
    is_short = F.col("n") == F.col("shorter")
    split = split.withColumn("short", F.count(F.when(is_short, 1)).over(w)).withColumn("longer", F.count(F.when(~is_short, 1)).over(w))
    side = F.when(F.col("i") % 2 == 0, HEAD).otherwise(TAIL)
    flag = F.when(is_short, F.when(F.col("short") > 1, side).otherwise(0) + F.when(F.col("longer") > 0, WHOLE).otherwise(0)).otherwise(F.when(F.col("short") > 0, side * 4).otherwise(0))
    wanted = split.withColumn("flag", flag.cast("int")).where("flag > 0").groupBy("lh", "n", "f").agg(F.bit_or("flag").alias("flag"))
    wanted = written(wanted)
    own = keyed(docs, "text")
    few = wanted.select(F.xxhash64("f.doc_id", "f.h").alias("key")).distinct()
    if few.count() <= PREFILTER:  # other documents needn't be shuffled
        own = own.join(F.broadcast(few), F.xxhash64("doc_id", F.xxhash64("text")) == F.col("key"), "left_semi")
    by_doc = wanted.groupBy(F.col("f.doc_id").alias("of_doc"), F.col("f.h").alias("of_h")).agg(F.collect_list(F.struct(F.col("f.line").alias("line"), "lh", "n", "flag")).alias("wanted"))
    with_line = own.join(by_doc, (own["doc_id"] == F.col("of_doc")) & (F.xxhash64(own["text"]) == F.col("of_h"))).select("doc_id", "of_h", "wanted", "text").dropDuplicates(["doc_id", "of_h"])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per = b.column(2)
            ends = per.offsets.to_numpy().astype(np.int64)
            w = per.values
            number = w.field(0).to_numpy().astype(np.int64)
            for a, c, data, off in chunks(b.column(3)):
                s, e, r, no = lines(data, off)
                sel = np.arange(ends[a], ends[c])
                row = np.repeat(np.arange(c - a), np.diff(ends[a : c + 1]))
                at = np.searchsorted((r << 32) + no, (row << 32) + number[sel])
                text = pa.array([data[x:y].tobytes().decode() for x, y in zip(s[at], e[at])], pa.string())
                pick, own_row = pa.array(sel), pa.array(a + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own_row), b.column(1).take(own_row), *(w.field(k).take(pick) for k in range(4)), text], ["doc_id", "h", "line", "lh", "n", "flag", "text"])

    cut = with_line.mapInArrow(cut_lines, f"doc_id {kind}, h long, line int, lh long, n int, flag int, text string")
    return cut.select("lh", "n", "flag", F.struct("doc_id", "h", "line").alias("f"), "text")


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """lh, n and near (doc_id, h, line) of the earliest other line within one edit, for distinct lines that have an earlier one."""
    texts = written(shared_lines(docs, first))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in b.column(3).to_pylist()]
            size = np.cumsum([len(t) for t in text])
            flag, a = b.column(2).to_numpy().astype(np.int64), 0
            while a < b.num_rows:
                c = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + VARIANTS, "right")))
                key, line, what = variants(text[a:c], flag[a:c])
                take = pa.array(a + line)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(what), *(b.column(k).take(take) for k in (0, 1)), *(b.column(k).take(take) for k in (4, 5, 6))], ["key", "kind", "lh", "n", "doc_id", "h", "line"])
                a = c
        give_back()

    flat = texts.select("lh", "n", "flag", "text", "f.doc_id", "f.h", "f.line")
    made = flat.mapInArrow(emit, f"key long, kind byte, lh long, n int, doc_id {kind}, h long, line int").select("key", "kind", "lh", "n", F.struct("doc_id", "h", "line").alias("f"))
    w = Window.partitionBy("key")
    least = [F.min(F.when(F.col("kind") == k, F.struct("f", "lh", "n"))).over(w) for k in range(3)]
    to = F.when(F.col("kind") == 0, least[0]).when(F.col("kind") == 1, least[2]).otherwise(least[1])
    found = made.withColumn("to", to).where(F.col("to.f") < F.col("f")).select("lh", "n", F.col("to.f").alias("near"), F.col("to.lh").alias("to_lh"), F.col("to.n").alias("to_n")).distinct()
    mine, other = texts.select("lh", "n", F.col("text").alias("x")), texts.select(F.col("lh").alias("to_lh"), F.col("n").alias("to_n"), F.col("text").alias("y"))

    @F.arrow_udf("boolean")
    def verified(x: pa.Array, y: pa.Array) -> pa.Array:
        points = lambda t: np.frombuffer(t.as_py().encode("utf-32-le"), np.uint32)
        return pa.array([within_one_edit(points(p), points(q)) for p, q in zip(x, y)], pa.bool_())

    sure = found.join(mine, ["lh", "n"]).join(other, ["to_lh", "to_n"]).where(verified("x", "y"))
    return sure.groupBy("lh", "n").agg(F.min("near").alias("near"))


def repeated_lines(docs: DataFrame, min_chars: int = 1, near_chars: int = NEAR_CHARS, with_h: bool = False) -> DataFrame:
    """doc_id and line of each repeat, with the earliest line it repeats (kept_doc, kept_line) and their edit distance."""
    table = written(line_table(docs, min_chars))
    place = F.struct("doc_id", "h", "line")
    first = written(table.groupBy("lh", "n").agg(F.min(place).alias("f"), F.count("*").alias("copies"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)]))
    near = near_lines(docs, first.where(F.col("n") >= near_chars))
    decided = first.select("lh", "n", "f", "copies").join(near, ["lh", "n"], "left").where("copies > 1 or near is not null")
    keep = F.when(F.col("near").isNull(), F.col("f")).otherwise(F.least("f", "near"))
    decided = decided.select("lh", "n", keep.alias("keep"), F.when(keep == F.col("f"), 0).otherwise(1).alias("distance"))
    found = table.select("lh", "n", place.alias("own")).join(decided, ["lh", "n"]).where(F.col("keep") < F.col("own")).select(
        F.col("own.doc_id").alias("doc_id"), F.col("own.h").alias("h"), F.col("own.line").alias("line"), F.col("keep.doc_id").alias("kept_doc"), F.col("keep.line").alias("kept_line"), "distance"
    ).distinct()
    return found if with_h else found.drop("h")


def drop_lines(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """The documents without their repeated lines; one that has no other line left goes.

    repeats: with h, if a doc_id may have several texts.
    """
    keys = ["doc_id", "h"] if "h" in repeats.columns else ["doc_id"]
    gone = repeats.groupBy(*[F.col(k).alias(f"gone_{k}") for k in keys]).agg(F.collect_set("line").alias("gone_lines"))
    names = docs.columns
    at = names.index("text")
    inner = [f"c{i}" for i in range(len(names))]
    same = (F.col(f"c{names.index('doc_id')}") == F.col("gone_doc_id")) & F.col(f"c{at}").isNotNull()
    if "h" in keys:
        same = same & (F.xxhash64(f"c{at}") == F.col("gone_h"))
    both = docs.toDF(*inner).join(gone, same, "left").select(*inner, "gone_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, keep = [], [], np.ones(b.num_rows, bool)
            for i in np.flatnonzero(b.column(len(names)).is_valid().to_numpy(zero_copy_only=False)):
                text = b.column(at)[int(i)].as_py()
                drop = set(b.column(len(names))[int(i)].as_py())
                left = [x for k, x in enumerate(text.split("\n")) if k not in drop]
                rows.append(i)
                texts.append("\n".join(left))
                keep[i] = any(x.strip() for x in left)
            own = pa.RecordBatch.from_arrays(b.columns[: len(names)], names)
            out = with_text(own, np.array(rows, int), texts)
            yield pa.RecordBatch.from_arrays(out.filter(pa.array(keep)).columns, inner)
        give_back()

    return both.mapInArrow(run, both.drop("gone_lines").schema).toDF(*names)
