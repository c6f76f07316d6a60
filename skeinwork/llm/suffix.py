"""Removal of long repeated byte strings across a collection.

A byte goes if a string of `width` bytes that covers it also starts anywhere else.
Every window of that width has one anchor, the smallest hash among its 64-byte
substrings, which depends on nothing outside it, so equal windows share anchor and
alignment. Neighbouring windows with the same anchor form a segment. Equal segments
are summed before the shuffle (one group of copies may hold a third of all rows):
what occurs several times is repeated throughout, whatever else its anchor has, and
stands once for all its copies. Segments whose anchor hash occurs once need no further
look; distinct segments with one anchor hash go to the column-wise construction:

segments of a bucket lie aligned on their anchors; from the last column to the
first, one symbol of every segment is put before its suffix. The round's stable
sort by symbol gives the next suffix order (the symbols before it are that column of
the collection's Burrows-Wheeler transform), and neighbours' common prefixes become
one more than the least common prefix between their former places, or zero. A
window is repeated if a neighbour shares `width` symbols. Columns are read in their
sequence, some at a time, and orders, transforms and prefixes are only carried from
round to round.

A bucket with more than `hot` distinct segments, of a passage that many texts hold, is
split: a window reaches at least (width - anchor) / 2 bytes beyond its anchor on one
side, so windows are dealt anew by that side's bytes. What is crowded even then is
settled by 128-bit digests of its windows, summed before the shuffle.

Texts are told apart by their MD5, computed wherever it is needed, so nothing hangs
on the order in which a source gives its rows: equal texts have equal spans.

Defined cases: null text is empty; texts shorter than the width lose nothing;
overlapping occurrences count, in one text too; repeated rows and ids are texts of
their own, so an exact copy of at least `width` bytes goes whole; very long texts are cut
up in stretches, spans are joined before they are gathered by text; other columns are
carried along where the caller asks for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 400
ANCHOR = 64
SLAB = 1 << 19
HOT = 2_000
BUCKET_ROWS = 10_000
SEGMENT = "key long, digest binary, text_id binary, start long, n long, anchor long"
CUT_OUT = "key long, text_id binary, start long, n long, anchor long, bytes binary"
SPAN = "text_id binary, start long, stop long"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value, the last of equals, in each window of `width` values."""
    n = len(hashes)
    best, at = hashes.copy(), np.arange(n)
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        right = b <= a
        best = np.where(right, b, a)
        at = np.where(right, at[step:], at[: len(at) - step])
        size += step
    return at


def segments(raw: np.ndarray, off: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, key) of every segment; places count from the text's start."""
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(raw) < width:
        return empty
    sums = common.prefix_sums(common.BYTE_CODE[raw])
    places = np.arange(len(raw) - anchor + 1)
    keys = common.span_hash(sums, places, places + anchor)
    at = window_minima(keys, width - anchor + 1)
    starts = np.arange(len(at))
    owner = np.searchsorted(off, starts, side="right") - 1
    inside = starts + width <= off[owner + 1]
    starts, owner, at = starts[inside], owner[inside], at[inside]
    if not len(starts):
        return empty
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    s, o, m = starts[first], owner[first], at[first]
    return o, s - off[o], count, m - off[o], keys[m]


def stretches(raw: np.ndarray, off: np.ndarray, width: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """segments() of texts, of a long one in stretches of SLAB windows."""
    if len(off) != 2 or len(raw) <= 2 * SLAB:
        yield segments(raw, off, width, anchor)
        return
    for at in range(0, len(raw) - width + 1, SLAB):
        part = raw[at : at + SLAB + width - 1]
        o, start, n, m, key = segments(part, np.array([0, len(part)]), width, anchor)
        yield o, start + at, n, m + at, key


def columns(rows: list[np.ndarray], anchors: np.ndarray, left: int, right: int) -> Iterator[np.ndarray]:
    """The segments' columns, last first, one symbol of every segment each; 0 beyond a segment's ends."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    for at in range(0, left + right, 64):
        some = np.zeros((min(64, left + right - at), len(rows)), np.uint16)
        high = right - at
        for i, row in enumerate(rows):
            lo, hi = max(0, high - len(some) + anchors[i]), min(lengths[i], high + anchors[i])
            if lo < hi:
                some[high + anchors[i] - hi : high + anchors[i] - lo, i] = row[lo:hi][::-1].astype(np.uint16) + 1
        yield from some


def repeated_windows(rows: list[bytes], anchors: np.ndarray, counts: np.ndarray, buckets: np.ndarray, width: int) -> list[np.ndarray]:
    """Flags of each segment's windows that another segment of its bucket has at the same place.

    rows: the segments' bytes; anchors: the anchor's place in each; counts: windows.
    """
    n = len(rows)
    base = np.concatenate([[0], np.cumsum(counts)])
    flags = np.zeros(base[-1], bool)
    rows = [np.frombuffer(r, np.uint8) for r in rows]
    left, right = int(anchors.max()), int((np.fromiter(map(len, rows), np.int64, n) - anchors).max())
    order = np.argsort(buckets, kind="stable")
    ranked = np.unique(buckets, return_inverse=True)[1]
    group = ranked[order].astype(np.int64)
    common_len = np.zeros(n, np.int64)
    for column, symbols in zip(range(right - 1, -left - 1, -1), columns(rows, anchors, left, right), strict=True):
        symbol = symbols[order]
        key = group * 257 + symbol
        place = np.argsort(key, kind="stable")
        sorted_key = key[place]
        same = np.concatenate([[False], (sorted_key[1:] == sorted_key[:-1]) & (symbol[place[1:]] > 0)])
        fresh = np.zeros(n, np.int64)
        pairs = np.flatnonzero(same)
        if pairs.size:
            # least common prefix in (former place of the one above, own former place]
            spans = np.empty(2 * len(pairs), np.int64)
            spans[0::2], spans[1::2] = place[pairs - 1] + 1, place[pairs] + 1
            fresh[pairs] = np.minimum.reduceat(np.append(common_len, 0), spans)[0::2] + 1
        order, common_len = order[place], fresh
        group = group[place]
        enough = common_len >= width
        if enough.any():
            hit = enough | np.append(enough[1:], False)
            which = order[hit]
            window = anchors[which] + column
            ok = (window >= 0) & (window < counts[which])
            flags[base[which[ok]] + window[ok]] = True
    return np.split(flags, base[1:-1])


def spans_of(flags: np.ndarray, start: int, width: int) -> list[tuple[int, int]]:
    """The bytes covered by flagged windows, as [start, stop)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(start + int(a), start + int(b) - 1 + width) for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def named(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.unhex(F.md5(text)).alias("text_id"), text.alias("text"))


def find_repeats(texts: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """SPAN rows, apart from each other, of the bytes to remove from each text of (text_id, text binary)."""
    spark = texts.sparkSession
    anchor = min(ANCHOR, width)
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = common.store(df, name)
        folders.append(path)
        return out

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "text", SLAB):
            raw, off = common.utf8(part.column("text"))
            data, ids = memoryview(raw.tobytes()), part.column("text_id")
            for o, start, n, at, key in stretches(raw, off, width, anchor):
                low = off[o] + start
                digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), (low + n - 1 + width).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(key)), pa.array(digests, pa.binary()), ids.take(pa.array(o)), pa.array(start), pa.array(n), pa.array(at)], names(SEGMENT))

    found = keep(texts.mapInArrow(cut_up, SEGMENT), "segments")
    one = F.min(F.struct("text_id", "start", "n", "anchor")).alias("one")
    kinds = found.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("times"), one)
    keys = kinds.groupBy("key").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("kinds")).filter("times > 1")
    kinds = keep(kinds.join(keys.select("key", "kinds"), "key").select("key", "digest", "times", "kinds", "one.*"), "kinds")
    again = kinds.filter("times > 1").select("key", "digest")
    spans = [found.join(again, ["key", "digest"]).select("text_id", "start", (F.col("start") + F.col("n") - 1 + width).alias("stop"))]
    rest = kinds.filter("kinds > 1")
    total = rest.count()
    if total:
        # each distinct segment's bytes once, from one of the equal texts that hold it
        holders = texts.join(rest.select("text_id").distinct(), "text_id", "left_semi").groupBy("text_id").agg(F.first("text").alias("text"))
        cut_out = holders.join(rest, "text_id").select("key", "kinds", "text_id", "start", "n", "anchor", F.expr(f"substring(text, cast(start + 1 AS int), cast(n - 1 + {width} AS int))").alias("bytes"))
        cut_out = keep(cut_out, "cut-out")
        fields = names(CUT_OUT)
        own = construct(cut_out.filter(F.col("kinds") <= hot).select(*fields), total, width)
        crowded = cut_out.filter(F.col("kinds") > hot).select(*fields)
        if not crowded.isEmpty():
            sides = keep(by_side(crowded, width, anchor), "sides")
            some = sides.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
            sides = sides.join(some, "key")
            own = own.unionByName(construct(sides.filter(F.col("kinds") <= hot).select(*fields), total, width))
            own = own.unionByName(by_window(sides.filter(F.col("kinds") > hot).select(*fields), width))
        # a segment with copies is repeated throughout already; any other has one holder
        spans.append(own)
    out = common.cut(joined(_union(spans)), "spans")
    for path in folders:
        common.delete_folder(spark, path)
    common.free_shuffles(spark)
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def construct(cut_out: DataFrame, total: int, width: int) -> DataFrame:
    """SPAN rows of CUT_OUT rows, by the column-wise construction, some buckets a task."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        anchors = (t.column("anchor").to_numpy() - t.column("start").to_numpy()).astype(np.int64)
        flags = repeated_windows(t.column("bytes").to_pylist(), anchors, t.column("n").to_numpy(), t.column("key").to_numpy(), width)
        ids, starts = t.column("text_id").to_pylist(), t.column("start").to_pylist()
        out = [(r, a, b) for f, r, s in zip(flags, ids, starts, strict=True) if f.any() for a, b in spans_of(f, s, width)]
        if out:
            kinds = (pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names(SPAN))

    return cut_out.repartition(max(1, -(-total // BUCKET_ROWS)), "key").mapInArrow(build, SPAN)


def by_side(crowded: DataFrame, width: int, anchor: int) -> DataFrame:
    """CUT_OUT rows dealt anew: windows by the bytes before their anchor as far as all of them reach, or by those after it."""
    reach = (width - anchor) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                start, n, at, data = row["start"], row["n"], row["anchor"], row["bytes"]
                place = at - start
                # windows that begin at least `reach` before the anchor, and the others, which end so far after it
                before = min(n, max(0, place - reach + 1))
                for side, a, b in ((0, 0, before), (1, before, n)):
                    if a < b:
                        held = data[place - reach : place] if side == 0 else data[place + anchor : place + anchor + width - anchor - reach]
                        key = hashlib.blake2b(held, digest_size=8, key=bytes([side]) + row["key"].to_bytes(8, "little", signed=True)).digest()
                        out.append((int.from_bytes(key, "little", signed=True), row["text_id"], start + a, b - a, at, data[a : b - 1 + width]))
            if out:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names(CUT_OUT))

    return crowded.mapInArrow(run, CUT_OUT)


def by_window(crowded: DataFrame, width: int) -> DataFrame:
    """SPAN rows of CUT_OUT rows: windows whose digest two segments have."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, n = memoryview(batch.column("bytes")[i].as_buffer()), batch.column("n")[i].as_py()
                start = batch.column("start")[i].as_py()
                each = pa.array([hashlib.blake2b(data[a : a + width], digest_size=16).digest() for a in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([each, pa.array([batch.column("text_id")[i].as_py()] * n, pa.binary()), pa.array(np.arange(start, start + n))], ["digest", "text_id", "start"])

    each = crowded.mapInArrow(digests, "digest binary, text_id binary, start long")
    twice = each.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest")
    return each.join(twice, "digest").select("text_id", "start", (F.col("start") + width).alias("stop"))


def joined(spans: DataFrame) -> DataFrame:
    """SPAN rows of each text without overlap: spans that meet are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            ids, start, stop = batch.column("text_id").to_pylist(), batch.column("start").to_pylist(), batch.column("stop").to_pylist()
            out = []
            for t, a, b in zip(ids, start, stop, strict=True):
                if held and held[0] == t and a <= held[2]:
                    held = (t, held[1], max(b, held[2]))
                else:
                    if held:
                        out.append(held)
                    held = (t, a, b)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names(SPAN))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(held, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names(SPAN))

    # copies of a text give the same spans: they become one before the shuffle
    once = spans.groupBy("text_id", "start").agg(F.max("stop").alias("stop"))
    return once.repartition("text_id").sortWithinPartitions("text_id", "start").mapInArrow(run, SPAN)


def keep_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the maximal removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            if end >= 0:
                runs += 1
                at = end
            kept.append(text[at:a])
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    if end >= 0:
        runs += 1
        at = end
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def dedup(docs: DataFrame, width: int = WIDTH, hot: int = HOT, text_col: str = "text", digest_only: bool = False, in_place: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_text; input columns of those names give way.

    kept_text leaves out what a cut inside a character leaves of it. With digest_only it isn't returned; with
    in_place it has the name of the texts, which are not carried along beside it.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    base = docs.drop(*made, "_text_id", "_text", "_spans")
    made[4] = text_col if in_place else made[4]
    spans = find_repeats(named(base, text_col), width, hot)
    lists = spans.groupBy(F.col("text_id").alias("_text_id")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    carried = base.drop(text_col) if digest_only or in_place else base
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = base.select(F.unhex(F.md5(text)).alias("_text_id"), *[F.col(f"`{c}`") for c in carried.columns], text.alias("_text"))
    with_spans = rows.join(lists, "_text_id", "left")
    passed = carried.columns
    out_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields)
    schema = out_type + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ("" if digest_only else f", `{made[4]}` string")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "_text", 2 * SLAB):
            n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
            for text, found in zip(part.column("_text"), part.column("_spans"), strict=True):
                text = text.as_py()
                left, removed, runs = keep_bytes(text, [(x["start"], x["stop"]) for x in found.as_py() or []])
                n_bytes.append(len(text)), n_removed.append(removed), n_spans.append(runs)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(None if digest_only else left.decode("utf-8", "ignore"))
            arrays = [part.column(c) for c in passed] + [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)]
            yield pa.RecordBatch.from_arrays(arrays + ([] if digest_only else [pa.array(kept, pa.string())]), passed + made[: 4 if digest_only else 5])

    return with_spans.select(*[F.col(f"`{c}`") for c in passed], "_text", "_spans").mapInArrow(apply, schema)


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was removed, and behind it the texts that are left: n_bytes is the input's length, which no removal changes."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, in_place=True)
