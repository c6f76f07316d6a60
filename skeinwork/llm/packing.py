"""Packing token streams into fixed windows by the sum-of-squares rule.

Each task tokenises its documents and packs them as they come. A document's full
windows are cut off first; what is left goes to the fill level at which the sum of
squared counts of partly filled windows, held in one array over levels, becomes
smallest. At the end of a task the windows still open are merged by cutting, so a
task leaves one padded window at most. Nothing is shuffled.

Token ids are those of the `tokenizers` file for the whole text. Text is cut into
the pre-tokens of the byte-level scheme in numpy, and each distinct pre-token is
encoded once; texts with characters outside long-settled Unicode blocks, or with a
special token's string, are encoded whole instead.

Defined cases: null and empty texts have the end id alone; null ids stay null;
repeated rows are packed each on its own; a text of any length is encoded whole and
cut at window ends; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common

WINDOW = 2048
END_ID = 1
SLAB = 1 << 20
#: Pre-tokens kept encoded in a worker; beyond it the table starts anew, which costs time only.
CACHE_ENTRIES = 1_200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SETTLED = ((0, 0x530), (0x2000, 0x2C00), (0x3000, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF00, 0xFFF0))
LEARN = 2_000
OTHER, LETTER, NUMBER, BLANK = range(4)
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def character_classes() -> np.ndarray:
    """The pre-tokeniser's class of every code point; 255 where a text is encoded whole."""
    out = np.full(0x110000, 255, np.uint8)
    for a, b in SETTLED:
        for c in range(a, b):
            kind = unicodedata.category(chr(c))
            out[c] = 255 if kind == "Cn" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    out[list(WHITE)] = BLANK
    return out


def pretoken_starts(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the code points at which pre-tokens start, and of the texts to encode whole."""
    n = len(points)
    kind = character_classes()[points]
    whole = np.zeros(len(off) - 1, bool)
    if (odd := np.flatnonzero(kind == 255)).size:
        whole[np.searchsorted(off, odd, side="right") - 1] = True
    first = np.zeros(n + 3, bool)
    first[off] = True
    before = np.concatenate([[OTHER], kind[:-1]]).astype(np.uint8)
    blank = kind == BLANK
    attached = np.concatenate([[False], (points[:-1] == 0x20) & (kind[:-1] == BLANK)]) & ~blank
    start = (kind != before) & ~attached
    last_of_run = blank & np.concatenate([~blank[1:], [False]]) & ~first[1 : n + 1]
    start |= last_of_run & (before == BLANK)
    start |= first[:n]
    # 's 't 'm 'd 're 've 'll, where an apostrophe starts a pre-token of its own
    quote = np.flatnonzero((points == 0x27) & start & ~first[1 : n + 1])
    if quote.size:
        nxt = points[quote + 1]
        third = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(nxt, [ord(c) for c in "stmd"])
        long = ((nxt == ord("r")) | (nxt == ord("v"))) & (third == ord("e")) | (nxt == ord("l")) & (third == ord("l"))
        for at, width in ((quote[short], 2), (quote[long & ~short], 3)):
            for k in range(1, width):
                start[at + k] = False
            ends = at + width
            start[ends[ends < n]] = True
    return start, whole


class Encoder:
    """Ids of texts, slab by slab, with a table of encoded pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, checks: np.ndarray, texts: list[str]) -> None:
        found = []
        for at in range(0, len(texts), LEARN):  # what the tokenizer returns takes far more room than the ids
            found += [np.array(x, np.uint32) for x in self.plain(texts[at : at + LEARN])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.flat = np.concatenate([self.flat, *found])
        # keys come sorted: they go to their places, the table is not sorted anew
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks, self.starts, self.sizes = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.checks, checks), (self.starts, starts.astype(np.int64)), (self.sizes, sizes)))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        data = raw.tobytes()
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        lead = (raw & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        point_off = np.concatenate([[0], np.cumsum(lead)])[off]
        if not len(points):
            return [np.zeros(0, np.uint32)] * (len(off) - 1)
        start, whole = pretoken_starts(points, point_off)
        for word in self.special:
            if word in data:
                whole |= [word in data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        s = at[np.flatnonzero(start)]
        e = np.append(s[1:], len(raw))
        hashes, checks = common.bytes_hashes(raw, s, e)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_ENTRIES:
            self.clear()
        known = np.isin(keys, self.keys, assume_unique=True)
        if not known.all():
            new = first[~known]
            self.learn(keys[~known], checks[new], [data[a:b].decode() for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True)])
        place = np.searchsorted(self.keys, keys)[inverse]
        # a pre-token that shares another's hash only in part: its text is encoded whole
        if (odd := np.flatnonzero(self.checks[place] != checks)).size:
            whole[np.searchsorted(off, s[odd], side="right") - 1] = True
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[place] - (ends - sizes), sizes) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.searchsorted(s, off)]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(whole):
            out[i] = np.array(self.plain([data[off[i] : off[i + 1]].decode()])[0], np.uint32)
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class SquaresPacker:
    """Online packing of pieces no longer than a window. A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next = window, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def close(self, pieces: list) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1
        return rows

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, at which the sum of squared counts grows least; ties to the fullest."""
        count, top = self.count, self.window - size
        grown = 2 * count[size : self.window + 1] + 1
        grown[-1] = 0  # a window that is full leaves the array
        cost = grown - 2 * count[: top + 1] + 1
        cost[0] = grown[0]
        usable = count[: top + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return top - int(np.argmin(cost[::-1]))

    def add(self, piece: tuple) -> list[tuple]:
        size = len(piece[2])
        if size == self.window:
            return self.close([piece])
        level = self.level_for(size)
        box = []
        if level:
            box = self.open[level].pop()
            self.count[level] -= 1
        box.append(piece)
        if level + size == self.window:
            return self.close(box)
        self.count[level + size] += 1
        self.open.setdefault(level + size, []).append(box)
        return []

    def finish(self) -> list[tuple]:
        """Fills the fullest windows from the emptiest, cutting pieces."""
        boxes = [(level, box) for level in sorted(self.open) for box in self.open[level]]
        self.open, rows, low, high = {}, [], 0, len(boxes) - 1
        while low <= high:
            level, box = boxes[high]
            while level < self.window and low < high:
                _, source = boxes[low]
                doc, start, ids, total = source.pop()
                room = self.window - level
                if len(ids) > room:
                    source.append((doc, start, ids[:-room], total))
                    start, ids = start + len(ids) - room, ids[-room:]
                box.append((doc, start, ids, total))
                level += len(ids)
                if not source:
                    low += 1
            rows += self.close(box)
            high -= 1
        return rows


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences, PIECES by name; sequence ids count up within a task's own range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), SquaresPacker(window, TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in PIECES.split(", ")]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        end = np.array([end_id], np.uint32)
        for part in common.pieces(batches, "text", SLAB):
            raw, off = common.utf8(part.column("text"))
            for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(raw, off), strict=True):
                ids = np.concatenate([ids, end])
                for at in range(0, len(ids), window):
                    rows += packer.add((doc, at, ids[at : at + window].copy(), len(ids)))
            if len(rows) > 20_000:
                yield flush()
        rows += packer.finish()
        if rows:
            yield flush()
        common.release()

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, PIECES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), default_tokenizer())
