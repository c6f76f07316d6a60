"""Benchmark overlap by seeds that no overlap can avoid.

A seed is a fixed mask over a run of words that ignores some places: its hash leaves the
words there out, so a hit stands a substitution in them. Wherever n // 5 of n >= 12 words
are substituted, one of the two masks fits between the substitutions; enumeration of
12 words with 2, 15 with 3 and 20 with 4, which every longer overlap holds, proves it.
Hashes of both masks at all places of test items are joined with those of all
documents. Around every hit the two texts are compared word by word along the hit's
diagonal, or the diagonal is compared once where it has many hits, as in texts that repeat
a word; where some 12 to 23 words are equal to `share` (every longer overlap
holds such a part), the whole diagonal is, substitutions counted, over the longest
stretch whose share of equal words stays at `share`.

Test items come in blocks of bounded size, some of them a scan, so what is sent to
tasks has a known bound, the hashes are joined in the tasks, and documents are never shuffled.

Defined cases: null and empty texts overlap nothing; items of fewer words than an
overlap needs match as a whole, with `share` of their words equal, in place and at
either end too (below 5 words that is all of them); null ids are kept as they are; a
row per document row and item is returned, the longest overlap of the pair, ties to
the first; repeated rows and items are compared each on its own; texts of any length
are taken whole, and hits in them some at a time; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Places of a seed that count, 1, and that are ignored, 0.
MASKS = ("111011", "110100011")
#: Seeds of pieces of short items, by words.
PIECES = ("1", "11", "111", "1111")
#: Hits that are compared at once, and words of whole diagonals.
HITS, DIAGONAL_WORDS = 1 << 15, 1 << 19
#: Words that an overlap needs, or the whole item where that has fewer.
LEAST_WORDS = 12
SHARE = 0.8
#: Words of test items in one block: at most 2 hashes of 16 bytes each.
BLOCK_WORDS = 400_000
#: Blocks that are held at once and looked for in one scan of the documents.
SCAN_BLOCKS = 4
OVERLAP = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The masked hash at every place at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + n] * common.WORD_CODES[k]
    return common.mix(out ^ common.mix(np.array([int(mask, 2)], np.uint64)))


#: What stands for the seed before a text's first one, in items and in documents.
NO_ITEM_SEED, NO_DOC_SEED = np.uint64(1), np.uint64(2)


def seeds_before(keys: np.ndarray, owner: np.ndarray, at: np.ndarray, none: np.uint64) -> np.ndarray:
    """The seed one word before each place of the same text."""
    return np.where((at > 0) & (owner[at - 1] == owner[at]), keys[at - 1] if len(keys) else none, none)


class Seeds:
    """Hashes of one mask at places of test items, sorted with the seeds before them, for lookup."""

    def __init__(self, mask: str, words: np.ndarray, owner: np.ndarray, places: np.ndarray):
        self.mask, self.owner, self.all = mask, owner, seed_hashes(words, mask)
        keys, before = self.all[places], seeds_before(self.all, owner, places, NO_ITEM_SEED)
        order = np.lexsort((before, keys))
        self.keys, self.places = keys[order], places[order]
        self.befores, rank = np.unique(before[order], return_inverse=True)
        self.starts = np.searchsorted(self.keys, self.keys)
        # places in one order by key and seed before: the place of a key's first entry stands for the key
        self.both = self.starts * len(self.befores) + rank
        # one bit for each of 2**20 hash prefixes: most words of clean text stop here
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, owner: np.ndarray, heads: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in words, place in the block's words, whether the next places hit too) of equal hashes inside one document,
        HITS or so at a time; with heads those only whose places before are no hit, which begin a row of hits."""
        h = seed_hashes(words, self.mask)
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        at = at[owner[at] == owner[at + len(self.mask) - 1]]
        a, b = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        at, a, b = at[b > a], a[b > a], b[b > a]
        # [c, e) of [a, b) go on with a row of hits
        c = e = a
        if heads and len(at):
            before = seeds_before(h, owner, at, NO_DOC_SEED)
            rank = np.minimum(np.searchsorted(self.befores, before), len(self.befores) - 1)
            both = np.where(self.befores[rank] == before, a * len(self.befores) + rank, -1)
            c, e = np.searchsorted(self.both, both, "left"), np.searchsorted(self.both, both, "right")
            c, e = np.where(e > c, c, a), np.where(e > c, e, a)
        n = (c - a) + (b - e)
        ends = np.cumsum(n)
        i = 0
        while i < len(at):
            base = ends[i] - n[i]
            j = max(i + 1, int(np.searchsorted(ends, base + HITS, side="right")))
            which = np.repeat(np.arange(i, j), n[i:j])
            k = np.arange(base, ends[j - 1]) - (ends[which] - n[which])
            left = (c - a)[which]
            place = self.places[np.where(k < left, a[which] + k, e[which] + k - left)]
            x, y = np.minimum(at[which] + 1, len(h) - 1), np.minimum(place + 1, len(self.all) - 1)
            row = (h[x] == self.all[y]) & (x > at[which]) & (y > place) & (owner[x] == owner[at[which]]) & (self.owner[y] == self.owner[place])
            if len(which):
                yield at[which], place, row
            i = j


class Block:
    """Test items with their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: int = LEAST_WORDS, share: float = SHARE):
        self.ids = [i for i, _ in items]
        self.least, self.share = least, share
        raw, off = common.utf8(pa.array([t or "" for _, t in items], pa.string()))
        self.words, self.first = common.word_hashes(raw, off)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(items)), self.counts)
        long = self.counts >= least
        self.seeds = []
        for mask in MASKS:
            at = np.arange(max(0, len(self.words) - len(mask) + 1))
            at = at[long[self.owner[at]] & (self.owner[at] == self.owner[at + len(mask) - 1])]
            if len(at):
                self.seeds.append(Seeds(mask, self.words, self.owner, at))
        # with k substitutions one of k + 1 pieces has none
        pieces: dict[str, list[int]] = {}
        for i in np.flatnonzero((self.counts > 0) & ~long).tolist():
            n = int(self.counts[i])
            parts = n - needed(n, share) + 1
            for k in range(parts):
                pieces.setdefault(PIECES[min(n // parts, len(PIECES)) - 1], []).append(int(self.first[i]) + k * (n // parts))
        self.pieces = [Seeds(mask, self.words, self.owner, np.array(at)) for mask, at in sorted(pieces.items())]

    def equal_at(self, words: np.ndarray, first: np.ndarray, owner: np.ndarray, at: np.ndarray, place: np.ndarray, reach: range) -> np.ndarray:
        """Of each hit, whether the words at each distance in reach are equal and inside both texts."""
        d, i = owner[at], self.owner[place]
        low = np.maximum(first[d] - at, self.first[i] - place)[:, None]
        high = np.minimum(first[d + 1] - at, self.first[i + 1] - place)[:, None]
        step = np.arange(reach.start, reach.stop)
        same = words[np.clip(at[:, None] + step, 0, len(words) - 1)] == self.words[np.clip(place[:, None] + step, 0, len(self.words) - 1)]
        return same & (step >= low) & (step < high)

    def whole_diagonals(self, words: np.ndarray, first: np.ndarray, d: np.ndarray, i: np.ndarray, shift: np.ndarray, most: int, settled: dict[int, int]) -> np.ndarray:
        """Which diagonals (document, item, shift), in that order, have least to `most` words in a row equal to the share, each
        compared once. One that is equal from end to end settles its pair: nothing further on is longer."""
        begin = np.maximum(0, -shift)
        whole = np.minimum(self.counts[i], np.diff(first)[d])
        length = np.maximum(0, np.minimum(self.counts[i], np.diff(first)[d] - shift) - begin)
        pair = d * len(self.counts) + i
        good = np.zeros(len(d), bool)
        todo = np.arange(len(d))
        while len(todo):
            todo = todo[[shift[k] <= settled.get(pair[k], shift[k]) for k in todo.tolist()]]
            if not len(todo):
                break
            now = todo[: max(1, int(np.searchsorted(np.cumsum(length[todo]), DIAGONAL_WORDS, side="right")))]
            todo = todo[len(now) :]
            size = length[now]
            ends = np.cumsum(size)
            which = np.repeat(now, size)
            at = np.arange(len(which)) - np.repeat(ends - size, size) + begin[which]
            equal = words[first[d[which]] + shift[which] + at] == self.words[self.first[i[which]] + at]
            sums = np.concatenate([[0], np.cumsum(equal, dtype=np.int64)])
            left = np.repeat(ends, size) - np.arange(len(which))
            for n in range(self.least, most + 1):
                fits = (sums[n:] - sums[:-n] >= needed(n, self.share)) & (left[: max(0, len(which) - n + 1)] >= n)
                good[which[: len(fits)][fits]] = True
            full = (size == whole[now]) & (size > 0) & (sums[ends] - sums[ends - size] >= needed(size, self.share))
            for k, z in zip(now[full].tolist(), ends[full].tolist(), strict=True):
                if equal[z - 1] and equal[z - length[k]]:
                    settled.setdefault(pair[k], int(shift[k]))
                    settled[pair[k]] = min(settled[pair[k]], int(shift[k]))
        return good

    def diagonals(self, words: np.ndarray, first: np.ndarray, owner: np.ndarray) -> set[tuple[int, int, int]]:
        """(document, item, place of the item's first word in the document) worth a whole comparison."""
        out: set[tuple[int, int, int]] = set()
        done: set[int] = set()
        # a stretch of 2 * least words or more has a half that qualifies too
        most = 2 * self.least - 1
        shortest = min(map(len, MASKS))
        reach = range(shortest - most, most)
        settled: dict[int, int] = {}
        for seeds in self.seeds:
            for at, place, row in seeds.hits(words, owner, True):
                d, i = owner[at], self.owner[place]
                shift = at - first[d] - place + self.first[i]
                key = ((d * len(self.counts) + i) << 33) + shift + (1 << 32)
                keys, one, which, hits = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                known = np.array([k in done for k in keys.tolist()], bool)
                length = np.minimum(self.counts[i[one]], np.diff(first)[d[one]] - shift[one]) - np.maximum(0, -shift[one])
                # what a row of hits is part of is compared as a whole, as is what that costs less for
                whole = ~known & ((np.bincount(which, row) > 0) | (hits * len(reach) >= length))
                if whole.any():
                    done.update(keys[whole].tolist())
                    pick = one[whole]
                    good = self.whole_diagonals(words, first, d[pick], i[pick], shift[pick], most, settled)
                    out.update(zip(d[pick][good].tolist(), i[pick][good].tolist(), shift[pick][good].tolist(), strict=True))
                rest = ~(known | whole)[which]
                at, place = at[rest], place[rest]
                equal = self.equal_at(words, first, owner, at, place, reach)
                some = equal.sum(1) >= needed(self.least, self.share)
                at, place, equal = at[some], place[some], equal[some]
                sums = np.zeros((len(at), len(reach) + 1), np.int16)
                np.cumsum(equal, axis=1, out=sums[:, 1:])
                good = np.zeros(len(at), bool)
                for n in range(self.least, most + 1):
                    # those that hold the seed's first words
                    a = np.arange(most - n, most - shortest + 1)
                    good |= (sums[:, a + n] - sums[:, a]).max(1) >= needed(n, self.share)
                at, place = at[good], place[good]
                out.update(zip(owner[at].tolist(), self.owner[place].tolist(), (at - first[owner[at]] - place + self.first[self.owner[place]]).tolist(), strict=True))
        for seeds in self.pieces:
            for at, place, _ in seeds.hits(words, owner, False):
                d, i = owner[at], self.owner[place]
                begin = at - (place - self.first[i])
                inside = (begin >= first[d]) & (begin + self.counts[i] <= first[d + 1])
                d, i, begin = d[inside], i[inside], begin[inside]
                equal = self.equal_at(words, first, owner, begin, self.first[i], range(0, self.least)).sum(1)
                good = equal >= needed(self.counts[i], self.share)
                out.update(zip(d[good].tolist(), i[good].tolist(), (begin - first[d])[good].tolist(), strict=True))
        return out


def needed(n, share: float):
    """How many of n words make the share."""
    return np.ceil(np.multiply(n, share) - 1e-9).astype(int)


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """The longest [a, b) with at least `share` equal words that begins and ends with one; the first of equals."""
    score = np.concatenate([[0.0], np.cumsum(equal - share)])
    # the least score at which a stretch may begin up to a place, the greatest at which one may end from a place on
    low = np.minimum.accumulate(np.where(np.append(equal, False), score, np.inf))
    high = np.maximum.accumulate(np.where(np.append(False, equal), score, -np.inf)[::-1])[::-1]
    best, at, j = (0, 0), 0, 0
    while at < len(score) and j < len(score):
        if high[j] >= low[at] - 1e-9:
            if j - at > best[1] - best[0]:
                best = (at, j)
            j += 1
        else:
            at += 1
    return best


def overlaps_of(words: np.ndarray, first: np.ndarray, block: Block) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, doc_start, item_start, n_words, n_equal): the longest overlap of each document with each item."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for d, item, shift in sorted(block.diagonals(words, first, owner)):
        doc, own = words[first[d] : first[d + 1]], block.words[block.first[item] : block.first[item + 1]]
        a, b = max(0, -shift), min(len(own), len(doc) - shift)
        held = best[d, item][2] if (d, item) in best else 0
        if b - a <= held:
            continue
        equal = own[a:b] == doc[a + shift : b + shift]
        # no stretch is longer than its equal words by the share
        if len(own) >= block.least and equal.sum() < (held + 1) * block.share - 1e-6:
            continue
        # a short item counts as a whole
        x, y = longest_stretch(equal, block.share) if len(own) >= block.least else (0, len(own))
        if y - x >= min(block.least, len(own)) and ((d, item) not in best or y - x > best[d, item][2]):
            best[d, item] = (a + x + shift, a + x, y - x, int(equal[x:y].sum()))
    return [(d, item, *v) for (d, item), v in sorted(best.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items in blocks of at most BLOCK_WORDS words (or one item), read as a stream."""
    block, words = [], 0
    for r in items.select(items[id_col].cast("long").alias("i"), items[text_col].cast("string").alias("t")).toLocalIterator():
        n = len((r.t or "").split())
        if block and words + n > BLOCK_WORDS:
            yield block
            block, words = [], 0
        block.append((r.i, r.t))
        words += n
    if block:
        yield block


def find_overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, share: float = SHARE) -> DataFrame:
    spark = docs.sparkSession
    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[doc_text].cast("string").alias("text"))
    out = spark.createDataFrame([], OVERLAP)
    # some blocks a scan, so that a larger benchmark doesn't read the corpus once for each
    blocks = item_blocks(items, item_id, item_text)
    while group := list(itertools.islice(blocks, SCAN_BLOCKS)):
        shared = [spark.sparkContext.broadcast(rows) for rows in group]

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = [Block(x.value, least, share) for x in shared]
            for part in common.pieces(batches, "text"):
                raw, off = common.utf8(part.column("text"))
                words, first = common.word_hashes(raw, off)
                ids = part.column("doc_id").to_pylist()
                found = [(ids[d], block.ids[item], *rest) for block in held for d, item, *rest in overlaps_of(words, first, block)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], [x.split()[0] for x in OVERLAP.split(", ")])

        out = out.unionByName(picked.mapInArrow(run, OVERLAP))
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items that they hold; clean documents have no row."""
    return find_overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold an overlap; rows without id stay."""
    bad = find_overlaps(docs, items).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns) if "doc_id" in docs.columns else docs
