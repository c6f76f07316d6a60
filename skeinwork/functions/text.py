"""Text functions: node ids, hashes, line endings, indentation, anchors."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.budget import estimate_tokens  # noqa: F401

#: The letter pairs that anchors do not use; all others stand in alphabetical order.
UNUSED_PAIRS = "bq gk gq jv jz kq kz lq nq qf qg qj qk qv qz rj tq wq wz xg xj xk xq xv xw yq zj zq zv".split()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAIRS = [a + b for a in LETTERS for b in LETTERS if a + b not in UNUSED_PAIRS]
JS_BLANKS = "\t\n\v\f\r                  　﻿"


def ordinal(n: int) -> str:
    if n % 100 in (11, 12, 13):
        return "th"
    return {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def line_hash(line_no: int, text: str) -> str:
    """Two letters for a line: an ordinal's ending for blank and brace-only lines, else from xxHash32,
    seeded by the line number if the line has no letter or digit."""
    text = text.replace("\r", "").rstrip(JS_BLANKS)
    if not text.translate({ord(c): None for c in JS_BLANKS + "{}"}):
        return ordinal(line_no)
    told = any(unicodedata.category(c)[0] in "LN" for c in text)
    return PAIRS[xxhash.xxh32_intdigest(text.encode("utf-8", "replace"), 0 if told else line_no) % len(PAIRS)]


#: The primes of XXH32.
P1, P2, P3, P4, P5 = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
#: Stripes of 16 bytes that all rows go through together; the few rows that are longer are hashed one by one.
STRIPES = 128


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def xxh32(column: pa.Array, seeds: np.ndarray) -> np.ndarray:
    """XXH32 of every string, each with a seed of its own, over the Arrow buffer of all of them."""
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer((data.to_pybytes() if data is not None else b"") + bytes(4), np.uint8)
    # four bytes from any place on
    words = np.ndarray((len(raw) - 3,), "<u4", raw.data, strides=(1,))
    size, seed = np.diff(off), seeds.astype(np.uint32)
    stripes = np.minimum(size // 16, STRIPES)
    order = np.argsort(-stripes, kind="stable")
    start, s = off[:-1][order], seed[order]
    lanes = [s + P1 + P2, s + P2, s.copy(), s - P1]
    for k in range(int(stripes.max(initial=0))):
        n = int(np.searchsorted(-stripes[order], -k, side="left"))
        for i, v in enumerate(lanes):
            v[:n] = rotated(v[:n] + words[start[:n] + (16 * k + 4 * i)] * P2, 13) * P1
    long = rotated(lanes[0], 1) + rotated(lanes[1], 7) + rotated(lanes[2], 12) + rotated(lanes[3], 18)
    h = np.empty(len(size), np.uint32)
    h[order] = np.where(stripes[order] > 0, long, s + P5)
    h += size.astype(np.uint32)
    at, end = off[:-1] + 16 * stripes, off[1:]
    for _ in range(3):
        own = np.flatnonzero(at + 4 <= end)
        h[own] = rotated(h[own] + words[at[own]] * P3, 17) * P4
        at = np.where(at + 4 <= end, at + 4, at)
    for _ in range(3):
        own = np.flatnonzero(at < end)
        h[own] = rotated(h[own] + raw[at[own]] * P5, 11) * P1
        at = np.where(at < end, at + 1, at)
    h = (h ^ (h >> np.uint32(15))) * P2
    h = (h ^ (h >> np.uint32(13))) * P3
    h ^= h >> np.uint32(16)
    for i in np.flatnonzero(size // 16 > STRIPES).tolist():
        h[i] = xxhash.xxh32_intdigest(raw[off[i] : off[i + 1]].tobytes(), int(seed[i]))
    return h


def line_hash_column(line_no: Column, text: Column) -> Column:
    """line_hash of every row. Spark trims and looks at the lines; XXH32 with a seed by row runs over Arrow buffers in numpy."""

    def run(lines: pa.Array, seeds: pa.Array) -> pa.Array:
        made = np.array(PAIRS, object)[xxh32(pc.fill_null(lines, ""), pc.fill_null(seeds, 0).to_numpy()) % len(PAIRS)]
        return pa.array(made, pa.string())

    line = F.rtrim(F.replace(text, F.lit("\r"), F.lit("")), F.lit(JS_BLANKS))
    bare = F.translate(line, JS_BLANKS + "{}", "") == ""
    tens, units = line_no % 100, line_no % 10
    ending = F.when(tens.isin(11, 12, 13), "th").when(units == 1, "st").when(units == 2, "nd").when(units == 3, "rd").otherwise("th")
    seed = F.when(line.rlike(r"[\p{L}\p{N}]"), 0).otherwise(line_no).cast("long")
    return F.when(line_no.isNotNull() & text.isNotNull(), F.when(bare, ending).otherwise(F.arrow_udf(run, "string")(line, seed)))


def anchored(line_no: Column, text: Column) -> Column:
    """LINE+ID|TEXT"""
    return F.concat(line_no.cast("string"), line_hash_column(line_no, text), F.lit("|"), text)


ANCHOR = rf"^\s*[>+\-*]*\s*(\d+)({'|'.join(PAIRS)})"


def parse_anchor(ref: Column) -> Column:
    """struct(line, hash) of an anchor with a line of at least 1, else null."""
    line = F.nullif(F.regexp_extract(ref, ANCHOR, 1), F.lit("")).cast("long")
    return F.when(line >= 1, F.struct(line.alias("line"), F.regexp_extract(ref, ANCHOR, 2).alias("hash")))


def rolling_hash(text: Column) -> Column:
    """h * 31 + c over characters in 32-bit signed arithmetic."""
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + F.ascii(c)))


def line_ending(text: Column) -> Column:
    """'crlf' if the first line ends so, else 'lf'."""
    crlf, lf = F.instr(text, "\r\n"), F.instr(text, "\n")
    return F.when((crlf > 0) & (crlf < lf), "crlf").otherwise("lf")


def to_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def leading_blanks(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^([ \t]*)", 1))


def min_indent(lines: Column) -> Column:
    """The least indentation among lines that are not blank, 0 without such."""
    full = F.filter(lines, lambda x: F.trim(x) != "")
    return F.coalesce(F.array_min(F.transform(full, leading_blanks)), F.lit(0))


def indent_unit(lines: Column) -> Column:
    """The greatest common divisor of indentations, 0 without any."""
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(a, b), F.lit(1))), F.lit(1), lambda m, k: F.when((a % k == 0) & (b % k == 0), k).otherwise(m))
    depth = F.filter(F.transform(lines, leading_blanks), lambda n: n > 0)
    return F.aggregate(depth, F.lit(0), lambda m, n: F.when(m == 0, n).otherwise(gcd(m, n)))


#: What characters are read as, in this order; and the classes that comparisons of lines take for equal.
PLAIN = ((r"[\u2010-\u2015\u2212]", "-"), (r"[\u2018-\u201B]", "'"), (r"[\u201C-\u201F]", '"'), (r"[\u00A0\u2002-\u200A\u202F\u205F\u3000]", " "), (r"\u2260", "!="), (r"\u00BD", "1/2"), (r"[\u200B-\u200D\uFEFF]", ""))
FUZZY = ((r"[\u0022\u201E\u201F\u00AB\u00BB]", '"'), (r"[\u0027\u201A\u201B\u0060\u00B4]", "'"), (r"[\u2010\u2011\u2012\u2013\u2014\u2212]", "-"), (r"[ \t]+", " "))


def plain_punctuation(text: Column) -> Column:
    text = F.trim(text)
    for pattern, to in PLAIN:
        text = F.regexp_replace(text, pattern, to)
    return text


def fuzzy_line(line: Column) -> Column:
    """A line as comparisons take it: trimmed, one kind of quote and dash, single blanks."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    for pattern, to in FUZZY:
        line = F.regexp_replace(line, pattern, to)
    return line


def nfc(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(text)


def node_path(node_id: Column) -> Column:
    """The file of file:<path>[:<symbol>]; a last part with / or . belongs to the path."""
    rest = F.regexp_replace(node_id, "^file:", "")
    tail = F.substring_index(rest, ":", -1)
    has = rest.contains(":") & ~tail.rlike(r"[/.]")
    return F.when(has, F.regexp_replace(rest, r":[^:]*$", "")).otherwise(rest)


def node_symbol(node_id: Column) -> Column:
    rest = F.regexp_replace(node_id, "^file:", "")
    tail = F.substring_index(rest, ":", -1)
    return F.when(rest.contains(":") & ~tail.rlike(r"[/.]"), tail)


def match_normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_]", "")


def glob_match(text: Column, pattern: str) -> Column:
    parts = [p.replace("\\", "\\\\") for p in pattern.split("*")]
    quoted = ".*".join("".join(c if c.isalnum() else "\\" + c for c in p) for p in parts)
    return text.rlike(f"(?i)^{quoted}$")
