"""Fill-in-middle transformation of texts, cut between units by a run-length encoding of character classes.

A unit is a run of letters A-Z and a-z, or any one other character. A text is encoded as
its maximal runs of one class, letters or others, with the characters and units before
each: a run of letters is one unit, a run of others as many as it has characters. The run
that holds a cut is found by binary search among the units before, and the cut's place in
it by arithmetic; no list of units is ever made.

Two cuts, drawn from a hash of seed and id, make prefix, middle and suffix. A share of
texts stays plain, as do empty ones and ones that hold a sentinel; the rest is written
suffix first (spm) or prefix first (psm). `restored` is the way back.

Defined cases: null texts are empty, empty ones have no units; null ids are hashed as no
digits; repeated rows get the same cuts; one row makes one row whatever its length; other
columns pass through, except ones named as this operator's results, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
MADE = ["n", "form", "prefix_chars", "middle_chars", "prefix", "middle", "suffix", "output"]
CUTS = "n long, low long, high long"


class Runs(NamedTuple):
    """Runs of all texts of a slab. `first` and the totals have an entry a text, `first` one more."""

    first: np.ndarray
    letters: np.ndarray
    chars_before: np.ndarray
    units_before: np.ndarray
    chars: np.ndarray
    units: np.ndarray


def before_in(sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the runs of the same text before each come to, and each text's total."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    return sums[:-1] - np.repeat(sums[first[:-1]], np.diff(first)), np.diff(sums[first])


def encode(raw: np.ndarray, off: np.ndarray) -> Runs:
    """The runs of UTF-8 texts that start at off; bytes that go on with a character belong to others' runs."""
    letter = ((raw | 0x20) - np.uint8(0x61)) < 26
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    edge[1:-1] |= letter[1:] != letter[:-1]
    start = np.flatnonzero(edge[:-1])
    first = np.searchsorted(start, off)
    lead = (raw & 0xC0) != 0x80
    chars = np.add.reduceat(lead, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    letters = letter[start]
    chars_before, all_chars = before_in(chars, first)
    units_before, all_units = before_in(np.where(letters, 1, chars), first)
    return Runs(first, letters, chars_before, units_before, all_chars, all_units)


def place(runs: Runs, text: int, unit: int) -> int:
    """Characters of the text before the unit of that number; all of them where there is no such unit."""
    if unit >= runs.units[text]:
        return int(runs.chars[text])
    a, b = runs.first[text], runs.first[text + 1]
    at = a + int(np.searchsorted(runs.units_before[a:b], unit, side="right")) - 1
    inside = 0 if runs.letters[at] else unit - int(runs.units_before[at])
    return int(runs.chars_before[at]) + inside


def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of texts and two draws each: units, and characters before the lower and the higher cut."""
    for text, one, other in batches:
        batch = pa.RecordBatch.from_arrays([text, one, other], ["text", "one", "other"])
        n, low, high = [], [], []
        for part in common.pieces(iter([batch]), "text"):
            runs = encode(*common.utf8(part.column("text")))
            draws = np.sort(np.stack([part.column(c).to_numpy() % (runs.units + 1) for c in ("one", "other")]), axis=0)
            n.append(runs.units)
            low.append([place(runs, i, u) for i, u in enumerate(draws[0].tolist())])
            high.append([place(runs, i, u) for i, u in enumerate(draws[1].tolist())])
        whole = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (n, low, high)]
        yield pa.StructArray.from_arrays([pa.array(x) for x in whole], ["n", "low", "high"])


def draw(doc_id: str, seed: int, number: int) -> Column:
    """The draw of that number, from 1: eight hex digits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars, prefix, middle, suffix and output; parts are null where plain."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.drop(*[c for c in MADE if c not in (doc_id, text_col)])
    own = base.columns
    base = base.withColumn("__fim", F.arrow_udf(cuts, CUTS)(text, draw(doc_id, seed, 1), draw(doc_id, seed, 2)))
    held = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | held | (draw(doc_id, seed, 3) % 100 >= plain_from)
    form = F.when(plain, "plain").when(draw(doc_id, seed, 4) % 100 < spm_below, "spm").otherwise("psm")
    base = base.withColumn("__fim_form", form)
    cut, low, high = F.col("__fim_form") != "plain", F.col("__fim.low"), F.col("__fim.high")
    part = lambda start, size: F.when(cut, F.substring(text, start.cast("int") + 1, size.cast("int")))
    base = base.withColumns({"__fim_p": part(F.lit(0), low), "__fim_m": part(low, high - low), "__fim_s": part(high, F.length(text))})
    p, m, s = F.col("__fim_p"), F.col("__fim_m"), F.col("__fim_s")
    psm, spm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m), F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    output = F.when(~cut, text).when(F.col("__fim_form") == "spm", spm).otherwise(psm)
    made = {"n": F.col("__fim.n"), "form": F.col("__fim_form"), "prefix_chars": F.when(cut, low), "middle_chars": F.when(cut, high - low), "prefix": p, "middle": m, "suffix": s, "output": output}
    return base.select(*[F.col(f"`{c}`") for c in own], *[v.alias(k) for k, v in made.items() if k not in own])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; a text without sentinels cannot make one together with a sentinel beside it."""
    body = F.substring(output, 4, 2**31 - 1)
    second = F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    one = F.when(form == "spm", F.substring_index(body, PREFIX, 1)).otherwise(F.substring_index(body, SUFFIX, 1))
    rest = F.substring(body, F.length(one) + F.length(second) + 1, F.lit(2**31 - 1))
    other = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.length(other) + len(MIDDLE) + 1, F.lit(2**31 - 1))
    return F.when(form == "plain", output).when(form == "spm", F.concat(other, middle, one)).otherwise(F.concat(one, middle, other))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
g AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
