"""URL filters: rules of hosts and paths, and a character language-model ratio for what no rule decides.

URLs that an allow rule decides train one model, those that a block rule decides the
other: Markov models of characters whose order varies with what was seen. The probability
of a character in a context of up to ORDER - 1 characters is mixed from its count there
and its probability in the context shortened by one, in the share n : MASS for a context
seen n times; where a context was never seen, the shorter one decides alone. A URL's score is the
mean over its characters of log P(accepted model) - log P(rejected model).

Counts are of all URLs that a rule decides but one part in four by a hash of the URL, and
the threshold is calibrated on that part: of the scores held out it is the one with the
largest share of accepted URLs at or above it and of rejected ones below, moved half way
to the next score below. URLs under the threshold are blocked.

Characters are folded to SYMBOLS values, so a model has SYMBOLS ** ORDER cells at most,
whatever the number of URLs: that bounds what reaches the driver (the counts seen, summed
in the tasks and in a shuffle first; calibration: a row a bin of scores) and what is sent
back (one table of log ratios).

Defined cases: a null url, or one without ://, has an empty host and path and no rule
decides on it; it is scored by what characters it has, null and empty ones with 0; without
accepted or rejected URLs all scores are near 0, without held-out ones of either kind the
threshold is 0; repeated rows and null ids are rows of their own; an empty table gives no
rows; other columns pass through, except ones named as this operator's results, which give
way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters with a value of their own, from 1; 0 stands before a URL's start, the last value for all other characters.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_:?=&%#"
SYMBOLS = len(ALPHABET) + 2
ORDER = 4
MASS = 8.0
#: Bins of scores a nat, and the furthest bin.
BINS, LAST_BIN = 1000, 20_000
HELD_OUT = "4567"
MADE = ["host", "path", "rule", "verdict", "score"]


class Rule(NamedTuple):
    """A path begins with / ; a rule's name is host and path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def lower(url: Column) -> Column:
    return F.translate(url, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(urls: DataFrame, url_col: str, host: str, path: str) -> DataFrame:
    """urls with the host, A-Z lower-cased, and the path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    shown = F.regexp_extract(rest, r"^[^?#]*", 0)
    bare = F.substring_index(shown, "/", 1)
    return urls.withColumn(host, lower(bare)).withColumn(path, F.substring(shown, F.length(bare) + 1, F.length(shown)))


def decided(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


_VALUE = np.zeros(256, np.int64)
_VALUE[:] = SYMBOLS - 1
_VALUE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each character of all URLs the number of the gram of ORDER symbols that ends there, and the URL it is of."""
    raw, off = common.utf8(column)
    lead = (raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])[off]
    values = _VALUE[common.LOWER[raw[lead]]]
    owner = np.repeat(np.arange(len(off) - 1), np.diff(chars))
    within = np.arange(len(values)) - chars[:-1][owner]
    out = values.copy()
    for k in range(1, ORDER):
        before = np.zeros(len(values), np.int64)
        before[k:] = values[:-k]
        before[within < k] = 0
        out += before * SYMBOLS**k
    return out, owner


def count_grams(urls: DataFrame) -> DataFrame:
    """(gram long, accepted long, rejected long) over rows (url, good boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches, "url"):
            gram, owner = grams(part.column("url"))
            good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)[owner]
            keys, at = np.unique(gram, return_inverse=True)
            accepted = np.bincount(at[good], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys, accepted, np.bincount(at, minlength=len(keys)) - accepted)], ["gram", "accepted", "rejected"])

    return urls.select("url", "good").mapInArrow(run, "gram long, accepted long, rejected long").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def probabilities(gram: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """P(last symbol of a gram | those before) of every gram of ORDER symbols."""
    p = np.full(1, 1 / SYMBOLS)
    for k in range(1, ORDER + 1):
        seen = np.bincount(gram % SYMBOLS**k, counts, SYMBOLS**k).reshape(-1, SYMBOLS)
        p = (seen + MASS * np.resize(p, SYMBOLS**k).reshape(-1, SYMBOLS)) / (seen.sum(1, keepdims=True) + MASS)
        p = p.reshape(-1)
    return p


def log_ratios(counts: pa.Table) -> np.ndarray:
    gram = counts.column("gram").to_numpy()
    accepted = probabilities(gram, counts.column("accepted").to_numpy())
    return np.log(accepted) - np.log(probabilities(gram, counts.column("rejected").to_numpy()))


def scorer(spark: SparkSession, ratios: np.ndarray):
    shared = spark.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = [np.zeros(0)]
            for part in common.pieces(iter([pa.RecordBatch.from_arrays([column], ["url"])]), "url"):
                gram, owner = grams(part.column("url"))
                sums, n = np.bincount(owner, shared.value[gram], part.num_rows), np.bincount(owner, minlength=part.num_rows)
                out.append(sums / np.maximum(n, 1))
            yield pa.array(np.concatenate(out))

    return F.arrow_udf(run, "double")


def bin_of(score: str) -> Column:
    """Scores are clipped well before they are turned into whole numbers."""
    return F.greatest(F.least(F.floor(F.col(score) * BINS), F.lit(LAST_BIN)), F.lit(-LAST_BIN))


def threshold(rows: list[tuple[int, int, int]]) -> int:
    """The least bin that is let through, of (bin, accepted, rejected) held out."""
    rows = sorted(rows)
    accepted, rejected = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not accepted or not rejected:
        return 0
    right, best, below = 0, (-math.inf, 0, 0), None
    for at, good, bad in rows:
        # compared as whole numbers: (accepted at or above) / accepted + (rejected below) / rejected
        if right > best[0]:
            best = (right, at, at if below is None else below)
        right += bad * accepted - good * rejected
        below = at
    return -((-best[1] - best[2]) // 2)


def filter_urls(urls: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """urls with host, path, rule, verdict and score."""
    spark = urls.sparkSession
    base = urls.drop(*[c for c in MADE if c != url_col])
    own = base.columns
    base = split(base, url_col, "__url_host", "__url_path")
    name, verdict = decided(F.col("__url_host"), F.col("__url_path"), rules)
    base = base.withColumns({"__url_rule": name, "__url_decided": verdict})
    ruled = base.filter("__url_decided IS NOT NULL").select(F.col(url_col).alias("url"), (F.col("__url_decided") == "allow").alias("good"), F.substring(F.sha2(url_col, 256), 1, 1).isin(*HELD_OUT).alias("held_out"))
    score = scorer(spark, log_ratios(count_grams(ruled.filter("NOT held_out")).toArrow()))
    held = ruled.filter("held_out").withColumn("at", score("url")).withColumn("at", bin_of("at"))
    bins = held.groupBy("at").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).collect()
    least = threshold([(r["at"], r.good, r.bad) for r in bins])
    base = base.withColumn("__url_score", score(F.coalesce(F.col(url_col), F.lit(""))))
    by_model = F.when(bin_of("__url_score") >= least, "allow").otherwise("block")
    made = {"host": F.col("__url_host"), "path": F.col("__url_path"), "rule": F.col("__url_rule"), "verdict": F.coalesce("__url_decided", by_model), "score": F.col("__url_score")}
    return base.select(*[F.col(f"`{c}`") for c in own], *[v.alias(k) for k, v in made.items() if k not in own])


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    tables = ",\n".join(f"""n{k} AS (SELECT good, gram % {SYMBOLS**k} AS g, count(*) AS c FROM g WHERE NOT held_out AND good IS NOT NULL GROUP BY ALL),
m{k} AS (SELECT good, g // {SYMBOLS} AS g, sum(c) AS c FROM n{k} GROUP BY ALL)""" for k in range(1, ORDER + 1))
    chain = lambda good: "{0}".format("".join(f"(coalesce(a{k}.c, 0) + {MASS} * " for k in range(ORDER, 0, -1)) + f"(1.0::DOUBLE / {SYMBOLS})" + "".join(f") / (coalesce(b{k}.c, 0) + {MASS})" for k in range(1, ORDER + 1)))
    joins = lambda good: " ".join(f"LEFT JOIN n{k} a{k} ON a{k}.good = {good} AND a{k}.g = x.gram % {SYMBOLS**k} LEFT JOIN m{k} b{k} ON b{k}.good = {good} AND b{k}.g = (x.gram % {SYMBOLS**k}) // {SYMBOLS}" for k in range(1, ORDER + 1))
    rules = sorted(RULES, key=lambda r: (-len(r.name), -len(r.host)))
    when = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{what(r)}'" for r in rules) + " END"
    symbol = f"CASE WHEN i < 1 THEN 0 WHEN strpos('{ALPHABET}', substr(low, i, 1)) > 0 THEN strpos('{ALPHABET}', substr(low, i, 1)) ELSE {SYMBOLS - 1} END"
    gram = " + ".join(f"({symbol.replace('low, i,', f'low, i - {k},').replace('i < 1', f'i - {k} < 1')}) * {SYMBOLS**k}" for k in range(ORDER))
    return f"""
WITH r AS (SELECT row_number() OVER () AS nr, page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
s AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS shown FROM r),
h AS (SELECT *, translate(split_part(shown, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(shown, length(split_part(shown, '/', 1)) + 1) AS path FROM s),
d AS MATERIALIZED (SELECT nr, page_id, host, path, low, {when(lambda r: r.name)} AS rule, {when(lambda r: r.verdict)} AS decided, substr(sha256(url), 1, 1) IN ('{"', '".join(HELD_OUT)}') AS held_out FROM h),
e AS (SELECT nr, low, decided = 'allow' AS good, held_out, unnest(range(1, length(low) + 1)) AS i FROM d),
g AS MATERIALIZED (SELECT nr, good, held_out, ({gram})::BIGINT AS gram FROM e),
{tables},
u AS (SELECT DISTINCT gram FROM g),
pa AS (SELECT x.gram, ln({chain(True)}) AS p FROM u x {joins('true')}),
pr AS (SELECT x.gram, ln({chain(False)}) AS p FROM u x {joins('false')}),
z AS MATERIALIZED (SELECT nr, greatest(least(floor(avg(pa.p - pr.p) * {BINS}), {LAST_BIN}), -{LAST_BIN})::BIGINT AS bin FROM g JOIN pa USING (gram) JOIN pr USING (gram) GROUP BY nr),
b AS (SELECT z.bin, sum((decided = 'allow')::INT) AS good, sum((decided = 'block')::INT) AS bad FROM d JOIN z USING (nr) WHERE held_out AND decided IS NOT NULL GROUP BY z.bin),
t AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS below, sum(good) OVER () AS goods, sum(bad) OVER () AS bads,
             coalesce(sum(bad) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(good) OVER () - coalesce(sum(good) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(bad) OVER () AS rightly FROM b),
f AS (SELECT coalesce((SELECT ceil((bin + coalesce(below, bin)) / 2.0)::BIGINT FROM t WHERE goods > 0 AND bads > 0 ORDER BY rightly DESC, bin LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN coalesce(z.bin, 0) >= f.least THEN 'allow' ELSE 'block' END) AS verdict
FROM d LEFT JOIN z USING (nr) CROSS JOIN f
"""


OP11_SQL = _sql()
