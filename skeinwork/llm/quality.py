"""Quality by an interpolated modified Kneser-Ney model of characters.

The model is counted on the whole text of all trusted documents: n-gram counts of
the highest order, continuation counts below it, three discounts an order from the
counts of counts. Contexts, discounts and lower orders meet in joins of count tables
sharded by their keys. A document's perplexity is that of its characters, the first
ones in the context of a start sign.

Whether it is kept follows from quantiles of the trusted documents of its language
and length band: it is rejected outside [Q1 - f * (Q3 - Q1), Q3 + f * (Q3 - Q1)],
as noise is unlikely text and repetition is too likely or too uneven. Cells with few
trusted documents take the quantiles of their language, and those of all languages
where that has few too.

The finished tables are cut into shards by a hash of the two characters before the
predicted one (tables of two characters are in every shard); scoring sends one shard
at a time to the tasks, so documents are not shuffled where one shard is enough (any
usual alphabet), and partial sums are joined by row where it is not.

Characters have 16 bits: those beyond the basic plane share, by a hash, the 2,048
values of surrogates, which no text has, and U+0000 stands as U+FFFF.

Defined cases: null and empty texts have no perplexity and are rejected; null
languages are a language of their own; without trusted documents nothing is
rejected; repeated rows are scored each on its own; texts of any length are scored
whole; other columns pass through, except ones named as this operator's results, which
give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 4
SLAB = 1 << 19
#: Rows of the model in one shard, 16 bytes each.
SHARD_ROWS = 4_000_000
#: Trusted ids that are sent to tasks rather than joined; the result is the same.
SENT_IDS = 1_000_000
FENCE = 3.0
CELL_ROWS = 50
MADE = ["n_scored", "perplexity", "low", "high", "kept"]


def points_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts as 16-bit values, 1 at least, and where each text starts."""
    raw, off = common.utf8(column)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    points = points.astype(np.int64)
    if len(points) and points.max() > 0xFFFF:
        points = np.where(points > 0xFFFF, 0xD800 + (points * 40503 >> 5) % 2048, points)
    points[points == 0] = 0xFFFF
    return points, lead[off]


def grams(points: np.ndarray, first: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each character, 16 bits a character, 0 before a text's start; as uint64."""
    within = np.arange(len(points)) - np.repeat(first[:-1], np.diff(first))
    out = points.astype(np.uint64)
    for k in range(1, order):
        before = np.zeros(len(points), np.uint64)
        before[k:] = points[:-k]
        before[within < k] = 0
        out |= before << np.uint64(16 * k)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram long, c long) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in common.pieces(batches, "text", SLAB):
            k, c = np.unique(grams(*points_of(part.column("text"))), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, c]), len(keys)).astype(np.int64)
            if len(keys) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(keys)), pa.array(counts)], ["gram", "c"])
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(keys)), pa.array(counts)], ["gram", "c"])

    return docs.select("text").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    n = {r.c: r.n for r in counts.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return min(1.0, max(0.0, 1 - 2 * y * n2 / n1)), min(2.0, max(0.0, 2 - 3 * y * n3 / n2)), min(3.0, max(0.0, 3 - 4 * y * n4 / n3))


def train(docs: DataFrame) -> tuple[DataFrame, float, int]:
    """(kind, gram, value) with interpolated probabilities 'p2'.. and back-off weights 'g2'.. by order, 'p1' of
    single characters; the probability of an unseen character; the number of rows."""
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = common.store(df, name)
        folders.append(path)
        return out

    tables = {ORDER: keep(count_grams(docs), "counts")}
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << 16 * k) - 1
        tables[k] = keep(tables[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "counts")
    parts, below, unseen = [], None, 1.0
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(tables[k])
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = tables[k].withColumn("context", F.expr(f"shiftrightunsigned(gram, 16) & {(1 << 16 * (k - 1)) - 1}L"))
        context = rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("left"), F.count(F.lit(1)).alias("types"))
        if k == 1:
            whole = context.first()
            if whole is None:
                break
            unseen = whole.left / (whole.types + 1)
            below = rows.select("gram", ((F.col("c") - cut) / F.lit(whole.total) + F.lit(unseen)).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)).alias("suffix")
            joined = rows.join(context.drop("types"), "context").withColumn("suffix", suffix).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
            below = joined.select("gram", ((F.col("c") - cut) / F.col("total") + F.col("left") * F.col("lower")).alias("p"))
            parts.append(context.select(F.lit(f"g{k}").alias("kind"), F.col("context").alias("gram"), F.col("left").alias("value")))
        below = keep(below, "probabilities")
        parts.append(below.select(F.lit(f"p{k}").alias("kind"), "gram", F.col("p").alias("value")))
    if not parts:
        return docs.sparkSession.createDataFrame([], "kind string, gram long, value double"), 1.0, 0
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    model = common.cut(model, "model")
    for path in folders:
        common.delete_folder(docs.sparkSession, path)
    return model, unseen, model.count()


class Tables:
    """One shard of the model in sorted arrays."""

    def __init__(self, rows: pa.Table, unseen: float):
        self.unseen, self.by = unseen, {}
        kinds = rows.column("kind").to_numpy(zero_copy_only=False)
        keys, values = rows.column("gram").to_numpy().view(np.uint64), rows.column("value").to_numpy()
        for kind in set(kinds.tolist()):
            own = kinds == kind
            order = np.argsort(keys[own])
            self.by[kind] = keys[own][order], values[own][order]

    def find(self, kind: str, keys: np.ndarray, default) -> np.ndarray:
        have, values = self.by.get(kind, (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(have):
            return np.broadcast_to(default, keys.shape).astype(float)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, values[at], default)

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        p = self.find("p1", keys & np.uint64(0xFFFF), self.unseen)
        for k in range(2, ORDER + 1):
            own = keys & np.uint64((1 << 16 * k) - 1)
            backed = p * self.find(f"g{k}", own >> np.uint64(16), 1.0)
            p = self.find(f"p{k}", own, backed)
        return np.log(p)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the two characters before the last."""
    return ((keys >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) * np.uint64(40503) % np.uint64(shards)


def scorer(spark: SparkSession, tables: Tables, shard: int, shards: int):
    """A column function: all characters of a text (n), and the log probabilities of the shard's (total)."""
    shared = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for column in batches:
            batch, n, total = pa.RecordBatch.from_arrays([column], ["text"]), [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in common.pieces(iter([batch]), "text", SLAB):
                points, first = points_of(part.column("text"))
                keys, place = np.unique(grams(points, first), return_inverse=True)
                logs = np.zeros(len(keys))
                mine = shard_of(keys, shards) == shard
                logs[mine] = model.log_probability(keys[mine])
                sums = np.concatenate([[0.0], np.cumsum(logs[place])])
                n.append(np.diff(first)), total.append(sums[first[1:]] - sums[first[:-1]])
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(total))], ["n", "total"])

    return F.arrow_udf(run, "n long, total double")


class Model:
    def __init__(self, trusted: DataFrame):
        self.rows, self.unseen, n = train(trusted)
        self.n, self.shards = n, max(1, -(-n // SHARD_ROWS))

    def tables(self, shard: int) -> Tables:
        rows = self.rows
        if self.shards > 1:
            before = F.when(F.col("kind").startswith("g"), F.col("gram")).otherwise(F.shiftrightunsigned("gram", 16)).bitwiseAND(F.lit(0xFFFFFFFF))
            rows = rows.filter(F.col("kind").isin("p1", "p2", "g2") | (before * 40503 % self.shards == shard))
        return Tables(rows.toArrow(), self.unseen)

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with n_scored and perplexity."""
        base, spark = docs.drop(*MADE), docs.sparkSession
        if self.shards == 1:
            out = base.withColumn("__kn", scorer(spark, self.tables(0), 0, 1)(F.col(text_col)))
        else:
            numbered = common.with_row_key(base, "__kn_row")
            sums = None
            for s in range(self.shards):
                one = common.cut(numbered.select("__kn_row", scorer(spark, self.tables(s), s, self.shards)(F.col(text_col)).alias("one")).select("__kn_row", "one.*"), "partial")
                sums = one if sums is None else sums.unionByName(one)
            sums = sums.groupBy("__kn_row").agg(F.struct(F.first("n").alias("n"), F.sum("total").alias("total")).alias("__kn"))
            out = numbered.join(sums, "__kn_row").drop("__kn_row")
        return out.withColumn("n_scored", F.col("__kn.n")).withColumn("perplexity", F.expr("CASE WHEN __kn.n > 0 THEN exp(-__kn.total / __kn.n) END")).drop("__kn")


def trusted_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents labelled good; null ids have no label."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    good = F.broadcast(good) if good.count() <= SENT_IDS else good
    return docs.join(good, "doc_id", "left_semi")


BAND = "cast(floor(log2(greatest(n_scored, 1))) AS int)"


def fences(scored: DataFrame, fence: float) -> dict[tuple[str, int], tuple[int, float, float, float, float]]:
    """(language, band) to (rows, Q1, Q3, reach, median band), of logarithms; band -1 holds all of a language, and ('', -2) everything."""
    cells = scored.filter("perplexity IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), F.expr(BAND).alias("band"), F.log("perplexity").alias("x"))
    out = {}
    quartiles = [F.count(F.lit(1)).alias("n"), F.percentile_approx("x", [0.25, 0.75], 10_000).alias("q"), F.percentile_approx("band", 0.5).alias("mid")]
    for keys in (["lang", "band"], ["lang"], []):
        for r in cells.groupBy(*keys).agg(*quartiles).collect():
            if r.n:
                key = (r.lang, r.band) if len(keys) == 2 else (r.lang, -1) if keys else ("", -2)
                out[key] = (r.n, r.q[0], r.q[1], fence * max(r.q[1] - r.q[0], 0.01), float(r.mid))
    return out


def judge(docs: DataFrame, labels: DataFrame, fence: float = FENCE) -> DataFrame:
    """docs with n_scored, perplexity, low, high and kept."""
    spark = docs.sparkSession
    trusted = trusted_of(docs, labels)
    model = Model(trusted)
    scored = model.score(docs)
    lang = F.coalesce(F.col("lang"), F.lit(""))
    if not model.n:
        return scored.select("*", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(True).alias("kept"))
    cells = fences(common.cut(model.score(trusted.select("lang", "text")).drop("text"), "trusted-scores"), fence)
    # a row for each language and band of trusted text: languages are few by nature, Spark decides how to join more
    levels = [(lg, b, *rest) for (lg, b), rest in cells.items()]
    frame = spark.createDataFrame(levels, "l string, b int, n long, q1 double, q3 double, reach double, mid double")
    small = len(levels) <= 100_000
    hint = F.broadcast if small else (lambda x: x)
    by_cell = frame.filter(f"b >= 0 AND n >= {CELL_ROWS}").select(F.struct("q1", "q3", "reach", "mid").alias("__kn_c0"), F.col("l").alias("__kn_l0"), F.col("b").alias("__kn_b0"))
    by_lang = frame.filter(f"b = -1 AND n >= {CELL_ROWS}").select(F.struct("q1", "q3", "reach", "mid").alias("__kn_c1"), F.col("l").alias("__kn_l1"))
    everything = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in zip(("q1", "q3", "reach", "mid"), cells[("", -2)][1:], strict=True)])
    out = scored.withColumn("__kn_lang", lang).withColumn("__kn_band", F.expr(BAND))
    out = out.join(hint(by_cell), (F.col("__kn_lang") == F.col("__kn_l0")) & (F.col("__kn_band") == F.col("__kn_b0")), "left").join(hint(by_lang), F.col("__kn_lang") == F.col("__kn_l1"), "left")
    out = out.withColumn("__kn_cell", F.coalesce("__kn_c0", "__kn_c1", everything))
    # a mean over n characters spreads as 1 / sqrt(n): where the band has no quantiles of its own, shorter texts get more room
    room = F.expr("CASE WHEN __kn_c0 IS NOT NULL THEN 1D ELSE greatest(1D, pow(2D, (__kn_cell.mid - __kn_band) / 2)) END")
    out = out.withColumn("low", F.exp(F.col("__kn_cell.q1") - F.col("__kn_cell.reach") * room)).withColumn("high", F.exp(F.col("__kn_cell.q3") + F.col("__kn_cell.reach") * room))
    out = out.withColumn("kept", F.expr("coalesce(perplexity BETWEEN low AND high, false)"))
    return out.select(*[c for c in docs.columns if c not in MADE], *MADE)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their perplexities and bounds."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = judge(docs, common.table(spark, sf_dir, "labels"))
    return out.filter("kept").select("doc_id", "lang", "n_scored", F.round("perplexity", 6).alias("perplexity"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
