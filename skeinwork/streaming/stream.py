"""Streaming forms: debounced rebuilds, windows, duplicates and anchor state, over file sources."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import line_hash
from ..storage import cut, delete


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, leaf = path.rpartition("/")
    read = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{leaf[:-1]}[{leaf[-1]}]")
    # watermarks need an instant; the session's time zone is UTC
    return read.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in read.columns else read


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs what is there to its end into Parquet at path and reads it."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-log").outputMode(mode).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_whole(stream: DataFrame, path: str) -> DataFrame:
    """Like run_available for an aggregate: its rows as they stand at the end, windows still open too."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(path)
    # complete mode gives all rows each time, so the last batch's stand
    q = stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-log").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def debounced(changes: DataFrame, key: str = "user_id", gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row per key and burst of changes with no gap as long as `gap`: (key, first, last, n)."""
    return changes.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def rebuild_on_change(changes: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str):
    """One rebuild at a time per micro-batch; changes that come meanwhile are one batch."""
    return changes.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)


def with_previous(reads: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads (path, pos, content) with `seen` (whether the path was read before) and `before`, what it held then; and held anew:
    each path's last read (path, content), which the next batch takes.

    Reads are dealt by ranges of path and place, so a path with many of them spreads over tasks; a range's first read of a
    path gets what an earlier range, or held, has last.
    """
    dealt = reads.select("path", "pos", "content").repartitionByRange("path", "pos").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part", "path").orderBy("pos", "content")
    near = cut(dealt.select("*", F.lag("content").over(w).alias("before"), (F.row_number().over(w) == 1).alias("first"), F.lead("part").over(w).isNull().alias("last")), "reads")
    tails = near.filter("last").select("path", "part", "content")
    if held is not None:
        tails = tails.unionByName(held.select("path", F.lit(-1).alias("part"), "content"))
    order = Window.partitionBy("path").orderBy("part")
    tails = cut(tails.select("*", F.lag("part").over(order).isNotNull().alias("seen"), F.lag("content").over(order).alias("before"), F.lead("part").over(order).isNull().alias("last")), "tails")
    prior = tails.filter("part >= 0").select(F.col("path").alias("_path"), F.col("part").alias("_part"), F.col("seen"), F.col("before").alias("_before"))
    heads = near.filter("first").join(prior, (F.col("part") == F.col("_part")) & F.col("path").eqNullSafe(F.col("_path")))
    columns = ["path", "pos", "content", "before", "seen"]
    out = near.filter("NOT first").withColumn("seen", F.lit(True)).select(columns).unionByName(heads.select("path", "pos", "content", F.col("_before").alias("before"), "seen"))
    return out, tails.filter("last").select("path", "content")


#: Reads that are told at once, which bounds what a task holds of the answers; pairs of texts whose answer a task remembers.
TOLD, KNOWN = 1000, 4096


def told(reads: DataFrame, tell: Callable[[str | None, str], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of tell(before, content) for each of with_previous(); before is None for a path's first read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = functools.lru_cache(KNOWN)(tell)
        for whole in batches:
            for a in range(0, len(whole), TOLD):
                pdf = whole.iloc[a : a + TOLD]
                pairs: dict[tuple, int] = {}
                codes = np.array([pairs.setdefault(((b or "") if s else None, c or ""), len(pairs)) for b, c, s in zip(pdf.before, pdf.content, pdf.seen, strict=True)])
                answers = [known(*x) for x in pairs]
                n = np.array([len(x) for x in answers])
                start, counts = np.cumsum(n) - n, n[codes]
                rows = np.repeat(start[codes] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                out = pd.concat(answers).take(rows).reset_index(drop=True)
                for c in ("pos", "path"):
                    out.insert(0, c, pdf[c].to_numpy()[np.repeat(np.arange(len(pdf)), counts)])
                yield out

    return reads.select("path", "pos", "content", "before", "seen").mapInPandas(run, schema)


def run_told(stream: DataFrame, path: str, tell: Callable[[str | None, str], pd.DataFrame], schema: str) -> DataFrame:
    """Runs a stream of reads (path, pos, content) to its end: told() of each micro-batch, against the reads of those before.

    A batch's rows and each path's last read are written under the batch's number, so a batch that runs again
    writes the same.
    """
    spark = stream.sparkSession
    out = spark.createDataFrame([], schema)
    out.write.mode("overwrite").parquet(f"{path}/batch=-1")

    def batch(rows: DataFrame, i: int) -> None:
        held = rows.sparkSession.read.schema("path string, content string").parquet(f"{path}-held/{i - 1}") if i else None
        reads, last = with_previous(rows, held)
        told(reads, tell, schema).write.mode("overwrite").parquet(f"{path}/batch={i}")
        last.write.mode("overwrite").parquet(f"{path}-held/{i}")
        if i > 1:
            delete(rows.sparkSession, f"{path}-held/{i - 2}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select(out.columns)


CHANGED = "path string, pos long, n_lines int, n_changed int"


def changed_lines(before: str | None, content: str) -> pd.DataFrame:
    """How many lines a read has, and how many are not among those before with the same text and anchor."""
    pairs = lambda text: [(t, line_hash(i, t)) for i, t in enumerate(text.split("\n"), 1)]
    new, known = pairs(content), set() if before is None else set(pairs(before))
    return pd.DataFrame({"n_lines": [len(new)], "n_changed": [sum(x not in known for x in new)]})


def anchor_states(reads: DataFrame, path: str) -> DataFrame:
    """Of a stream (path, pos, content) that runs to its end: a row for each read, against the path's read before."""
    return run_told(reads, path, changed_lines, CHANGED).drop("pos")
