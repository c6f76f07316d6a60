"""Indexes from first parse to cache, refreshes and telemetry: what runs around the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import parsers, store
from ..storage import cut, drop
from . import lines


#: Of the current version (None before the first) and fresh rows, the next version.
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def source_mark(files: DataFrame) -> str:
    """A mark of all paths and contents, whatever their order."""
    one = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("path", "content").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return f"{one.n}-{one.h}"


def index(spark: SparkSession, files: DataFrame, root: str) -> tuple[str, DataFrame]:
    """('cache' or 'fresh', the index) of source files (path, content): what was stored for just these, or a new parse that
    takes over rows of the last one whose content is the same."""
    mark, last = source_mark(files), f"{root}/last"
    if store.exists(spark, f"{root}/{mark}"):
        return "cache", store.load(spark, f"{root}/{mark}")["files"]
    old = None
    if store.exists(spark, last):
        old = store.load(spark, last)["files"]
    store.save({"files": parsers.parse_files(files, old)}, f"{root}/{mark}", mark=mark)
    out = store.load(spark, f"{root}/{mark}")["files"]
    store.save({"files": out}, last, mark=mark)
    return "fresh", out


def diffs(texts: DataFrame, context: int = 4) -> DataFrame:
    """(id, diff) of (id, before, after): numbered unified diffs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "diff": [lines.numbered_diff(a or "", b or "", context) for a, b in zip(pdf.before, pdf.after, strict=True)]})

    return texts.select("id", "before", "after").mapInPandas(run, "id long, diff string")


def whole(value: float | None) -> int | None:
    """Numbers of structs come as floats where some are missing."""
    return None if value is None or value != value else int(value)


def edited_files(edits: DataFrame) -> DataFrame:
    """(id, text, first_changed, written, problem) of files (id, text, edits, dry_run), edits an array of structs (op, line,
    end, lines); a file whose edits do not fit keeps its text and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                todo = [{"op": e["op"], "line": whole(e["line"]), "end": whole(e["end"]), "lines": list(e["lines"] if e["lines"] is not None else ())} for e in r.edits]
                try:
                    out = lines.edit_file(r.text, todo, bool(r.dry_run))
                    rows.append((r.id, out["text"], out["first_changed"], out["written"], None))
                except (ValueError, IndexError) as e:
                    rows.append((r.id, r.text, None, False, str(e)))
            yield pd.DataFrame(rows, columns=["id", "text", "first_changed", "written", "problem"]).astype({"first_changed": "Int64"})

    return edits.select("id", "text", "edits", "dry_run").mapInPandas(run, "id long, text string, first_changed long, written boolean, problem string")


def point_to(spark: SparkSession, path: str, version: int) -> None:
    """Makes a version the current one by one rename over the pointer, so a reader sees the former or this one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, at = jvm.org.apache.hadoop.fs.Path(f"{path}/pointer-{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/pointer")
    out = at.getFileSystem(conf).create(new, True)
    out.writeLong(version)
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(new, at, how)


def current_version(spark: SparkSession, path: str) -> int | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    held = fs.open(at)
    try:
        return held.readLong()
    finally:
        held.close()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The index as the last successful rebuild left it."""
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/version-{version}")


def upsert(*keys: str) -> Merge:
    """A merge by which fresh rows take the place of old ones with their keys."""
    return lambda old, fresh: fresh if old is None else old.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def follow(changes: DataFrame, path: str, rebuild: Callable[[DataFrame], DataFrame], merge: Merge):
    """A stream writer that brings the index at path up to date by every micro-batch.

    What rebuild makes of a batch is merged with the current version into a version of its own, and then the pointer
    moves there; a batch that fails leaves the current version as it is, and one that is told again after a crash is
    known by its number. One rebuild runs at a time; changes that come meanwhile are the next batch. The version before
    the current one stays for its readers, older ones go.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = current_version(spark, path)
        if last is not None and last >= number:
            return
        fresh = rebuild(batch)
        old = current(spark, path)
        # the fresh rows stand in a merge more than once, the batch is read once
        fresh = cut(fresh, "fresh")
        merge(old, fresh).write.mode("overwrite").parquet(f"{path}/version-{number}")
        drop(fresh)
        point_to(spark, path, number)
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for at in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version-*")) or ():
            if int(at.getPath().getName().rpartition("-")[2]) < (number if last is None else last):
                fs.delete(at.getPath(), True)

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}-log")


def rebuilt(changes: DataFrame, path: str, rebuild: Callable[[DataFrame], DataFrame], merge: Merge) -> DataFrame | None:
    """The index once all changes that there are have been followed; None before the first."""
    follow(changes, path, rebuild, merge).trigger(availableNow=True).start().awaitTermination()
    return current(changes.sparkSession, path)


def file_index(spark: SparkSession, root: str, extensions: list[str], as_path: Callable[[Column], Column] = lambda path: path) -> tuple[Callable[[DataFrame], DataFrame], Merge]:
    """rebuild and merge of an index of source files that follows the changes of their tree: files created or changed are
    parsed, those deleted go. as_path makes the path by which a parser is chosen."""

    def rebuild(changes: DataFrame) -> DataFrame:
        last = changes.groupBy("path").agg(F.max_by("kind", "snapshot").alias("kind"))
        texts = store.scan(spark, root, extensions).join(last.filter("kind <> 'deleted'"), "path", "left_semi")
        return last.join(parsers.parse_files(texts.withColumn("named", as_path(F.col("path"))), by="named"), "path", "left")

    def merge(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
        good = fresh.filter("kind <> 'deleted' AND language IS NOT NULL")
        # a file that cannot be parsed keeps its last good row
        return good if old is None else old.join(fresh.filter("kind = 'deleted' OR language IS NOT NULL").select("path"), "path", "left_anti").unionByName(good)

    return rebuild, merge


def appended(records: DataFrame, path: str) -> DataFrame:
    """A stream of session records appended to JSON logs, and these read back, broken lines left out."""
    records.writeStream.format("json").option("checkpointLocation", f"{path}-log").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return records.sparkSession.read.schema(records.schema).option("mode", "DROPMALFORMED").json(path)
