"""Scans of source trees and logs, and versioned stores of index tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 3
#: Directories that scans leave out.
IGNORED = ("node_modules", ".git", ".cache", "dist", "build", "target", "__pycache__")


def scan(spark: SparkSession, root: str, extensions: list[str], ignored: tuple[str, ...] = IGNORED, patterns: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of files under root with one of the extensions, paths relative; ignored directories and
    glob patterns (*, **, trailing / for directories) are left out; unreadable files too."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}")
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.col("path"), f"^[a-z0-9]*:?/*{re.escape(base.lstrip('/'))}/", "")
    out = read.load(root).select(path.alias("path"), F.col("content").cast("string").alias("content"))
    for name in ignored:
        out = out.filter(~F.col("path").rlike(rf"(^|/){re.escape(name)}/"))
    for p in patterns:
        out = out.filter(~F.col("path").rlike(glob_regex(p)))
    return out


def glob_regex(pattern: str) -> str:
    anchored = "/" in pattern.rstrip("/")
    body = re.escape(pattern.strip("/")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(^|/)") + body + ("/" if pattern.endswith("/") else "(/|$)")


def save(tables: dict[str, DataFrame], path: str, **meta: str) -> None:
    """Writes tables side by side and then the meta row that makes them valid."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/{name}")
    spark.createDataFrame([(VERSION, json.dumps(meta, sort_keys=True), sorted(tables))], "version int, meta string, tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, defaults: dict[str, dict[str, object]] | None = None) -> dict[str, DataFrame]:
    """The tables of a store; a store of an older version gets columns that it lacks from `defaults`, a newer one is refused."""
    head = spark.read.parquet(f"{path}/meta").first()
    if head.version > VERSION:
        raise ValueError(f"store version {head.version} is newer than {VERSION}")
    out = {}
    for name in head.tables:
        df = spark.read.parquet(f"{path}/{name}")
        for column, value in (defaults or {}).get(name, {}).items():
            if column not in df.columns:
                df = df.withColumn(column, F.lit(value))
        out[name] = df
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


SESSION = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("started_at", T.TimestampType()), T.StructField("dep_context_triggers", T.LongType()), T.StructField("total_tokens_saved", T.LongType()), T.StructField("savings_ratio", T.DoubleType()), T.StructField("total_injection_tokens", T.LongType()), T.StructField("_corrupt_record", T.StringType())])


def recent_sessions(spark: SparkSession, path: str, n: int, schema: T.StructType = SESSION) -> DataFrame:
    """The last n well-formed lines of JSON logs, latest first, logs in the order of their names; blank and broken lines are skipped.

    A line's place is the part of the file that its task read, which stands in the file's order, and its number there.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value").filter("trim(value) <> ''")
    parsed = lines.select("file", "block", "at", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = parsed.filter("r._corrupt_record IS NULL").orderBy(F.desc("file"), F.desc("block"), F.desc("at")).limit(n)
    return good.select("r.*").drop("_corrupt_record")


def append_sessions(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
