"""Tables in the folder that driver and executors share, where plans are cut."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset and the master is local (tests), a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root()


@functools.cache
def _local_root() -> str:
    made = tempfile.TemporaryDirectory(prefix="skeinwork-")
    atexit.register(made.cleanup)
    return f"file://{made.name}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Computes df once into Parquet; the result's lineage is that file."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame | None) -> None:
    """Deletes what cut() wrote for these; nothing that is still read may depend on them."""
    for df in tables:
        if path := getattr(df, "_cut_path", None) if df is not None else None:
            delete(df.sparkSession, path)
