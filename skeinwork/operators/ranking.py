"""Places of rows in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut


def placed(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with each row's place in the order, from 1.

    Rows are dealt out by ranges of the order and numbered within their range; the ranges' sizes, a row each, give
    where a range begins.
    """
    ordered = df.orderBy(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"))
    ordered = cut(ordered, "ordered")
    sizes = ordered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_start")
    return ordered.join(F.broadcast(starts), "_range").select(*df.columns, place.alias(name))


def first(df: DataFrame, n: int, name: str, *order: Column | str) -> DataFrame:
    """The first n rows of an order with their places: a top-k first, then numbers for what is left."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))
