"""Budgeted selections: folds that skip what does not fit and go on, trims and samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import placed


def estimate_tokens(text: str) -> Column:
    """A quarter of the UTF-16 length, rounded up; of null or empty text 0."""
    units = F.octet_length(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-16BE")) / 2
    return F.ceil(units / 4).cast("long")


def greedy(items: DataFrame, budget: int, first_always: bool = False) -> DataFrame:
    """(grp, id, cost) admitted per group in order of pos: an item that does not fit the rest of the budget is skipped.

    Sorted partitions are streamed: a group's state is one number, however long the group.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, n = object(), 0, 0
        for pdf in batches:
            keep = []
            for grp, cost in zip(pdf.grp, pdf.cost, strict=True):
                if grp != group:
                    group, used, n = grp, 0, 0
                ok = used + cost <= budget or first_always and n == 0
                used, n = used + cost * ok, n + 1
                keep.append(bool(ok))
            yield pdf.loc[keep, ["grp", "id", "cost"]]

    kinds = dict(items.dtypes)
    ordered = items.repartition("grp").sortWithinPartitions("grp", "pos")
    return ordered.mapInPandas(fold, f"grp {kinds['grp']}, id {kinds['id']}, cost {kinds['cost']}")


def suffix_trim(lines: DataFrame, budget: int) -> DataFrame:
    """Per group the lines (pos, line, header) up to a total of `budget` characters with their breaks; headers left at the end go."""
    w = Window.partitionBy("grp").orderBy("pos")
    kept = lines.withColumn("_sum", F.sum(F.length("line") + 1).over(w)).filter(F.col("_sum") - 1 <= budget).drop("_sum")
    last = F.max(F.when(~F.col("header"), F.col("pos"))).over(Window.partitionBy("grp"))
    return kept.withColumn("_last", last).filter("pos <= _last").drop("_last")


def even_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows at an even stride in order of pos: a report's sample."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    each = placed(rows, "_place", "pos").withColumn("_i", F.col("_place") - 1).drop("_place").join(F.broadcast(n))
    k = F.least(F.lit(most), F.col("_n"))
    # row i is taken when some j has floor(j * n / k) = i
    j = F.ceil(F.col("_i") * k / F.col("_n"))
    return each.filter((j < k) & (F.floor(j * F.col("_n") / k) == F.col("_i"))).drop("_i", "_n")
