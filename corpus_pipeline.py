"""Documents to packed training sequences: STAGES, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import common, decontaminate, ngram_join, packing, quality, suffix


OWN = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated string that the third stage cuts: passages of over 50 words are longer in nearly all cases.
REPEAT_BYTES = 300
#: A column that no shielded table has.
ROW = "row number"


def shielded(docs: DataFrame) -> DataFrame:
    """docs with columns beyond those of documents under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in OWN else f"extra column {i}") for i, c in enumerate(docs.columns)])


def restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(c if c in OWN else f"`extra column {i}`").alias(c) for i, c in enumerate(docs.columns)])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.

    Null and empty texts are rejected; without trusted documents nothing is. Repeated rows
    are judged alike, rows without language as one language; an empty table stays empty.
    """
    return restored(quality.judge(shielded(docs), common.table(spark, sf_dir, "labels")).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows that with the smallest id stays, or one without an id where none has one.

    Rows are told apart by file and place, not by id: a repeated row is a copy of the
    first, different texts of one id are judged each by itself, and null and empty texts,
    which link with nothing, all stay.
    """
    rows = common.with_row_key(shielded(docs), ROW)
    groups = ngram_join.jaccard_classes(rows, ROW).select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW)
    leads = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("lead")).select(F.col("lead")[ROW].alias(ROW))
    return restored(rows.join(leads, ROW, "left_semi"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeats; n_chars follows.

    Null texts stay null, texts that lose nothing stay as they are, one that repeats as a
    whole becomes empty; repeated rows count as occurrences of their own.
    """
    out = suffix.dedup(shielded(docs), width=REPEAT_BYTES)
    changed = F.col("n_removed") > 0
    out = out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    return restored(out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their ids; null and empty texts hold none and stay."""
    rows = common.with_row_key(shielded(docs), ROW)
    found = decontaminate.find_overlaps(rows, common.table(spark, sf_dir, "benchmark"), doc_id=ROW)
    return restored(rows.join(found.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; null and empty texts have the end id alone, repeated rows are packed each on its own."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack),
]
#: The stages are models, bytes and tokens: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = common.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            common.delete_folder(spark, before)
        before = path
    return docs
