"""Graph, message, file and session views over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, keep: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nations, and edges from a customer's nation to the three suppliers' nations it buys from most.

    The edges are computed once for a query, whose branches all read them: a few rows from a join of four tables.
    """
    t = lambda name: table(spark, sf_dir, name)
    nodes = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.col("n_nationkey").cast("long").alias("node_pos"))
    # count per order and supplier side first: lineitem is read for two columns only
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("d")), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "d").agg(F.count(F.lit(1)).alias("n"))
    buyers = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("s")), F.col("o_custkey") == F.col("c_custkey"))
    pairs = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("s", "d").agg(F.sum("n").alias("n"))
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "d"))).filter(F.col("r") <= keep)
    edges = ranked.select(F.concat(F.lit("n"), "s").alias("src"), F.concat(F.lit("n"), "d").alias("dst"), (F.col("s").cast("long") * keep + F.col("r") - 1).alias("edge_pos"), F.col("n").cast("double").alias("weight"))
    return nodes, cut(edges, "trade")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from child to parent: orders, customers, nations, regions."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey").unionByName(edge(t("customer"), "c", "c_custkey", "n", "c_nationkey")).unionByName(edge(t("orders"), "o", "o_orderkey", "c", "o_custkey"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each event type of a user to the next, a multigraph of few nodes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"))
    return events.filter("dst IS NOT NULL").select("src", "dst", F.col("event_id").alias("edge_pos"))


def web(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages and the paths that their anchors name."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("i", "path"))
    nodes = pages.select(F.concat(F.lit("p"), "page_id").alias("node_id"), F.col("page_id").alias("node_pos"))
    return nodes, links.select(F.concat(F.lit("p"), "page_id").alias("src"), F.col("path").alias("dst"), (F.col("page_id") * 1000 + F.col("i")).alias("edge_pos"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' regions as a fixed community of each: (node_id, community)."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("community"))


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool messages: conv_id, pos, role, is_error, path, content."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("pos"), F.lit("tool").alias("role"), (F.col("event_type") == "error").alias("is_error"), F.get_json_object("props", "$.k").alias("path"), F.col("event_type").alias("tool_name"), F.col("value"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("conv_id"), F.col("doc_id").alias("pos"), F.lit("user").alias("role"), F.col("text").alias("content"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as indexed files: pos, path, stem, dir."""
    p = table(spark, sf_dir, "part")
    stem = F.regexp_replace("p_name", " ", "_")
    return p.select(F.col("p_partkey").alias("pos"), F.concat_ws("/", F.col("p_brand"), F.concat(stem, F.lit("_"), F.col("p_partkey"), F.lit(".ts"))).alias("path"), F.concat(stem, F.lit("_"), F.col("p_partkey")).alias("stem"), F.col("p_brand").alias("dir"), "p_name")


def part_symbols(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(symbol, path, pos): words of part names as exported symbols, dealt out by path where they are counted by it."""
    f = part_files(spark, sf_dir)
    # before they grow: tasks of a scan are as large as a file's row groups, and would count all that is in one
    f = f.select("path", "pos", "p_name").repartition("path") if dealt else f
    return f.select("path", "pos", F.posexplode(F.split("p_name", " ")).alias("i", "symbol")).select("symbol", "path", (F.col("pos") * 100 + F.col("i")).alias("pos"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).select(F.col("doc_id"), (F.col("i") + 1).cast("long").alias("line_no"), "text")


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions of telemetry."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), F.col("o_orderpriority").alias("index_source"), (F.col("o_custkey") % 7).cast("long").alias("dep_context_triggers"), F.floor(price / 100).cast("long").alias("total_tokens_saved"), F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.floor(price / 250)).cast("long").alias("total_injection_tokens"))
