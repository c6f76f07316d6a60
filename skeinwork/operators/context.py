"""Context assembly: which files, communities and symbols a turn is about, and what they are ranked by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first

#: Paths in running text, with an optional line or line range.
PATH = r"((?:[\w.-]+/)+[\w.-]+\.\w{1,5}|[\w-]+\.(?:ts|tsx|js|jsx|py|rs|go|md|json))"
CITATION = PATH + r":(\d+)(?:-(\d+))?"


def mentioned_paths(text: str = "content") -> Column:
    """Paths that a text names, cited ones with lines first, each once."""
    cited = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.concat(cited, F.regexp_extract_all(text, F.lit(PATH), F.lit(1))))


def cited_regions(messages: DataFrame) -> DataFrame:
    """(path, start, end) of cited lines."""
    g = [F.regexp_extract_all("content", F.lit(CITATION), F.lit(i)) for i in (1, 2, 3)]
    z = messages.select(F.explode(F.arrays_zip(g[0].alias("p"), g[1].alias("a"), g[2].alias("b"))).alias("z"))
    return z.select(F.col("z.p").alias("path"), F.col("z.a").cast("long").alias("start"), F.nullif(F.col("z.b"), F.lit("")).cast("long").alias("end"))


def in_focus(mentions: DataFrame, extra: DataFrame, ranked: DataFrame, files: DataFrame, top: int = 20) -> DataFrame:
    """(path): indexed files that are mentioned, added or among the best ranked."""
    best = ranked.filter(F.col("place") <= top).select("path")
    return mentions.select("path").unionByName(extra.select("path")).unionByName(best).distinct().join(files.select("path"), "path", "left_semi")


def community_files(membership: DataFrame) -> DataFrame:
    """(community, path) of module nodes file:<path>; symbol nodes are left out."""
    rest = F.regexp_replace("node_id", "^file:", "")
    symbol = rest.contains(":") & ~F.substring_index(rest, ":", -1).rlike(r"[/.]")
    return membership.filter(F.col("node_id").startswith("file:") & ~symbol).select("community", rest.alias("path"))


def community_relevance(mentions: DataFrame, symbols_hit: DataFrame, density: DataFrame, most: int = 4) -> DataFrame:
    """(community, score): 3 if mentioned, 2 if a symbol of it is, plus density; above 0, the best few."""
    m = mentions.select("community").distinct().withColumn("_m", F.lit(3.0))
    s = symbols_hit.select("community").distinct().withColumn("_s", F.lit(2.0))
    out = density.join(m, "community", "left").join(s, "community", "left")
    score = F.coalesce("_m", F.lit(0.0)) + F.coalesce("_s", F.lit(0.0)) + F.col("density")
    return out.select("community", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "community").limit(most)


def ranked_gods(gods: DataFrame, n: int) -> DataFrame:
    """By criticality, then edges in."""
    level = F.when(F.col("criticality") == "CRITICAL", 0).when(F.col("criticality") == "IMPORTANT", 1).otherwise(2)
    return first(gods, n, "place", level, F.desc("in_degree"), F.col("node_pos"))


def priority_symbols(matched: DataFrame, gods: DataFrame, shown: DataFrame, n: int = 3) -> DataFrame:
    """(label): gods that symbols matched, or the first n of all where none did, without those shown already."""
    none = matched.agg((F.count(F.lit(1)) == 0).alias("_none"))
    fallback = ranked_gods(gods, n).join(F.broadcast(none)).filter("_none").select("label")
    return matched.select("label").distinct().unionByName(fallback).join(shown.select("label"), "label", "left_anti")


def cycle_warning(found: DataFrame, focus: DataFrame) -> DataFrame:
    """One row: the first cycle with a focus file on it, a general note if there are other cycles, else none."""
    hit = found.select("root_pos", "found", F.explode("members").alias("node_id")).join(focus.select("node_id"), "node_id", "left_semi").agg(F.min(F.struct("root_pos", "found")).alias("first"))
    n = found.agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("first").isNotNull(), "focus").when(F.col("n") > 0, "general").otherwise("none")
    return hit.join(F.broadcast(n)).select(kind.alias("warning"), F.col("first.root_pos").alias("root_pos"), F.col("first.found").alias("found"))


def lookup(wanted: DataFrame, files: DataFrame, gods: DataFrame) -> DataFrame:
    """(symbol, path, node_id): the file's symbol node if listed, else a god of that label, else the file's node."""
    a = wanted.join(files.select("path", "symbol").distinct(), ["path", "symbol"]).select("symbol", "path", F.lit(0).alias("p"), F.concat(F.lit("file:"), "path", F.lit(":"), "symbol").alias("node_id"))
    b = wanted.join(gods.select(F.col("label").alias("symbol"), "node_id"), "symbol").select("symbol", "path", F.lit(1).alias("p"), "node_id")
    c = wanted.select("symbol", "path", F.lit(2).alias("p"), F.concat(F.lit("file:"), "path").alias("node_id"))
    return a.unionByName(b).unionByName(c).groupBy("symbol", "path").agg(F.min(F.struct("p", "node_id")).alias("x")).select("symbol", "path", "x.node_id")


def trigger(flags: dict[str, Column]) -> Column:
    """The first flag that holds, by name, or null."""
    out = F.lit(None).cast("string")
    for name, flag in reversed(flags.items()):
        out = F.when(flag, name).otherwise(out)
    return out


def token_metrics(gods: Column, nodes: Column, active: Column, communities: Column) -> Column:
    """struct(coverage, active_ratio, savings): savings are 50 lines of 80 characters a community left out."""
    return F.struct(F.when(nodes > 0, gods / nodes).otherwise(0.0).alias("coverage"), F.when(communities > 0, active / communities).otherwise(1.0).alias("active_ratio"), (F.greatest(F.lit(0), communities - active) * 50 * 80).alias("savings"))


def throughput(nodes: Column, ms: Column) -> Column:
    return F.when(ms > 0, F.floor(nodes / ms + 0.5)).otherwise(0).cast("long")


#: Parts of what a turn injects, whose tokens are added up.
INJECTED = ("repo_map", "dep_context", "context_files", "guidance", "graph_insights", "intelligence", "smart_dep_context")


def injection_total() -> Column:
    """The tokens of all parts of a row; parts that are missing count nothing."""
    total = F.lit(0).cast("long")
    for name in INJECTED:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total


def distinct_counts(found: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: nodes on surprising edges (src, dst), such edges, and communities."""
    nodes = found.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.count_distinct("v").alias("surprise_nodes"))
    edges = found.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("surprises"))
    return nodes.join(F.broadcast(edges)).join(F.broadcast(membership.agg(F.count_distinct("community").alias("communities"))))
