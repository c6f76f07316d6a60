"""A graph's whole analysis, its cache, and what an index says about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as p
from ..sources import store
from . import context, graph, telemetry


def assembled(nodes: DataFrame, edges: DataFrame, membership: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of a graph's analysis by name; each is computed when it is read."""
    degrees = graph.degree_centrality(nodes, edges)
    ranks = graph.pagerank(nodes, edges)
    membership = graph.communities(nodes, edges).select("node_id", F.col("seed").alias("community")) if membership is None else membership
    found = graph.cycles(nodes, edges)
    gods = graph.gods_by_connectivity(nodes, edges).select("node_id")
    out = {
        "god_nodes": gods.join(graph.node_roles(degrees, ranks, membership), "node_id"),
        "communities": graph.community_profiles(membership, nodes, edges),
        "surprises": graph.surprises(edges, membership),
        "bottlenecks": graph.assembled_bottlenecks(degrees),
        "cycles": found,
        "anomalies": graph.remapped(graph.anomalies(degrees, found)),
    }
    counts = [out[k].agg(F.count(F.lit(1)).alias(n)) for k, n in (("god_nodes", "god_node_count"), ("communities", "community_count"), ("cycles", "cycle_count"), ("bottlenecks", "bottleneck_count"))]
    metrics = graph.graph_metrics(nodes, edges).join(F.broadcast(degrees.agg(F.coalesce(F.max("total_degree"), F.lit(0)).alias("max_degree")))).join(F.broadcast(graph.average_clustering(nodes, edges)))
    for c in counts:
        metrics = metrics.join(F.broadcast(c))
    return out | {"metrics": metrics}


def summary(god_count: Column, nodes: Column, communities: Column, active: Column, cycle_count: Column, ms: Column, cached: Column) -> Column:
    """struct(quality, performance, token) of a graph's metrics."""
    tokens = context.token_metrics(god_count, nodes, active, communities)
    return F.struct(graph.quality_score(cycle_count, god_count, communities).alias("quality"), F.struct(context.throughput(nodes, ms).alias("throughput"), cached.alias("cache_hit")).alias("performance"), tokens.alias("token"))


def save_graph(nodes: DataFrame, edges: DataFrame, root: str, **parts: DataFrame) -> str:
    """Writes a graph, and parts of its analysis, under its fingerprint; returns that."""
    mark = graph.fingerprint(nodes, edges).first().fingerprint
    store.save({"nodes": nodes, "edges": edges, **parts}, f"{root}/{mark}", fingerprint=mark)
    return mark


def load_graph(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame] | None:
    """What was saved for a graph of just this content, or None."""
    mark = graph.fingerprint(nodes, edges).first().fingerprint
    return store.load(spark, f"{root}/{mark}") if store.exists(spark, f"{root}/{mark}") else None


def drop_graphs(spark: SparkSession, root: str) -> int:
    """Deletes all saved graphs; returns how many there were."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = len(fs.listStatus(at)) if fs.exists(at) else 0
    fs.delete(at, True)
    return n


def index_metadata(files: DataFrame, symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """One row: files, symbols, edges, sorted languages."""
    a = files.agg(F.count(F.lit(1)).alias("file_count"), F.array_join(F.array_sort(F.collect_set(p.language(F.col("path")))), ",").alias("languages"))
    b, c = symbols.agg(F.count(F.lit(1)).alias("symbol_count")), deps.agg(F.count(F.lit(1)).alias("edge_count"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select("file_count", "symbol_count", "edge_count", "languages")


def language_coverage(files: DataFrame, symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """(language, files, symbols, edges), by the language of the file that has them."""
    own = files.select("path", p.language(F.col("path")).alias("language"))
    s = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("s"))
    e = deps.groupBy(F.col("src").alias("path")).agg(F.count_distinct("dst").alias("e"))
    each = own.join(s, "path", "left").join(e, "path", "left")
    return each.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


#: Counters of a session's record that are left out when they are 0.
OPTIONAL = ("community_prune_count", "edits", "dry_runs", "mismatches", "go_to_def", "find_refs", "hover")


def session_record(sessions: DataFrame) -> DataFrame:
    """Sessions as they are stored: optional counters of 0 become null, the savings ratio has two digits."""
    cols = [F.nullif(F.col(c), F.lit(0)).alias(c) if c in OPTIONAL else telemetry.half_up(F.col(c), 2).alias(c) if c == "savings_ratio" else F.col(c) for c in sessions.columns]
    return sessions.select(*cols)


def session_line(sessions: DataFrame, mentions: DataFrame, top: int = 3) -> DataFrame:
    """(session_id, line): one line on each session (session_id, index_source, files, saved, savings_ratio) with its most
    mentioned files (session_id, path, n, pos), ties in the order of mention."""
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), "pos")
    best = mentions.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= top)
    tops = best.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(p.base_name(F.col("path")), F.lit("×"), F.col("n").cast("string")).alias("t")))).alias("l"))
    out = sessions.join(tops, "session_id", "left")
    saved = F.when(F.col("saved") > 0, F.concat(F.lit("saved ~"), F.col("saved").cast("string"), F.lit("t ("), telemetry.half_up(F.col("savings_ratio") * 100).cast("long").cast("string"), F.lit("%)")))
    top_files = F.when(F.col("l").isNotNull(), F.concat(F.lit("top: "), F.array_join(F.transform("l", lambda v: v.t), ", ")))
    head = F.concat(F.lit("index: "), F.col("files").cast("string"), F.lit(" files ("), "index_source", F.lit(")"))
    return out.select("session_id", F.concat_ws("  |  ", head, saved, top_files).alias("line"))


def prioritised_map(repo_map: str, communities: DataFrame, gods: DataFrame) -> str:
    """A repository map under the communities (label, community, size) and hubs (label, criticality, in_degree, community)
    that a turn is about; both are short lists. An empty map stays as it is."""
    if not repo_map.strip():
        return repo_map
    lists = []
    if rows := communities.collect():
        lists.append("Communities first:\n" + "\n".join(f"- **{r.label}** (`{r.community}`, {r['size']} nodes)" for r in rows))
    if rows := gods.collect():
        lists.append("Hubs:\n" + "\n".join(f"- `{r.label}`: {r.criticality}, {r.in_degree} files depend on it (community: {r.community})" for r in rows))
    return "\n\n".join([*lists, "---", repo_map]) if lists else repo_map


def dependency_boost(scored: DataFrame, active: DataFrame) -> DataFrame:
    """(path, score, signal): 1 more for scored files among the active ones' dependencies (path)."""
    near = active.select("path").distinct().withColumn("_near", F.lit(1).cast("long"))
    return scored.join(near, "path", "left").select("path", (F.col("score") + F.coalesce("_near", F.lit(0))).alias("score"), F.when(F.col("_near") == 1, "dep-proximity").alias("signal"))


def explained(scored: DataFrame) -> DataFrame:
    """(path, explanation) of (path, score, signals)."""
    return scored.select("path", F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(": "), F.replace(F.col("signals"), F.lit(","), F.lit(", "))).alias("explanation"))
