"""Graph analytics on two DataFrames: nodes (node_id, node_pos) and edges (src, dst, edge_pos).

Graphs are directed multigraphs; self-loops and endpoints that are not among the
nodes are allowed. Rankings end with node_pos, the order in which nodes were given.
Loops return to the driver for one number a round and cut lineage in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop
from .backedges import back_edges
from .ranking import placed
from .wavefront import label_moves


#: Edges of a graph that one task works through in memory; larger ones go in rounds over all tasks.
TASK_EDGES = 100_000


def in_one_task(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel's rows for all of a table that is known to be small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield kernel(pd.concat(held, ignore_index=True))

    return rows.repartition(1).mapInPandas(run, schema)


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In-, out- and total degree over edge rows, and total over the largest total; isolated nodes have zeros."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counts = ends.groupBy("e.node_id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    out = nodes.select("node_id", "node_pos").join(counts, "node_id", "left").fillna(0, ["in_degree", "out_degree"])
    out = out.withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))
    top = out.agg(F.max("total_degree").alias("top"))
    return out.join(F.broadcast(top)).withColumn("normalized", F.when(F.col("top") > 0, F.col("total_degree") / F.col("top")).otherwise(0.0)).drop("top")


def degree_stats(degrees: DataFrame) -> DataFrame:
    """Largest, mean and median (halves between the middle two) of each degree; no nodes: 0, 0 and null."""
    aggs = []
    for kind in ("in", "out", "total"):
        c = F.col(f"{kind}_degree")
        aggs += [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(f"max_{kind}"), F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{kind}"), F.percentile(c, F.lit(0.5)).alias(f"median_{kind}")]
    return degrees.agg(*aggs)


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, directed and undirected density, mean degree."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))
    both = n.join(F.broadcast(m))
    pairs = F.col("n") * (F.col("n") - 1)
    return both.select(
        F.col("n").alias("total_nodes"),
        F.col("m").alias("total_edges"),
        F.when(F.col("n") > 1, F.col("m") / pairs).otherwise(0.0).alias("density"),
        F.when(F.col("n") > 1, F.col("m") / (pairs / 2)).otherwise(0.0).alias("undirected_density"),
        F.when(F.col("n") > 0, 2 * F.col("m") / F.col("n")).otherwise(0.0).alias("average_degree"),
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions, self-loops once."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.a", "e.b").distinct()


def average_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean local clustering over nodes with two neighbours at least; a self-loop makes a node its own neighbour."""
    near = cut(undirected(edges), "undirected")
    degree = near.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.max((F.col("a") == F.col("b")).cast("int")).alias("loop"))
    # every edge points to the end with more neighbours, so that a hub heads few wedges
    ends = near.filter("a < b").join(degree.select("a", F.col("k").alias("ka")), "a").join(degree.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
    up = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    arcs = cut(ends.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")), "arcs")
    wedges = arcs.join(arcs.select("u", F.col("v").alias("w")), "u").filter("v < w")
    closing = arcs.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w"))
    triangles = wedges.join(closing, ["v", "w"], "left_semi").select(F.explode(F.array("u", "v", "w")).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("tri"))
    # a node that is its own neighbour is linked with each other one
    held = degree.filter("k >= 2").join(nodes.select(F.col("node_id").alias("a")), "a", "left_semi").join(triangles, "a", "left")
    tri = F.coalesce("tri", F.lit(0)) + F.col("loop") * (F.col("k") - 1)
    local = held.select((tri / (F.col("k") * (F.col("k") - 1) / 2)).alias("c"))
    return local.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("clustering"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 30, tolerance: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """(node_id, node_pos, raw, score): Jacobi rounds; the mass of nodes without edges out is lost.

    Edges to unknown nodes count towards their source's degree. score is raw over the largest raw.
    """
    n = nodes.count()
    base = (1 - damping) / max(n, 1)
    ids = nodes.select("node_id", "node_pos")
    # multi-edges as one weighted edge: one shuffle of the edges for all rounds
    out_degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    weighted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(out_degree, "src").select("src", "dst", (F.col("k") / F.col("out")).alias("share"))
    weighted = cut(weighted, "pagerank-edges")
    if max(n, weighted.count()) <= TASK_EDGES:

        def rounds(t: pd.DataFrame) -> pd.DataFrame:
            own, arcs = t[t.share.isna()], t[~t.share.isna()]
            place = {v: i for i, v in enumerate(own.node_id)}
            known = arcs.src.isin(place) & arcs.dst.isin(place)
            a, b = (arcs[c][known].map(place).to_numpy(np.int64) for c in ("src", "dst"))
            share, raw = arcs.share[known].to_numpy(), np.full(len(own), 1.0 / max(n, 1))
            for _ in range(iterations):
                new = base + damping * np.bincount(b, raw[a] * share, len(own))
                change, raw = np.abs(new - raw).max(initial=0.0), new
                if tolerance > 0 and change <= tolerance:
                    break
            return own[["node_id", "node_pos"]].assign(raw=raw)

        both = ids.select("node_id", "node_pos", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("share"))
        arcs = weighted.select(F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("long").alias("node_pos"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "share")
        found = cut(in_one_task(both.unionByName(arcs), rounds, "node_id string, node_pos long, raw double"), "pagerank")
        drop(weighted)
        return scaled(found)
    rank, before = ids.withColumn("raw", F.lit(1.0 / max(n, 1))), None
    for i in range(iterations if n else 0):
        sent = weighted.join(rank.select(F.col("node_id").alias("src"), "raw"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("raw") * F.col("share")).alias("got"))
        step = rank.join(sent, "node_id", "left").select("node_id", "node_pos", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("new"), F.col("raw").alias("old"))
        if tolerance > 0 or (i + 1) % cut_every == 0:
            step = cut(step, "pagerank")
            drop(before)
            before = step
        rank = step.select("node_id", "node_pos", F.col("new").alias("raw"))
        if tolerance > 0 and (step.agg(F.max(F.abs(F.col("new") - F.col("old")))).first()[0] or 0.0) <= tolerance:
            break
    return scaled(rank)


def scaled(rank: DataFrame) -> DataFrame:
    """(node_id, node_pos, raw, score): raw over the largest raw."""
    top = rank.agg(F.max("raw").alias("top"), F.least(F.min("raw"), F.lit(0.0)).alias("low"))
    span = F.col("top") - F.col("low")
    return rank.join(F.broadcast(top)).select("node_id", "node_pos", "raw", F.when(span > 0, (F.col("raw") - F.col("low")) / span).otherwise(0.0).alias("score"))


def pagerank_stats(ranks: DataFrame) -> DataFrame:
    """Of score: max, min, mean, median, population deviation and the nearest-rank 95th percentile; zeros without nodes."""
    one = ranks.agg(F.max("score").alias("max"), F.min("score").alias("min"), F.avg("score").alias("avg"), F.percentile("score", F.lit(0.5)).alias("median"), F.stddev_pop("score").alias("std"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY score)").alias("p95"))
    return one.select(*[F.coalesce(c, F.lit(0.0)).alias(f"{c}_score") for c in ("max", "min", "avg", "median", "std", "p95")])


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows in an order; 0 means all."""
    ordered = df.orderBy(*order)
    return ordered.limit(limit) if limit else ordered


def gods_by_pagerank(ranks: DataFrame, least: float = 0.1, limit: int = 0) -> DataFrame:
    return top(ranks.filter(F.col("score") >= least), limit, F.desc("score"), F.col("node_pos"))


def combined_importance(degrees: DataFrame, ranks: DataFrame, degree_weight: float = 0.4, rank_weight: float = 0.6) -> DataFrame:
    joined = degrees.join(ranks.select("node_id", "score"), "node_id", "left")
    return joined.select("node_id", "node_pos", (degree_weight * F.col("normalized") + rank_weight * F.coalesce("score", F.lit(0.0))).alias("importance"))


def gods_by_degree(degrees: DataFrame, least: int = 3) -> DataFrame:
    return degrees.filter(F.col("in_degree") >= least)


def bottlenecks_by_degree(degrees: DataFrame, least: int = 5) -> DataFrame:
    return degrees.filter(F.col("out_degree") >= least)


def rank_by_in_degree(degrees: DataFrame, limit: int = 10) -> DataFrame:
    return top(degrees, limit, F.desc("in_degree"), F.col("node_pos"))


def gods_by_connectivity(nodes: DataFrame, edges: DataFrame, share: float = 0.1) -> DataFrame:
    """The share of endpoints, rounded up, with most edge ends; ties in locale order. Self-loops are two ends but one incident edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("connectivity"))
    ends = nodes.select("node_id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node_id"))).distinct().join(ends, "node_id", "left").fillna(0, ["connectivity"])
    loops = edges.filter("src = dst").groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("loops"))
    counts = nodes.agg(F.count(F.lit(1)).alias("n"))
    ranked = placed(ends, "place", F.desc("connectivity"), F.collate("node_id", "UNICODE"))
    kept = ranked.join(F.broadcast(counts)).filter(F.col("place") <= F.ceil(F.lit(share) * F.col("n")))
    return kept.join(loops, "node_id", "left").select("node_id", "connectivity", F.col("place").cast("int").alias("place"), ((F.col("connectivity") - F.coalesce("loops", F.lit(0))) / F.col("n")).alias("centrality"), F.lit(0.5).alias("influence"))


def criticality(in_degree: str = "in_degree") -> Column:
    return F.when(F.col(in_degree) > 20, "CRITICAL").when(F.col(in_degree) > 10, "IMPORTANT").otherwise("NORMAL")


def assembled_bottlenecks(degrees: DataFrame, over: int = 10) -> DataFrame:
    return degrees.filter(F.col("out_degree") > over).select("node_id", F.lit(0.0).alias("betweenness"), F.col("out_degree").alias("dependent_count"))


def min_labels(edges: DataFrame) -> DataFrame:
    """(node_id, component) of every endpoint: the smallest node_id reachable, edges taken both ways.

    A round takes the least label among neighbours and then jumps to that label's own label.
    """
    near = cut(undirected(edges), "undirected")
    if near.count() <= 2 * TASK_EDGES:

        def join(t: pd.DataFrame) -> pd.DataFrame:
            names, ends = np.unique(np.concatenate([t.a.to_numpy(str), t.b.to_numpy(str)]), return_inverse=True)
            a, b, label = ends[: len(t)], ends[len(t) :], np.arange(len(names))
            while len(a):
                x, y = label[a], label[b]
                apart = x != y
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(up := label[label], label):
                    label = up
            return pd.DataFrame({"node_id": names, "component": names[label]})

        found = cut(in_one_task(near, join, "node_id string, component string"), "labels")
        drop(near)
        return found
    labels = held = cut(near.groupBy(F.col("a").alias("node_id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        least = near.join(labels.select(F.col("node_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("seen"))
        hooked = labels.join(least, "node_id").select("node_id", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = hooked.select(F.col("node_id").alias("component"), F.col("component").alias("further"))
        new = cut(hooked.join(jump, "component", "left").select("node_id", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        drop(held)
        labels, held = new.select("node_id", "component"), new
        if new.filter("component < old").isEmpty():
            drop(near)
            return labels


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component) of nodes and endpoints; component is the member that comes first among the nodes."""
    everyone = nodes.select("node_id", "node_pos")
    labels = everyone.select("node_id").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node_id"))).distinct().join(min_labels(edges), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("label"))
    first = labels.join(everyone, "node_id", "left").groupBy("label").agg(F.min_by(F.col("node_id"), F.coalesce("node_pos", F.lit(2**62))).alias("component"))
    return labels.join(first, "label").select("node_id", "component")


def cohesion(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of several members with their size and internal edges over possible pairs."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    inner = edges.join(components.select(F.col("node_id").alias("src"), "component"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("internal"))
    return sizes.join(inner, "component", "left").select("component", "size", (F.coalesce("internal", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2)).alias("cohesion"))


def communities(nodes: DataFrame, edges: DataFrame, passes: int = 10) -> DataFrame:
    """(node_id, seed, seed_pos, joined, passes); community k is the k-th seed by position, members in order of joining.

    joined is the pass of the node's last move (0 for none), within which node_pos tells the order; passes those that
    the node's component took, the one without a move included.
    """
    moves = cut(label_moves(nodes, edges, passes), "communities")
    parts = connected_components(nodes, edges)
    took = moves.join(parts, "node_id").groupBy("component").agg(F.least(F.max("moved") + 1, F.lit(passes)).alias("passes"))
    seeds = moves.select(F.col("node_id").alias("seed"), F.col("node_pos").alias("seed_pos"))
    return moves.join(seeds, "seed").join(parts, "node_id").join(took, "component").select("node_id", "seed", "seed_pos", F.col("moved").alias("joined"), "passes")


def emitted(membership: DataFrame) -> DataFrame:
    """Communities whose seed does not sit in one emitted before; (seed, seed_pos)."""
    seeds = membership.select("seed", "seed_pos").distinct()
    where = membership.select(F.col("node_id").alias("seed"), F.col("seed_pos").alias("held_by"))
    # at most one chain of seeds is looked at: a seed held by an earlier seed that is emitted is dropped
    chain = seeds.join(where, "seed", "left")
    return chain.filter("held_by IS NULL OR held_by >= seed_pos").select("seed", "seed_pos")


def community_profiles(membership: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of (node_id, community): size, edges within and across, densities over directed pairs."""
    member = membership.select("node_id", "community")
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    placed = edges.join(member.select(F.col("node_id").alias("src"), F.col("community").alias("cs")), "src", "left").join(member.select(F.col("node_id").alias("dst"), F.col("community").alias("cd")), "dst", "left")
    inner = placed.filter("cs = cd").groupBy(F.col("cs").alias("community")).agg(F.count(F.lit(1)).alias("internal_edges"))
    across = placed.filter("NOT (cs <=> cd)").select(F.explode(F.array("cs", "cd")).alias("community")).filter("community IS NOT NULL").groupBy("community").agg(F.count(F.lit(1)).alias("external_edges"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    out = sizes.join(inner, "community", "left").join(across, "community", "left").fillna(0, ["internal_edges", "external_edges"]).join(F.broadcast(n))
    k = F.col("size")
    return out.select("community", "size", "internal_edges", "external_edges", F.when(k > 1, F.col("internal_edges") / (k * (k - 1))).otherwise(0.0).alias("internal_density"), F.when(F.col("external_edges") > 0, F.col("external_edges") / (k * (F.col("n") - k))).otherwise(0.0).alias("external_density"))


def interface_nodes(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, node_id) of members with an edge across, by the first such edge."""
    placed = across(membership, edges)
    ends = placed.select(F.explode(F.array(F.struct(F.col("cs").alias("community"), F.col("src").alias("node_id"), "edge_pos"), F.struct(F.col("cd").alias("community"), F.col("dst").alias("node_id"), "edge_pos"))).alias("e")).select("e.*")
    return ends.filter("community IS NOT NULL").groupBy("community", "node_id").agg(F.min("edge_pos").alias("first_edge"))


def across(membership: DataFrame, edges: DataFrame) -> DataFrame:
    member = membership.select("node_id", "community")
    placed = edges.join(member.select(F.col("node_id").alias("src"), F.col("community").alias("cs")), "src", "left").join(member.select(F.col("node_id").alias("dst"), F.col("community").alias("cd")), "dst", "left")
    return placed.filter("NOT (cs <=> cd)")


def community_bottlenecks(membership: DataFrame, edges: DataFrame, factor: float = 1.5) -> DataFrame:
    """Members with more than `factor` times the community's mean of distinct neighbours inside."""
    member = membership.select("node_id", "community")
    near = undirected(edges)
    inside = near.join(member.select(F.col("node_id").alias("a"), F.col("community").alias("ca")), "a").join(member.select(F.col("node_id").alias("b"), F.col("community").alias("cb")), "b").filter("ca = cb").groupBy(F.col("a").alias("node_id")).agg(F.count(F.lit(1)).alias("inner_degree"))
    each = member.join(inside, "node_id", "left").fillna(0, ["inner_degree"])
    mean = each.groupBy("community").agg(F.avg("inner_degree").alias("mean"))
    return each.join(mean, "community").filter(F.col("inner_degree") > factor * F.col("mean")).select("community", "node_id", "inner_degree")


def modularity(profiles: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum over communities of internal edges over all less a tenth of the squared share of nodes, floor 0."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("nn")), edges.agg(F.count(F.lit(1)).alias("mm"))
    terms = profiles.join(F.broadcast(n)).join(F.broadcast(m)).select((F.when(F.col("mm") > 0, F.col("internal_edges") / F.col("mm")).otherwise(0.0) - 0.1 * F.pow(F.col("size") / F.col("nn"), F.lit(2))).alias("t"))
    return terms.agg(F.greatest(F.lit(0.0), F.coalesce(F.sum("t"), F.lit(0.0))).alias("modularity"))


def community_stats(profiles: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("count")]
    for name, col in (("size", "size"), ("density", "internal_density")):
        aggs += [F.coalesce(f(col).cast("double"), F.lit(0.0)).alias(f"{k}_{name}") for k, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return profiles.agg(*aggs)


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, root_pos, found, members, length, severity) of depth-first back-edge cycles; found numbers all of them in the order of discovery."""
    raw = placed(back_edges(nodes, edges, connected_components(nodes, edges), strong_components), "found", "key")
    out = raw.select((F.col("found") - 1).alias("found"), F.col("key")[0].alias("root_pos"), "members").join(nodes.select(F.col("node_id").alias("root"), F.col("node_pos").alias("root_pos")), "root_pos")
    return out.select("root", "root_pos", "found", "members", F.size("members").cast("long").alias("length")).withColumn("severity", cycle_severity())


def cycle_severity(length: str = "length") -> Column:
    c = F.col(length)
    return F.when(c == 2, "CRITICAL").when(c <= 4, "HIGH").when(c <= 8, "MEDIUM").otherwise("LOW")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node_id, scc) of every endpoint, scc the least member, by forward and backward colouring.

    A round propagates the largest label forward to a fixpoint; what reaches its label's
    own node backward within the colour is that node's component and leaves the graph.
    """
    live = cut(edges.select("src", "dst").distinct(), "scc-edges")
    if live.count() <= TASK_EDGES:
        found = cut(in_one_task(live, strong_in_memory, "node_id string, scc string"), "scc")
        drop(live)
        return found
    todo = cut(live.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "scc-nodes")
    done: DataFrame | None = None
    while not todo.isEmpty():
        colour = todo.withColumn("colour", F.col("node_id"))
        colour = _fixpoint(colour, live, "src", "dst")
        inner = live.join(colour.select(F.col("node_id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node_id").alias("dst"), F.col("colour").alias("d")), "dst").filter("c = d").select("src", "dst", "c")
        inner = cut(inner, "scc-inner")
        reached = colour.filter("node_id = colour").select("node_id", "colour")
        front = reached
        while True:
            step = inner.join(front.select(F.col("node_id").alias("dst"), F.col("colour").alias("c")), ["dst", "c"]).select(F.col("src").alias("node_id"), F.col("c").alias("colour")).distinct()
            old = front, reached
            front = cut(step.join(reached, ["node_id", "colour"], "left_anti"), "scc-front")
            if front.isEmpty():
                drop(front)
                break
            reached = cut(reached.unionByName(front), "scc-reached")
            drop(*old)
        done = reached if done is None else done.unionByName(reached)
        before = todo, live, inner
        todo = cut(todo.join(reached, "node_id", "left_anti"), "scc-nodes")
        live = cut(live.join(todo.select(F.col("node_id").alias("src")), "src", "left_semi").join(todo.select(F.col("node_id").alias("dst")), "dst", "left_semi"), "scc-edges")
        drop(*before)
    if done is None:
        return todo.select("node_id", F.col("node_id").alias("scc"))
    least = done.groupBy("colour").agg(F.min("node_id").alias("scc"))
    return done.join(least, "colour").select("node_id", "scc")


def strong_in_memory(t: pd.DataFrame) -> pd.DataFrame:
    """Strong components of edges (src, dst) by one depth-first search, without recursion; each by its least member."""
    out_of: dict[str, list[str]] = {}
    for a, b in t[["src", "dst"]].itertuples(index=False, name=None):
        out_of.setdefault(a, []).append(b)
        out_of.setdefault(b, [])
    number, low, path, on_path, rows = {}, {}, [], set(), []
    for root in out_of:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        path.append(root), on_path.add(root)
        stack = [(root, iter(out_of[root]))]
        while stack:
            v, rest = stack[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    path.append(w), on_path.add(w)
                    stack.append((w, iter(out_of[w])))
                    break
                if w in on_path:
                    low[v] = min(low[v], number[w])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[v])
                if low[v] == number[v]:
                    at = next(i for i in range(len(path) - 1, -1, -1) if path[i] == v)
                    group = path[at:]
                    del path[at:]
                    on_path.difference_update(group)
                    least = min(group)
                    rows += [(x, least) for x in group]
    return pd.DataFrame(rows, columns=["node_id", "scc"])


def _fixpoint(colour: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    held = None
    while True:
        got = edges.join(colour.select(F.col("node_id").alias(source), "colour"), source).groupBy(F.col(target).alias("node_id")).agg(F.max("colour").alias("seen"))
        new = cut(colour.join(got, "node_id", "left").select("node_id", F.greatest("colour", F.coalesce("seen", "colour")).alias("colour"), (F.col("seen") > F.col("colour")).alias("moved")), "scc-colour")
        drop(held)
        colour, held = new.select("node_id", "colour"), new
        if new.filter("moved").isEmpty():
            return colour


def scc_density(sccs: DataFrame, edges: DataFrame) -> DataFrame:
    sizes = sccs.groupBy("scc").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    inner = edges.join(sccs.select(F.col("node_id").alias("src"), "scc"), "src").join(sccs.select(F.col("node_id").alias("dst"), F.col("scc").alias("scc2")), "dst").filter("scc = scc2").groupBy("scc").agg(F.count(F.lit(1)).alias("m"))
    return sizes.join(inner, "scc", "left").select("scc", "size", (F.coalesce("m", F.lit(0)) / (F.col("size") * (F.col("size") - 1))).alias("density"))


def anomalies(degrees: DataFrame, found: DataFrame | None = None, coupling: int = 10) -> DataFrame:
    """(kind, node_id, severity, amount): couplings, orphans and, given cycles, one row per node on one."""
    high = degrees.filter(F.col("total_degree") > coupling).select(F.lit("highCoupling").alias("kind"), "node_id", F.lit("MEDIUM").alias("severity"), F.col("total_degree").alias("amount"))
    orphan = degrees.filter("total_degree = 0").select(F.lit("orphan").alias("kind"), "node_id", F.lit("LOW").alias("severity"), F.lit(0).cast("long").alias("amount"))
    out = high.unionByName(orphan)
    if found is not None:
        on = found.select(F.explode("members").alias("node_id"), "length").groupBy("node_id").agg(F.min("length").alias("amount"))
        worst = found.agg(F.max((F.col("length") == 2).cast("int")).alias("two"))
        out = out.unionByName(on.join(F.broadcast(worst)).select(F.lit("circular").alias("kind"), "node_id", F.when(F.col("two") == 1, "CRITICAL").otherwise("HIGH").alias("severity"), "amount"))
    return out


def remapped(found: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "highCoupling", "god_node_violation").when(F.col("kind") == "orphan", "bottleneck").when(F.col("kind") == "crossLayer", "fragile_pattern").otherwise(F.col("kind"))
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "ERROR").when(F.col("severity") == "MEDIUM", "WARNING").otherwise("INFO")
    return found.withColumn("kind", kind).withColumn("severity", level)


REASONS = ("cross-community", "legacy", "circular", "unexpected", "hidden")
LEGACY = r"(?i)legacy|deprecated|old|v\d+"


def surprises(edges: DataFrame, membership: DataFrame, cycle_edges: DataFrame | None = None) -> DataFrame:
    """(src, dst, reason, confidence, edge_pos): the first rule that holds for each distinct (src, dst), by its first row."""
    if "type" not in edges.columns:
        edges = edges.withColumn("type", F.lit("imports"))
    first = edges.groupBy("src", "dst").agg(F.min(F.struct("edge_pos", "type")).alias("e")).select("src", "dst", "e.edge_pos", "e.type")
    member = membership.select("node_id", "community")
    placed = first.join(member.select(F.col("node_id").alias("src"), F.col("community").alias("cs")), "src", "left").join(member.select(F.col("node_id").alias("dst"), F.col("community").alias("cd")), "dst", "left")
    if cycle_edges is None:
        placed = placed.withColumn("cyc", F.lit(False))
    else:
        placed = placed.join(cycle_edges.select("src", "dst").distinct().withColumn("c", F.lit(True)), ["src", "dst"], "left").withColumn("cyc", F.coalesce("c", F.lit(False))).drop("c")
    rules = (
        (F.expr("cs IS NOT NULL AND cd IS NOT NULL AND cs <> cd"), "cross-community", 0.75),
        (F.col("dst").rlike(LEGACY) & ~F.col("src").rlike(LEGACY), "legacy", 0.85),
        (F.col("cyc"), "circular", 1.0),
        (F.col("src").contains("/") & ~F.col("dst").contains("/") & (F.col("type") == "calls"), "unexpected", 0.6),
    )
    reason, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for when, name, value in reversed(rules):
        reason, sure = F.when(when, name).otherwise(reason), F.when(when, value).otherwise(sure)
    return placed.select("src", "dst", reason.alias("reason"), sure.alias("confidence"), "edge_pos").filter("reason IS NOT NULL")


def reason_priority(reason: str = "reason") -> Column:
    out = F.lit(0)
    for name, value in (("circular", 10), ("cross-community", 8), ("legacy", 6), ("unexpected", 4), ("hidden", 2)):
        out = F.when(F.col(reason) == name, value).otherwise(out)
    return out


def high_impact(found: DataFrame, least: float = 0.7) -> DataFrame:
    return found.filter(F.col("confidence") >= least).withColumn("priority", reason_priority())


def surprise_stats(found: DataFrame) -> DataFrame:
    ends = found.select(F.explode(F.array("src", "dst")).alias("v")).agg(F.count_distinct("v").alias("affected_nodes"))
    by = [F.count_if(F.col("reason") == r).alias(r.replace("-", "_")) for r in REASONS]
    stats = found.agg(F.count(F.lit(1)).alias("total"), *by, F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.greatest(F.coalesce(F.max("confidence"), F.lit(0.0)), F.lit(0.0)).alias("max_confidence"), F.least(F.coalesce(F.min("confidence"), F.lit(1.0)), F.lit(1.0)).alias("min_confidence"))
    return stats.join(F.broadcast(ends))


def categorised(found: DataFrame) -> DataFrame:
    """(reason, n, members): every reason has a row; members in edge order."""
    names = found.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    # one entry per edge: grouped for reports over an already filtered set
    lists = found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_pos", F.concat_ws(">", "src", "dst").alias("e")))), lambda x: x.e), ",").alias("members"))
    return F.broadcast(names).join(lists, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("members", F.lit("")).alias("members"))


def closure(edges: DataFrame, seeds: DataFrame, upstream: bool = True, depth: int | None = None) -> DataFrame:
    """(seed, node_id, level) of what reaches (upstream) or is reached from each seed; the seed itself has level 0.

    seeds: (seed, node_id). One join a level, against the nodes not met before.
    """
    a, b = ("dst", "src") if upstream else ("src", "dst")
    steps = edges.select(F.col(a).alias("node_id"), F.col(b).alias("next")).distinct()
    met = cut(seeds.select("seed", "node_id").distinct().withColumn("level", F.lit(0)), "met")
    front, level = met, 0
    while depth is None or level < depth:
        level += 1
        new = front.join(steps, "node_id").select("seed", F.col("next").alias("node_id")).distinct().join(met, ["seed", "node_id"], "left_anti")
        front = cut(new.withColumn("level", F.lit(level)), "front")
        if front.isEmpty():
            break
        met = met.unionByName(front)
    return met


def dependent_fanout(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, dependents): nodes with a path to any of a seed's nodes, its nodes not counted."""
    met = closure(edges, seeds)
    return met.groupBy("seed").agg(F.count_if(F.col("level") > 0).alias("dependents"))


def broad_overview(nodes: DataFrame, edges: DataFrame, membership: DataFrame, entry_names: Iterable[str], hubs: int = 5) -> DataFrame:
    """(node_id, priority): entry points by base name, each community's first node, the most depended-on nodes."""
    base = F.regexp_replace(F.substring_index("node_id", "/", -1), r"\.[^.]*$", "")
    entries = nodes.filter(base.isin(*entry_names)).select("node_id", F.lit(0).alias("priority"), "node_pos")
    firsts = membership.join(nodes.select("node_id", "node_pos"), "node_id").groupBy("community").agg(F.min(F.struct("node_pos", "node_id")).alias("f")).select("f.node_id", F.lit(1).alias("priority"), "f.node_pos")
    counts = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count_distinct("src").alias("n")).join(nodes.select("node_id", "node_pos"), "node_id")
    most = counts.orderBy(F.desc("n"), "node_pos").limit(hubs).select("node_id", F.lit(2).alias("priority"), "node_pos")
    return entries.unionByName(firsts).unionByName(most).groupBy("node_id").agg(F.min("priority").alias("priority"))


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (fingerprint): a hash of the graph's content that does not depend on row order, summed without collecting it."""
    n = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("node_id").cast("decimal(20,0)")), F.lit(0)).alias("hn"))
    e = edges.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")), F.lit(0)).alias("he"))
    return n.join(F.broadcast(e)).select(F.sha2(F.concat_ws("|", "n", "hn", "m", "he"), 256).alias("fingerprint"))


def quality_score(cycle_count: Column, god_count: Column, community_count: Column) -> Column:
    raw = 100 - F.least(2 * cycle_count, F.lit(40)) - F.least(god_count, F.lit(20)) + F.least(F.greatest(F.lit(0), community_count - 1), F.lit(10))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def node_roles(degrees: DataFrame, ranks: DataFrame, membership: DataFrame) -> DataFrame:
    """Per node: degrees, rank, first community or 'unknown', criticality and a bucket by edges out."""
    bucket = F.when(F.col("out_degree") > 5, "high").when(F.col("out_degree") > 2, "medium").otherwise("low")
    home = membership.groupBy("node_id").agg(F.min("community").alias("community"))
    out = degrees.join(ranks.select("node_id", "score"), "node_id", "left").join(home, "node_id", "left")
    return out.select("node_id", "in_degree", "out_degree", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("community", F.lit("unknown")).alias("community"), criticality().alias("criticality"), bucket.alias("centrality"))
