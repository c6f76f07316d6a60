"""Cycles that a depth-first search closes, one for each edge to a node on its path, without searching the graph as one.

A cycle lies inside a strong component, and a search never comes back to a component that
it left. So the search of the whole graph, looked at inside one strong component, is the
search of that component alone, begun where the whole one enters it. Entries are found on
the graph of components in rounds: a component is entered by the first event (a root, or an
edge that is looked at) that reaches it, and events are ordered by keys: the position of
the root, then the number of the event inside each component on the way. A component is
settled in the round after all components with edges into it; only those from which a
cycle can be reached take part. A node that is a component of its own needs no search: its
events are its edges in their order.

Connected components up to BLOCK_EDGES edges are searched whole, each by one group; a group
is never more than that or one strong component. Rounds needed: the depth of the graph of
components above cycles, as keys are long in components passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop

BLOCK_EDGES = 20_000
FOUND = "key array<long>, members array<string>, dst string"


def searched(roots: list[tuple[int | None, str]], edges: list[tuple[str, str]], inside: set | None = None) -> Iterator[tuple[int | None, int, list[str] | None, str | None]]:
    """(root's position, number of the event, cycle, None) for each edge back to the path, and (.., None, target) for each edge
    that leaves `inside`; events are edges in the order in which the search looks at them."""
    out_of: dict[str, list[str]] = {}
    for a, b in edges:
        out_of.setdefault(a, []).append(b)
    seen: set[str] = set()
    number = 0
    for pos, root in roots:
        if root in seen:
            continue
        seen.add(root)
        path, depth, stack = [root], {root: 0}, [iter(out_of.get(root, ()))]
        while stack:
            for v in stack[-1]:
                number += 1
                if inside is not None and v not in inside:
                    yield pos, number, None, v
                elif v not in seen:
                    seen.add(v)
                    depth[v] = len(path)
                    path.append(v)
                    stack.append(iter(out_of.get(v, ())))
                    break
                elif v in depth:
                    yield pos, number, path[depth[v] :], None
            else:
                stack.pop()
                del depth[path.pop()]


def in_order(edges: pd.DataFrame) -> list[tuple[str, str]]:
    return list(edges.sort_values("edge_pos")[["src", "dst"]].itertuples(index=False, name=None))


def whole_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cycles (key, members, dst) of components: nodes (node_id, node_pos, part), edges (src, dst, edge_pos, part)."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        roots = list(left.sort_values("node_pos")[["node_pos", "node_id"]].itertuples(index=False, name=None))
        rows = [([pos, n], cycle, None) for pos, n, cycle, _ in searched(roots, in_order(right))]
        return pd.DataFrame(rows, columns=["key", "members", "dst"])

    return nodes.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(run, FOUND)


def by_strong_component(nodes: DataFrame, edges: DataFrame, strong: DataFrame) -> DataFrame:
    """Cycles (key, members) with strong (node_id, scc) of every endpoint of the edges."""
    at = lambda c, s: strong.select(F.col("node_id").alias(c), F.col("scc").alias(s))
    arcs = cut(edges.select("src", "dst", "edge_pos").join(at("src", "s"), "src").join(at("dst", "d"), "dst"), "arcs")
    closed = arcs.filter("s = d").select("s").distinct()
    # components from which a cycle can be reached: backward from those with an edge inside
    cross = cut(arcs.filter("s <> d").select("s", "d").distinct(), "cross")
    reach = front = cut(closed, "reach")
    while True:
        step = cut(cross.join(front.select(F.col("s").alias("d")), "d").select("s").distinct().join(reach, "s", "left_anti"), "front")
        if step.isEmpty():
            drop(step)
            break
        wider = cut(reach.unionByName(step), "reach")
        if front is not reach:
            drop(front)
        drop(reach)
        reach, front = wider, step
    live = arcs.join(reach, "s", "left_semi").join(reach.select(F.col("s").alias("d")), "d", "left_semi")
    live = cut(live.join(closed.select("s", F.lit(True).alias("closed")), "s", "left").fillna(False, ["closed"]), "live-arcs")
    drop(arcs, cross)
    own = strong.select("node_id", F.col("scc").alias("s")).join(nodes.select("node_id", "node_pos"), "node_id").join(reach, "s", "left_semi")
    own = own.groupBy("s").agg(F.min(F.struct(F.array(F.col("node_pos")).alias("key"), F.col("node_id").alias("dst"))).alias("own"))
    into = live.filter("s <> d").groupBy(F.col("d").alias("s")).agg(F.count(F.lit(1)).alias("waits"))
    pending = cut(reach.join(own, "s", "left").join(into, "s", "left").fillna(0, ["waits"]), "pending")
    arrived: DataFrame | None = None
    found: list[DataFrame] = []

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        if first.entry is None:
            return pd.DataFrame([(None, None, v) for v in rows.dst[rows.d != key[0]]], columns=["key", "members", "dst"])
        inside = set(rows.src) | set(rows.dst[rows.d == key[0]])
        made = searched([(None, first.entry)], in_order(rows), inside)
        return pd.DataFrame([([*first.key, n], cycle, v) for _, n, cycle, v in made], columns=["key", "members", "dst"])

    while not pending.isEmpty():
        known = pending if arrived is None else pending.join(arrived, "s", "left")
        known = known.select("s", "own", "waits", *([F.lit(0).alias("n"), F.col("own").alias("best")] if arrived is None else ["n", "best"]))
        ready = cut(known.filter(F.coalesce("n", F.lit(0)) == F.col("waits")).select("s", F.least("own", "best").alias("at")).select("s", F.col("at.key").alias("key"), F.col("at.dst").alias("entry")), "ready")
        outs = live.join(ready, "s")
        single = outs.filter("NOT closed").select(F.when(F.col("key").isNotNull(), F.concat("key", F.array("edge_pos"))).alias("key"), F.lit(None).cast("array<string>").alias("members"), "dst")
        events = cut(single.unionByName(outs.filter("closed").groupBy("s").applyInPandas(run, FOUND)), "events")
        found.append(events)
        come = events.filter("members IS NULL").join(strong.select(F.col("node_id").alias("dst"), "scc"), "dst").groupBy(F.col("scc").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "dst"))).alias("best"))
        if arrived is not None:
            come = arrived.unionByName(come).groupBy("s").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
        before = pending, arrived, ready
        rest = cut(pending.join(ready, "s", "left_anti"), "pending")
        arrived = cut(come.join(rest, "s", "left_semi"), "arrived")
        drop(*before)
        pending = rest
    drop(pending, arrived, live, reach)
    empty = edges.sparkSession.createDataFrame([], "key array<long>, members array<string>")
    for events in found:
        empty = empty.unionByName(events.filter("members IS NOT NULL").select("key", "members"))
    out = cut(empty, "cycles")
    drop(*found)
    return out


def back_edges(nodes: DataFrame, edges: DataFrame, parts: DataFrame, strong, block_edges: int | None = None) -> DataFrame:
    """(key, members) of every cycle: parts (node_id, component) of all nodes and endpoints, strong a function of edges."""
    most = BLOCK_EDGES if block_edges is None else block_edges
    placed = cut(edges.select("src", "dst", "edge_pos").join(parts.select(F.col("node_id").alias("src"), F.col("component").alias("part")), "src"), "placed-edges")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.filter(F.col("n") > most).select("part"), "large-parts")
    own = nodes.select("node_id", "node_pos").join(parts.select("node_id", F.col("component").alias("part")), "node_id")
    none = large.isEmpty()
    small_nodes, small_edges = (own, placed) if none else (own.join(large, "part", "left_anti"), placed.join(large, "part", "left_anti"))
    out = whole_components(small_nodes, small_edges).select("key", "members")
    if not none:
        rest = cut(placed.join(large, "part", "left_semi").select("src", "dst", "edge_pos"), "large-edges")
        labels = cut(strong(rest), "strong")
        out = out.unionByName(by_strong_component(own.join(large, "part", "left_semi"), rest, labels))
        drop(rest, labels)
    out = cut(out, "back-edges")
    drop(placed, large)
    return out
