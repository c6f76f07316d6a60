"""Local label moves in the exact order of nodes, spread over blocks of bounded size.

By definition node after node, in their order, goes to the best community among its
neighbours, in passes. What a node sees depends on its neighbours alone: on those before
it after this pass, on those after it after the last one. So a node may make its next
move as soon as its earlier neighbours are one pass ahead of it and its later ones are
level with it, and no neighbour can move before it has. Rounds use that: nodes are cut
into blocks of consecutive positions; a round sends every block the state of its
neighbours outside, and the block moves on, in passes of its own, until all of its nodes wait for others.
Nodes with more neighbours than a block may hold are settled one move a round by sums over
their neighbours, which Spark adds up before it shuffles them.

A round is one join of states with the edges that leave blocks. Rounds needed: the longest chain of blocks (not of nodes)
that wait for each other, and about two for each further pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, drop

#: Edges of a block, counted at both ends; a node with more is a hub.
BLOCK_EDGES = 20_000
STATE = "node string, home string, done long, moved long"


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, a_pos, b, b_pos, first): distinct neighbours of nodes by their first edge; b_pos is null where b is no node."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_pos"), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), "edge_pos"))).alias("e")).select("e.*")
    near = both.groupBy("a", "b").agg(F.min("edge_pos").alias("first"))
    at = nodes.select("node_id", F.col("node_pos").alias("pos"))
    return near.join(at.select(F.col("node_id").alias("a"), F.col("pos").alias("a_pos")), "a").join(at.select(F.col("node_id").alias("b"), F.col("pos").alias("b_pos")), "b", "left")


def blocks(near: DataFrame, most: int) -> DataFrame:
    """(node, pos, degree, block): runs of nodes in their order with at most that many edges; hubs have block -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for t in batches:
            out = []
            for degree in t.degree:
                if degree > most:
                    out.append(-1)
                    continue
                if held + degree > most:
                    block, held = block + 1, 0
                held += degree
                out.append(block)
            yield t.assign(block=out)

    degrees = near.groupBy(F.col("a").alias("node"), F.col("a_pos").alias("pos")).agg(F.count(F.lit(1)).alias("degree"))
    return degrees.repartitionByRange("pos").sortWithinPartitions("pos").mapInPandas(run, "node string, pos long, degree long, block long")


def best_home(own: str, around: list[tuple[str, bool]]) -> str | None:
    """Of (home, whether the neighbour is a node) in the order of first edges: the home of most neighbours, less half of
    those elsewhere, if that is positive. A node's own community earns nothing."""
    tally: dict[str, int] = {}
    for home, known in around:
        if known and home != own:
            tally[home] = tally.get(home, 0) + 1
    best, gain = None, 1e-10
    for home, inside in tally.items():
        value = inside - 0.5 * (len(around) - inside)
        if value > gain:
            best, gain = home, value
    return best


def advance(near: pd.DataFrame, state: pd.DataFrame, passes: int) -> pd.DataFrame:
    """The states of a block's nodes after all moves that can be made: near (a, a_pos, b, b_pos), state of these and of neighbours outside."""
    home, done, moved = (dict(zip(state.node, state[c], strict=True)) for c in ("home", "done", "moved"))
    around: dict[str, list[tuple[str, int]]] = {}
    for a, side, b in zip(near.a, near.side, near.b, strict=True):
        around.setdefault(a, []).append((b, side))
    going = True
    while going:
        going = False
        for v, others in around.items():
            at = done[v]
            # a neighbour before v must be one pass ahead, one after it level; what is no node waits for nothing
            if at == passes or any(side and done[u] != at + (side < 0) for u, side in others):
                continue
            to = best_home(home[v], [(home[u], True) if u == v or side else (u, False) for u, side in others])
            if to is not None:
                home[v], moved[v] = to, at + 1
            done[v], going = at + 1, True
    own = list(around)
    return pd.DataFrame({"node": own, "home": [home[v] for v in own], "done": [done[v] for v in own], "moved": [moved[v] for v in own]})


def hub_moves(near: DataFrame, state: DataFrame, passes: int) -> DataFrame:
    """The states of hubs after the one move that those make which can."""
    other = state.select(F.col("node").alias("b"), F.col("home").alias("to"), F.col("done").alias("b_done"))
    own = state.select(F.col("node").alias("a"), "home", "done", "moved")
    seen = near.select("a", "b", "side", "first").join(other, "b", "left").join(own, "a")
    waits = (F.col("side") != 0) & (F.col("b_done") != F.col("done") + (F.col("side") < 0).cast("int"))
    sums = seen.groupBy("a", "home", "done", "moved", "to").agg(F.count(F.lit(1)).alias("inside"), F.min("first").alias("first"), F.max(waits.cast("int")).alias("waits"))
    known = F.col("to").isNotNull() & (F.col("to") != F.col("home"))
    best = F.max(F.when(known, F.struct("inside", (-F.col("first")).alias("first"), "to"))).alias("best")
    each = sums.groupBy("a", "home", "done", "moved").agg(best, F.sum("inside").alias("k"), F.coalesce(F.max("waits"), F.lit(0)).alias("waits"))
    ready = (F.col("waits") == 0) & (F.col("done") < passes)
    goes = ready & F.coalesce(F.col("best.inside") - 0.5 * (F.col("k") - F.col("best.inside")) > 1e-10, F.lit(False))
    return each.select(F.col("a").alias("node"), F.when(goes, F.col("best.to")).otherwise(F.col("home")).alias("home"), (F.col("done") + ready.cast("long")).alias("done"), F.when(goes, F.col("done") + 1).otherwise(F.col("moved")).alias("moved"))


def label_moves(nodes: DataFrame, edges: DataFrame, passes: int = 10, block_edges: int | None = None) -> DataFrame:
    """(node_id, node_pos, seed, moved): the community that each node ends in, and the pass of its last move, 0 for none."""
    most = BLOCK_EDGES if block_edges is None else block_edges
    raw = cut(neighbours(nodes, edges), "neighbours")
    where = cut(blocks(raw, most), "blocks")
    side = F.when(F.col("b_pos").isNull() | (F.col("a") == F.col("b")), 0).when(F.col("b_pos") < F.col("a_pos"), -1).otherwise(1)
    placed = raw.join(where.select(F.col("node").alias("a"), "block"), "a").join(where.select(F.col("node").alias("b"), F.col("block").alias("b_block")), "b", "left")
    near = cut(placed.select("block", "a", "a_pos", "b", "b_block", side.alias("side"), "first"), "block-edges")
    inner, hubs = near.filter("block >= 0"), near.filter("block < 0")
    has_hubs = not hubs.isEmpty()
    # what a block is told: the states of its own nodes and of neighbours in other blocks
    told = where.filter("block >= 0").select("block", "node").unionByName(inner.filter("side <> 0 AND NOT (block <=> b_block)").select("block", F.col("b").alias("node")).distinct())
    told = cut(told, "told")
    state = cut(where.select("node", F.col("node").alias("home"), F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("moved")), "moves")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return advance(left.sort_values(["a_pos", "first"]), right, passes)

    while True:
        news = told.join(state, "node")
        new = inner.select("block", "a", "a_pos", "b", "side", "first").groupBy("block").cogroup(news.groupBy("block")).applyInPandas(run, STATE)
        if has_hubs:
            new = new.unionByName(hub_moves(hubs, state, passes))
        new = cut(new, "moves")
        drop(state)
        state = new
        least, last = state.agg(F.min("done"), F.max("moved")).first()
        # everybody is through, or a whole pass went by without a move
        if least is None or least == passes or least > last:
            break
    drop(raw, where, near, told)
    out = nodes.select("node_id", "node_pos").join(state.select(F.col("node").alias("node_id"), "home", "moved"), "node_id", "left")
    return out.select("node_id", "node_pos", F.coalesce("home", "node_id").alias("seed"), F.coalesce("moved", F.lit(0)).alias("moved"))
