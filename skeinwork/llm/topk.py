"""Exact top-k inner products by norm buckets.

Candidates are dealt by length into buckets, longest first. A query carries a
proven lower bound of its k-th score, taken from the longest vectors, and so the least
length that a candidate of use must have. Queries are dealt into blocks by that length;
only the lengths of buckets and blocks meet first, and vectors travel for pairs
that can hold a result. In a bucket the bound becomes a local cosine threshold: above 1
the query is skipped; where it is low, only vectors long enough are tried; where it is
high, only those whose value at the query's largest coordinate lies in the feasible
range. What remains is verified by exact integer products.

Defined cases: vectors that are null or hold null or non-finite components, and
rows with null ids, take no part; rows that repeat an id are queries and candidates of
their own, a row never being its own candidate; equal scores go by id; vectors of
different dimension never meet; an empty table gives no rows; other columns are not
read. Scores beyond a long are clipped to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BUCKET_ROWS = 4096
QUERY_ROWS = 1024
SEED_ROWS = 4096
#: At local cosine thresholds above it, coordinate pruning is chosen.
COORDINATE_FROM = 0.5
BLOCK = "block long, dim long, n long, longest double, rows binary, ids binary, cells binary, kind string, low binary, need double"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, v array<double> of whole numbers, dim, len); row tells rows apart once the result is stored."""
    fine = f"{vector_col} IS NOT NULL AND {id_col} IS NOT NULL AND forall({vector_col}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    base = vectors.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.expr(f"transform({vector_col}, x -> cast(floor({scale} * cast(x AS double)) AS double))").alias("v"))
    return base.select("*", F.size("v").cast("long").alias("dim"), F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))").alias("len"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("v")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (row, vec_id, v, dim, low) in blocks of one dimension, in the order they come; need is the least length that
    a candidate of any of the block's rows must have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for at in range(a, b, size):
                    part = batch.slice(at, min(size, b - at))
                    m, low = matrix(part), part.column("low").to_numpy()
                    top = np.abs(m).max(initial=0)
                    kind = next((k for k, most in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if top <= most), "<f8")
                    lengths = np.sqrt((m * m).sum(1))
                    ids, own = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                    yield pa.RecordBatch.from_pylist([{"block": made, "dim": m.shape[1], "n": len(ids), "longest": float(lengths.max(initial=0)), "rows": own.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(), "cells": m.astype(kind).tobytes(), "kind": kind, "low": low.astype("<f8").tobytes(), "need": float(needed(low, lengths).min(initial=np.inf))}])
                    made += 1

    return rows.select("row", "vec_id", "v", "dim", "low").mapInArrow(run, BLOCK)


def needed(low: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The least length of a candidate whose product with a vector of that length can reach low."""
    return np.where(low > 0, low / np.maximum(lengths, 1e-300) * (1 - 1e-9), 0.0)


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[prefix + "ids"], "<i8")
    return np.frombuffer(row[prefix + "rows"], "<i8"), ids, np.frombuffer(row[prefix + "cells"], row[prefix + "kind"]).reshape(len(ids), row[prefix + "dim"]).astype(np.float64)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers as int64, clipped to it."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if bound < 2**53:
        return np.rint(q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def best(query: np.ndarray, cand: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best, ties to the smaller candidate."""
    order = np.lexsort((cand, -score.astype(np.float64) if np.abs(score).max(initial=0) < 2**53 else ~score, query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[rank < k]


def probe(q: np.ndarray, q_rows: np.ndarray, low: np.ndarray, c: np.ndarray, c_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, score) of what can reach the queries' bounds in one bucket."""
    q_len, c_len = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    order = np.argsort(-c_len, kind="stable")
    c, c_len = c[order], c_len[order]
    reach = q_len * c_len[0]
    local = np.where(low > 0, low / np.where(reach > 0, reach, 1e-300), -1.0)
    by_length = np.flatnonzero(local <= COORDINATE_FROM)
    by_coordinate = np.flatnonzero((local > COORDINATE_FROM) & (local <= 1 + 1e-9))
    out = [[], [], []]
    if by_length.size:
        enough = np.searchsorted(-c_len, -needed(low[by_length], q_len[by_length]), side="right")
        s = products(q[by_length], c[: enough.max()])
        a, b = np.nonzero((s >= low[by_length][:, None]) & (np.arange(s.shape[1]) < enough[:, None]))
        for got, x in zip(out, (by_length[a], b, s[a, b]), strict=True):
            got.append(x)
    if by_coordinate.size:
        unit = c / np.maximum(c_len, 1e-300)[:, None]
        sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i in by_coordinate:
            hat, t = q[i] / q_len[i], min(1.0, local[i])
            f = int(np.argmax(np.abs(hat)))
            if f not in sorted_by:
                places = np.argsort(unit[:, f])
                sorted_by[f] = places, unit[places, f]
            places, values = sorted_by[f]
            # a unit vector within the angle acos(t) of the query has its coordinate f between these cosines
            at, wide = np.arccos(np.clip(hat[f], -1, 1)), np.arccos(t)
            least, most = np.cos(min(np.pi, at + wide)) - 1e-9, np.cos(max(0.0, at - wide)) + 1e-9
            got = places[np.searchsorted(values, least) : np.searchsorted(values, most, side="right")]
            if got.size:
                s = products(q[i : i + 1], c[got])[0]
                keep = s >= low[i]
                for into, x in zip(out, (np.full(keep.sum(), i), got[keep], s[keep]), strict=True):
                    into.append(x)
    a, b, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    b = order[b] if len(b) else b.astype(np.int64)
    other = q_rows[a] != c_rows[b] if len(a) else np.zeros(0, bool)
    return a[other], b[other], s[other]


def search(vectors: DataFrame, is_query: str, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows that meet `is_query`, over vec_id, the k best of all other rows."""
    spark = vectors.sparkSession
    folders: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = common.store(df, name)
        folders.append(path)
        return out

    base = keep(quantised(vectors, id_col, vector_col, scale), "vectors")
    # at most SEED_ROWS long vectors, so the bound is proved whatever the table's size
    seeds = base.orderBy(F.desc("len"), "row").limit(SEED_ROWS).select("row", "v", "dim").collect()
    seed_rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in seeds}:
        own = [r for r in seeds if r.dim == dim]
        seed_rows[dim] = np.array([r.row for r in own]), np.array([r.v for r in own], np.float64).reshape(len(own), dim)
    shared = spark.sparkContext.broadcast(seed_rows)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, own = batch.column("dim").to_numpy(), batch.column("row").to_numpy()
            low = np.full(len(dims), -np.inf)
            for dim in np.unique(dims):
                if dim not in shared.value:
                    continue
                c_rows, c = shared.value[dim]
                for places in np.array_split(of := np.flatnonzero(dims == dim), max(1, -(-len(of) // QUERY_ROWS))):
                    s = products(matrix(batch.take(pa.array(places))), c).astype(np.float64)
                    s[own[places][:, None] == c_rows[None, :]] = -np.inf
                    if s.shape[1] > k:
                        low[places] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            need = needed(low, batch.column("len").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(need)], [*batch.schema.names, "low", "need"])

    queries = base.filter(is_query).mapInArrow(bound, "row long, vec_id long, v array<double>, dim long, len double, low double, need double")
    query_blocks = keep(blocks(queries.repartitionByRange("dim", "need", "row").sortWithinPartitions("dim", "need"), QUERY_ROWS), "query-blocks")
    ordered = base.withColumn("low", F.lit(0.0)).repartitionByRange("dim", F.desc("len"), "row").sortWithinPartitions("dim", F.desc("len"))
    buckets = keep(blocks(ordered, BUCKET_ROWS), "buckets")
    # lengths alone decide which bucket meets which block of queries
    meet = buckets.select("block", "dim", "longest").join(query_blocks.select(F.col("block").alias("q_block"), "dim", "need"), "dim").filter("longest >= need").select("block", "q_block")
    names = ("dim", "rows", "ids", "cells", "kind", "low")
    pairs = keep(meet, "meetings").repartition("block", "q_block").join(buckets.select("block", *names[:-1]), "block")
    pairs = pairs.join(query_blocks.select(F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in names]), "q_block")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                (q_rows, q_ids, q), (c_rows, c_ids, c) = unpacked(row, "q_"), unpacked(row)
                a, b, s = probe(q, q_rows, np.frombuffer(row["q_low"], "<f8"), c, c_rows)
                best_ones = best(a, c_ids[b], s, k)
                a, b = a[best_ones], b[best_ones]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_rows[a], q_ids[a], c_ids[b], s[best_ones])], ["query", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(verify, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = common.cut(out, "nearest")
    for path in folders:
        common.delete_folder(spark, path)
    return out


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


OP7_SQL = """
WITH v AS (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.nr, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.nr <> b.nr),
r AS (SELECT query_id, row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
