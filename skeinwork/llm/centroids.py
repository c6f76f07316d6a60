"""Centroid clustering in whole numbers with partial-distance search.

Vectors become whole numbers. Each round a task holds the few centroids and a batch of
vectors, its dimensions ordered by their variance over all vectors, largest first. All
centroids are compared over the first few dimensions; the one nearest there is finished
first and gives the bound. Every other centroid adds further dimensions, a few at a time,
and is abandoned for a vector once its sum is strictly above the bound; survivors finish
all dimensions, so ties still go to the smaller number. The order of dimensions decides
the time alone, never the result.

Tasks add up their vectors by cluster and dimension before the shuffle. Sums travel in
limbs of 30 bits, so they are exact whatever the components; the new centroid is the exact
floor of sum by count. What reaches the driver is a row a cluster and dimension (and limb).

Defined cases: vectors that are null, of another number of components, or with null or
non-finite ones take no part; rows with null ids do, hashed as no digits; rows that repeat
an id are vectors of their own, of starting centroids with equal hashes the one with the
smaller components comes first; with fewer vectors than centroids there is a centroid a
vector; an empty table gives no rows; distances and inertia beyond a long are clipped to
it; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Dimensions that are added at a time.
STEP = 8
LIMB = 30
LONGEST = 2**63 - 1


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double> of whole numbers)."""
    fine = f"size({vector_col}) = {dims} AND forall({vector_col}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    # a component beyond 2**53 is whole already, and multiplied by a power of two stays exact; floor() makes longs of doubles
    whole = F.expr(f"transform({vector_col}, x -> CASE WHEN abs(cast(x AS double)) < 4503599627370496D / {scale} THEN cast(floor({scale} * cast(x AS double)) AS double) ELSE {scale} * cast(x AS double) END)")
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors as rows of int64, or of Python's numbers where squares could leave 64 bits."""
    lists = batch.column("v")
    cells = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return cells.astype(np.int64) if small(np.abs(cells).max(initial=0), cells.shape[1]) else np.array([[int(x) for x in r] for r in cells.tolist()], object)


def small(top: float, dims: int) -> bool:
    """Whether squared distances of vectors up to top fit in 64 bits."""
    return 4.0 * float(top) * float(top) * dims < 2.0**62


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of each vector's nearest centroid, its squared distance, and how many vector-centroid pairs were abandoned."""
    v, c = v[:, order], centroids[:, order]
    if v.dtype == object or c.dtype == object or not small(max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)), v.shape[1]):
        v, c = v.astype(object), c.astype(object)
    head = np.stack([((v[:, :STEP] - c[k, :STEP]) ** 2).sum(1) for k in range(len(c))], axis=1)
    rows = np.arange(len(v))
    number = head.argmin(1)
    bound = head[rows, number] + ((v[:, STEP:] - c[number, STEP:]) ** 2).sum(1)
    first, abandoned = number.copy(), 0
    for k in range(len(c)):
        alive = np.flatnonzero((first != k) & (head[:, k] <= bound))
        abandoned += int((first != k).sum())
        sums = head[alive, k]
        for at in range(STEP, v.shape[1], STEP):
            sums = sums + ((v[alive, at : at + STEP] - c[k, at : at + STEP]) ** 2).sum(1)
            stay = sums <= bound[alive]
            alive, sums = alive[stay], sums[stay]
        abandoned -= len(alive)
        closer = (sums < bound[alive]) | (number[alive] > k)
        number[alive[closer]], bound[alive[closer]] = k, sums[closer]
    return number, bound, abandoned


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, part) with x the sum of part * 2**(LIMB * place), parts of x's sign."""
    sign, x, at = (-1 if x < 0 else 1), abs(x), 0
    while x:
        yield at, sign * (x & (1 << LIMB) - 1)
        x, at = x >> LIMB, at + 1


def added_up(per_task):
    """A mapInArrow function that sums what per_task makes of each batch, {(cluster, dim): number}, into limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            for key, x in per_task(batch):
                sums[key] = sums.get(key, 0) + x
        rows = [(c, d, at, part) for (c, d), x in sums.items() for at, part in limbs(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["cluster", "dim", "place", "part"])

    return run


def collect_sums(df: DataFrame, per_task) -> dict[tuple[int, int], int]:
    sums: dict[tuple[int, int], int] = {}
    parts = df.select("v").mapInArrow(added_up(per_task), "cluster long, dim long, place long, part long")
    # a row a cluster, dimension and limb, however many vectors there are
    for r in parts.groupBy("cluster", "dim", "place").agg(F.sum("part").alias("part")).collect():
        sums[r.cluster, r.dim] = sums.get((r.cluster, r.dim), 0) + (r.part << LIMB * r.place)
    return sums


def variance_order(df: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by variance over all vectors, largest first."""

    def moments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int]]:
        m = matrix(batch)
        if m.dtype == object or float(np.abs(m).max(initial=0)) ** 2 * len(m) >= 2.0**62:
            m = m.astype(object)
        yield (0, 0), len(m)
        for d, (s, q) in enumerate(zip(m.sum(0).tolist(), (m * m).sum(0).tolist(), strict=True)):
            yield (1, d), int(s)
            yield (2, d), int(q)

    got = collect_sums(df, moments)
    n = got.get((0, 0), 0)
    spread = [n * got.get((2, d), 0) - got.get((1, d), 0) ** 2 for d in range(dims)]
    return np.array(sorted(range(dims), key=lambda d: (-spread[d], d)), np.int64)


def whole(rows: list[list[int]]) -> np.ndarray:
    top = max((abs(x) for r in rows for x in r), default=0)
    return np.array(rows, np.int64 if small(top, len(rows[0])) else object)


def starts(df: DataFrame, k: int, seed: int) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[int(x) for x in r.v] for r in df.orderBy(digest, "v").limit(k).select("v").collect()]


def assigned(df: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance)."""
    shared = df.sparkSession.sparkContext.broadcast((centroids, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance, _ = nearest(matrix(batch), *shared.value)
            distance = [min(d, LONGEST) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return df.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(df: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round; those without vectors stay."""
    shared = df.sparkSession.sparkContext.broadcast((centroids, order))
    dims = centroids.shape[1]

    def sums(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int]]:
        m = matrix(batch)
        number = nearest(m, *shared.value)[0]
        for k in np.unique(number).tolist():
            own = m[number == k]
            yield (k, dims), len(own)
            # int64 components times a batch's rows stay within 64 bits: small() leaves more room than that
            yield from (((k, d), int(s)) for d, s in enumerate(own.sum(0).tolist()))

    got = collect_sums(df, sums)
    old = centroids.tolist()
    return whole([[got.get((k, d), 0) // n if (n := got.get((k, dims), 0)) else int(old[k][d]) for d in range(dims)] for k in range(len(old))])


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids, a row each."""
    spark = vectors.sparkSession
    base, path = common.store(whole_vectors(vectors, dims, scale, id_col, vector_col), "whole-vectors")
    first = starts(base, k, seed)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    centroids, order = whole(first), variance_order(base, dims)
    for _ in range(rounds):
        centroids = moved(base, centroids, order)
    out = common.cut(assigned(base, centroids, order), "clusters")
    common.delete_folder(spark, path)
    return out, centroids


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of cluster() with cluster_inertia, inertia and centroid_sha256; what is collected and joined has a row a centroid."""
    parts = {r.cluster: int(r.part) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("part")).collect()}
    total = min(sum(parts.values()), LONGEST)
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
    made = [(i, min(parts.get(i, 0), LONGEST), total, digest(c)) for i, c in enumerate(centroids.tolist())]
    named = rows.sparkSession.createDataFrame(made, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def _sql(rounds: int = 3, k: int = 16) -> str:
    parts = ["""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "x AS MATERIALIZED (SELECT nr, unnest(range(64)) AS dim, unnest(q) AS x FROM w)",
             "o AS (SELECT q, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c FROM w)",
             f"c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS dim, unnest(q) AS x FROM o WHERE c < {k})"]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT x.nr, c.c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{i} c USING (dim) GROUP BY ALL)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT nr, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY nr)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT a.c, x.dim, floor(sum(x.x)::DOUBLE / count(*))::BIGINT AS x FROM a{i} a JOIN x USING (nr) GROUP BY ALL)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, dim, coalesce(m.x, p.x) AS x FROM c{i} p LEFT JOIN m{i} m USING (c, dim))")
    return ",\n".join(parts) + f"""
SELECT w.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, h.s AS centroid_sha256
FROM a{rounds} a JOIN w USING (nr) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS s FROM c{rounds} GROUP BY c) h USING (c)
"""


OP13_SQL = _sql()
