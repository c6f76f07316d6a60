"""Centroid clustering against plain loops over Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from skeinwork.llm import centroids


def plain_version(rows, k, rounds, dims, scale=64, seed=1):
    """rows of (id, list): [(id, cluster, distance)], final centroids."""
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(fine, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min((far(v, c), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, v in fine:
            own[best(v)[1]].append(v)
        cents = [[sum(col) // len(vs) for col in zip(*vs, strict=True)] if vs else c for vs, c in zip(own, cents, strict=True)]
    return [(i, best(v)[1], min(best(v)[0], 2**63 - 1)) for i, v in fine], cents


def made(seed, n, dims, scale=1.0, few=False):
    rng = random.Random(seed)
    one = (lambda: rng.choice([-1.0, 0.0, 0.5])) if few else (lambda: rng.gauss(0, scale))
    rows = [(rng.randrange(n), [one() for _ in range(dims)]) for _ in range(n)]
    rows += [rows[0], (None, rows[1][1]), (5, None), (6, [1.0] * (dims - 1)), (7, [math.nan] * dims), (8, [math.inf] * dims), (9, [None] * dims), (10, [])]
    return rows


@pytest.mark.parametrize(("seed", "n", "dims", "scale", "few"), [(1, 300, 64, 1.0, False), (2, 200, 20, 1.0, True), (3, 60, 64, 1e9, False), (4, 60, 9, 1e300, False), (5, 9, 64, 1.0, False)])
def test_equals_plain(spark, seed, n, dims, scale, few):
    rows = made(seed, n, dims, scale, few)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    got, cents = centroids.cluster(df, k=16, rounds=3, dims=dims)
    want, want_cents = plain_version(rows, 16, 3, dims)
    assert cents.tolist() == want_cents
    key = lambda r: (r[0] is None, *r[1:], r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    full = centroids.with_inertia(got, cents).collect()
    total = min(sum(r[2] for r in want), 2**63 - 1)
    assert {r.inertia for r in full} == {total}
    for r in full:
        assert r.cluster_inertia == min(sum(w[2] for w in want if w[1] == r.cluster), 2**63 - 1)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_cents[r.cluster])).encode()).hexdigest()


def test_centroids_are_abandoned_and_nothing_changes():
    rng = np.random.default_rng(3)
    v = rng.integers(-60, 60, (2000, 64))
    c = np.concatenate([v[:15], v[:1]])
    for order in (np.arange(64), np.argsort(-v.var(0))):
        number, distance, abandoned = centroids.nearest(v, c, order)
        every = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert number[0] == 0 and abandoned > 1000


def test_limbs():
    for x in (0, 1, -1, 2**30, -(2**30) - 7, 3**300, -(5**90)):
        assert sum(part << centroids.LIMB * at for at, part in centroids.limbs(x)) == x


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.with_inertia(*centroids.cluster(empty)).count() == 0
