"""Clustering by progressive search against plain integer arithmetic over all components."""

import hashlib
import math

import numpy as np
import pytest

from rankweave.llm import walsh_clusters as wc
from rankweave.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters=16, rounds=3):
    kept = [
        (vec_id, [math.floor(64 * float(np.float32(x))) for x in e])
        for vec_id, e, _ in rows
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)
    ]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:clusters]]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((away(x, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            own = [x for (_, x), a in zip(kept, at) if a == k]
            if own:
                centroids[k] = [sum(col) // len(own) for col in zip(*own)]
    last = [(vec_id, *near(x)[::-1]) for vec_id, x in kept]
    inertia = {k: sum(d for _, a, d in last if a == k) for k in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda n: n if n < 2**63 else None
    whole = long(sum(inertia.values()))
    return sorted(((v, k, long(d), long(inertia[k]), whole, digest[k]) for v, k, d in last), key=repr)


def found(spark, rows):
    prepare(spark)
    return sorted((tuple(r) for r in wc.cluster(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def vectors(n, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=64).astype(np.float32) * scale], 0) for i in range(n)]


def test_random_vectors_ties_and_repeats(spark):
    rows = vectors(120)
    rows += rows[:30]  # repeated rows
    rows += [(1000 + i, [0.0] * 64, 1) for i in range(20)]  # ties
    assert found(spark, rows) == brute(rows)


def test_nulls_wrong_sizes_and_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(25, 5)
    rows += [(90, None, 1), (91, [], 1), (92, [1.0] * 63, 1), (93, [1.0] * 65, 1), (94, [nan] + [1.0] * 63, None)]
    rows += [(95, [inf] + [1.0] * 63, 1), (96, [None] + [1.0] * 63, 1), (None, [0.5] * 64, 1), (97, [-1e-30] * 64, None)]
    assert found(spark, rows) == brute(rows)


def test_wide_integers_are_exact(spark):
    rows = [(i, [x * 3e4 for x in e], 0) for i, e, _ in vectors(40, 7, 300.0)]
    assert found(spark, rows) == brute(rows)


def test_few_and_no_vectors(spark):
    assert found(spark, vectors(3)) == brute(vectors(3))
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_progressive_search_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-50, 50, (16, 64))
    x = np.concatenate([centroids[rng.integers(0, 16, 300)] + rng.integers(-9, 9, (300, 64)), np.repeat(centroids, 2, 0)])
    centroids[5] = centroids[3]
    best, distance, finished = wc.nearest(x, centroids)
    full = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert finished < 0.5 * full.size  # most centroids are eliminated early


def test_transform_keeps_distances():
    x = np.random.default_rng(1).integers(-1000, 1000, (5, 64))
    spectrum = wc.transform(x)
    assert ((spectrum**2).sum(1) == 64 * (x**2).sum(1)).all()
    signs = wc.transform(np.eye(64, dtype=np.int64))[:, wc._ORDER].T
    assert ((signs[:, 1:] != signs[:, :-1]).sum(1) == np.arange(64)).all()
