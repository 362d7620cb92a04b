"""Clustering on whole numbers, against a brute-force version in numbers of any size."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallylake.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dims, salt="2"):
    kept = [(i, [math.floor(256 * float(np.float32(v))) for v in e]) for i, e in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [r[1] for r in first[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for step in range(rounds + 1):
        best = [min((square(x, c), n) for n, c in enumerate(centroids)) for _, x in kept]
        if step < rounds:
            for n in range(len(centroids)):
                own = [x for (_, x), b in zip(kept, best, strict=True) if b[1] == n]
                if own:
                    centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted(((i is None, i, n, d) for (i, _), (d, n) in zip(kept, best, strict=True)), key=str), centroids


def found(spark, rows, k, rounds, dims):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).withColumn("x", F.lit("clash")).withColumn("cluster", F.lit(7)).repartition(3)
    out, centroids = kmeans.kmeans(df, k=k, rounds=rounds, dims=dims)
    return sorted(((r["vec_id"] is None, r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=str), centroids.tolist(), kmeans.with_inertia(out, centroids)


@pytest.mark.parametrize("seed", range(2))
def test_clusters_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) if seed else rng.gauss(0, 0.2) * (1 + i % 9) for _ in range(4)]) for i in range(300)]
    rows += [(7, [0.0] * 4), (7, [0.0] * 4), (None, [0.1] * 4), (900, None), (901, [None, 0.0, 0.0, 0.0]), (902, [math.nan] * 4), (903, [math.inf, 0.0, 0.0, 0.0]), (904, [0.0] * 3), (905, [])]
    expected, centroids = brute(rows, 12, 3, 4)
    got, own, full = found(spark, rows, 12, 3, 4)
    assert got == expected and own == centroids
    sums = {}
    for _, _, n, d in expected:
        sums[n] = sums.get(n, 0) + d
    for r in full.collect():
        assert (r["cluster_inertia"], r["inertia"]) == (sums[r["cluster"]], sum(sums.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_few_rows_and_empty(spark):
    got, own, _ = found(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0])], 40, 5, 2)
    assert len(own) == 2 and [r[2:] for r in got] == [(0, 0), (0, 0)]
    for rows in ([], [(1, None)], [(1, [0.0])]):
        got, own, full = found(spark, rows, 40, 2, 2)
        assert got == [] and own == [] and full.collect() == []


def test_beyond_doubles(spark):
    rows = [(i, [float(1 << 40) * (1 + i % 5), float(i)]) for i in range(40)]
    expected, centroids = brute(rows, 4, 2, 2)
    got, own, _ = found(spark, rows, 4, 2, 2)
    assert own == centroids and got == sorted(((a, b, c, min(d, kmeans.LONGEST)) for a, b, c, d in expected), key=str)


def test_annulus_compares_few_and_keeps_edges():
    rng = np.random.default_rng(3)
    centroids = np.array([[r * 50, 0, 0] for r in range(1, 41)])
    at = rng.integers(0, 40, 2000)
    x = centroids[at] + rng.integers(-3, 4, (2000, 3))
    search = kmeans.Annulus(centroids)
    best, _ = search.nearest(x, at)
    assert (best == at).all() and search.compared < 0.05 * 40 * search.rows
    # two centroids at the very same distance, the other one the smaller number
    search = kmeans.Annulus(np.array([[0, 10], [10, 0]]))
    best, least = search.nearest(np.array([[5, 5], [0, 0]]), np.array([1, 1]))
    assert best.tolist() == [0, 0] and least.tolist() == [50, 100]
