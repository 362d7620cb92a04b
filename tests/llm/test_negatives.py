"""Hard negatives against a brute-force version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallylake.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, negs=3, every=50):
    kept = [(i, lab, tuple(math.floor(256 * v) for v in e)) for i, e, lab in rows if i is not None and lab is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    score = lambda a, b: max(negatives.NONE + 1, min(negatives.MOST, sum(p * q for p, q in zip(a, b, strict=True))))
    out = []
    for i, lab, x in set(kept):
        if i % every:
            continue
        others = {(score(x, y), j, other) for j, other, y in kept if j != i and len(y) == len(x)}
        first = lambda found, k: sorted({(-s, j) for s, j in found})[:k]
        for ps, p in first(((s, j) for s, j, o in others if o == lab), positives):
            inside = [(s, j) for s, j, o in others if o != lab and 50 * -ps <= 100 * s <= 95 * -ps]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(first(inside, negs))]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("list", F.lit(1)).withColumn("task", F.lit(2)).repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, **kw).collect())


@pytest.mark.parametrize("kind", ["gauss", "clusters", "ties"])
def test_negatives_match_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 600
    if kind == "clusters":
        x = rng.normal(0, 1, (8, 8))[rng.integers(0, 8, n)] + rng.normal(0, 0.05, (n, 8))
    else:
        x = rng.normal(0, 0.3, (n, 8)) if kind == "gauss" else rng.integers(-1, 2, (n, 8)) / 2
    rows = [(i, v.tolist(), int(i * 7919 % 4)) for i, v in enumerate(x)]
    # a third of all rows are copies of one vector, under ids of their own
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(300)]
    expected = brute(rows, every=25)
    assert expected and found(spark, rows, every=25, lists=9, shelf_rows=100, block=64) == expected
    assert found(spark, rows, every=25, lists=3, sample=20) == expected


def test_odd_rows_repeated_ids_and_empty(spark):
    rng = random.Random(2)
    vec = lambda n=3: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(n)]
    rows = [(i % 40, vec(), i % 3) for i in range(160)] + [(i, vec(2), i % 2) for i in range(40)]
    rows += [(0, rows[0][1], 0)] * 3 + [(5, rows[5][1], 2)] * 30
    rows += [(None, vec(), 1), (10, None, 1), (20, vec(), None), (30, [None, 0.0, 1.0], 1), (10, [math.nan] * 3, 0), (10, [math.inf] * 3, 0), (10, [], 0)]
    expected = brute(rows, every=10)
    assert expected and found(spark, rows, every=10, lists=4, shelf_rows=16) == expected
    assert found(spark, []) == [] and found(spark, [(0, [1.0], 1)]) == [] and found(spark, [(0, None, 1)]) == []


def test_scores_beyond_64_bits(spark):
    rows = [(i, [float(1 << 26) * (1 + i), float(i)], i % 2) for i in range(12)]
    assert found(spark, rows, every=5) == brute(rows, every=5)


def test_lists_that_cannot_help_are_skipped():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 100, (32, 16))
    at = rng.integers(0, 32, 4000)
    x = np.floor(centres[at] + rng.normal(0, 2, (4000, 16)))
    lists = negatives.Lists(centres, {k: float(np.sqrt(((x[at == k] - centres[k]) ** 2).sum(axis=1)).max()) for k in range(32)}, {k: int((at == k).sum()) for k in range(32)}, 8192)
    bottom, top = lists.bounds(x[:200])
    scores = x[:200] @ x.T
    assert (scores <= top[:, at]).all() and (scores >= bottom[:, at]).all()
    search, ids = negatives.Search(lists, 5, False), np.arange(4000)
    members = {k: (ids[at == k], np.zeros(int((at == k).sum()), np.int64), x[at == k]) for k in range(32)}
    full = lambda v: np.full(200, v)
    task, name, score = search.run(x[:200], full(-1), full(1), full(negatives.NONE), full(negatives.MOST), full(negatives.NONE), members)
    for t in range(200):
        best = sorted(zip(-scores[t].astype(int), ids, strict=True))[:5]
        assert sorted(zip(-score[task == t], name[task == t], strict=True)) == best
    assert search.scored < 0.2 * 200 * 4000
