"""Centroid clustering against a brute-force version in whole numbers of any size."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import clusters


def brute(rows, n=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and math.isfinite(64 * x) for x in v)]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=mark)[:n]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        return [(x.index(min(x)), min(x)) for x in d]

    for _ in range(rounds):
        of = assign()
        for k in range(len(centroids)):
            own = [v for (c, _), (_, v) in zip(of, kept) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    of = assign()
    most, inertia = 2**63 - 1, [sum(min(d, 2**63 - 1) for c, d in of if c == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, most), min(inertia[c], most), min(sum(inertia), most), sha[c]) for (i, _), (c, d) in zip(kept, of)), key=str)


def found(df, **more):
    return sorted((tuple(r) for r in clusters.clusters(df, **more).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "cluster", "of", "mark", "own")}).repartition(3)


def test_clusters(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (9, 64)) * rng.uniform(0.2, 3, (9, 1))
    rows = [(k, (centres[k % 9] + rng.normal(0, 0.1, 64)).tolist()) for k in range(300)]
    rows += [(400 + k, rows[5][1]) for k in range(40)]  # equal vectors: equal distances to equal centroids
    rows += [(7, rows[3][1]), (7, rows[8][1]), (None, rows[1][1]), (500, None), (501, [0.5] * 63), (502, [0.5] * 63 + [None]), (503, [float("nan")] * 64), (504, [float("inf")] * 64), (505, []), (506, [0.0] * 64), (507, [1e308] * 64)]
    df = frame(spark, rows)
    assert found(df) == brute(rows)
    assert found(df, n=3, rounds=1) == brute(rows, 3, 1)
    assert clusters.clusters(df.limit(0)).count() == 0
    assert found(df.filter("vec_id < 5")) == brute([r for r in rows if r[0] is not None and r[0] < 5])


def test_ties_and_equal_norms(spark):
    """Vectors on a small grid: many centroids at one distance and of one norm."""
    rng = random.Random(3)
    rows = [(k, [rng.choice((-1, 0, 1)) / 64 for _ in range(4)]) for k in range(200)]
    assert found(frame(spark, rows), width=4) == brute(rows, width=4)


def test_components_of_any_size(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice((-1, 1)) * 10.0 ** rng.randint(-3, 30) for _ in range(8)]) for k in range(60)]
    assert found(frame(spark, rows), width=8, n=4) == brute(rows, 4, width=8)


def test_annulus_leaves_centroids_out():
    """Centroids of other norms are not compared, and the nearest is found all the same."""
    rng = np.random.default_rng(1)
    values = [[int(v) for v in np.round(rng.normal(0, 10 * (k + 1), 8))] for k in range(40)]
    c = clusters.Centroids(values)
    x = np.round(rng.normal(0, 1, (500, 8)) * rng.uniform(1, 400, (500, 1)))
    of, d = c.nearest(x)
    every = ((x[:, None] - np.array(values, float)[None]) ** 2).sum(2)
    assert (of == every.argmin(1)).all() and (d == every.min(1)).all()


def test_limbs():
    for v in (0, 1, -1, 2**31, -(2**40), 2**100 + 5, -(2**100) - 5):
        parts = clusters.limbs(np.array([v, 3], object))
        assert sum(int(p[0]) << (32 * k) for k, p in enumerate(parts)) == v and all(p.dtype == np.int64 for p in parts)
