"""Top-k search against all products by brute force."""

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import topk as T


def brute(rows, k, mod):
    ok = [(i, np.floor(T.SCALE * np.asarray(v, dtype=np.float64))) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % mod == 0:
            s = sorted((-int(q @ v), j) for b, (j, v) in enumerate(ok) if a != b and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def check(spark, rows, k=5, mod=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, vec string")
    assert sorted(map(tuple, T.search(df, F.col("vec_id") % mod == 0, k).collect())) == brute(rows, k, mod)


def test_random_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 40)
    monkeypatch.setattr(T, "CHUNK", 16)
    r = np.random.default_rng(1)
    centers = r.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.1 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]
    check(spark, rows, k=7, mod=10)


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, []),
            (6, [0.0, 0.0]), (7, [-1.0, 0.5]), (9, [3.0]), (12, [2.0]), (15, [1.0, 2.0, 3.0])]
    check(spark, rows)
    check(spark, [])
    check(spark, [(3, [1.0])])


def test_share_of_products_on_clustered_vectors(spark, monkeypatch):
    """Vectors in tight clusters: most annuli are never visited, and a query
    whose clusters lie near still gets the exact result."""
    monkeypatch.setattr(T, "FIRST", 2)
    monkeypatch.setattr(T, "GROWTH", 3)
    r = np.random.default_rng(7)
    centers = r.normal(size=(20, 16)) * 4
    rows = [(i, (centers[i % 20] + 0.05 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    seen = {}
    got = T.search(df, F.col("vec_id") % 10 == 0, 5, report=seen)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10)
    assert seen["all"] == 120 * 1200 and seen["products"] < 0.4 * seen["all"] and seen["rounds"] >= 2
    assert T.search(df, F.lit(False), 5).collect() == []
