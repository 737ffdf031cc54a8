"""Top-k search against all products: repeated rows and ids, working names as columns, components of any size, and pruning that takes part."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import topk


def plain(rows, k=5):
    whole = lambda v: [math.floor(256 * float(x)) for x in v]
    fine = [(i, whole(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, v) in enumerate(fine):
        if i % 50 == 0:
            scores = [(-sum(x * y for x, y in zip(v, w)), j, b) for b, (j, w) in enumerate(fine) if b != a and len(w) == len(v)]
            for rank, (s, j, _) in enumerate(sorted(scores)[:k], 1):
                out[(i, rank, j, max(-(2**63), min(2**63 - 1, -s)))] += 1
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for name in ("dim", "bin", "block", "bucket", "bound", "row", "query", "norm2", "v"):
        df = df.withColumn(name, F.lit("x"))
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, "vec_id % 50 = 0").collect())


def test_rows_that_repeat(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [rows[0], rows[50], rows[7], rows[7], (3, rows[4][1])]
    assert found(spark, rows) == plain(rows)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(100 + i, [float(x) * 1e17 for x in rng.normal(size=3)]) for i in range(5)] + [(200, [1e150, -1e150, 0.5]), (201, [-1e200, 1.0, 1e200])]
    rows += [(300, [float("inf"), 0.0, 0.0]), (350, [float("nan")] * 3), (400, None), (450, [None, 1.0, 1.0]), (500, [0.0, 0.0, 0.0])]
    assert found(spark, rows) == plain(rows)


def test_buckets_are_pruned_and_nothing_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in (centre + 0.4 * rng.normal(size=8)) * (1 + (i % 40) / 8)]) for i in range(1500)]
    assert found(spark, rows) == plain(rows)
    q, v = (np.floor(256 * np.array([r[1] for r in rows[:n]])) for n in (50, 1500))
    bound = np.sort(q @ v.T, axis=1)[:, -6].astype(float)
    seen = []
    exact = topk.exact_products
    monkeypatch.setattr(topk, "exact_products", lambda a, b: seen.append(len(a) * len(b)) or exact(a, b))
    topk.search(np.arange(50), q, bound, np.arange(1500), np.arange(1500), v, 5)
    assert sum(seen) < 0.5 * 50 * 1500
