"""Radius joins and nearest sites against brute force, on crowded places, edges of bins and far points."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import grid


def places(rng, n):
    crowd = rng.integers(0, 12, (n, 2)).astype(float)
    return [*crowd.tolist(), *(rng.integers(-3, 4, (20, 2)) * 30.0).tolist(), [4000.5, -2000.25]]


def test_pairs_within_a_radius(spark):
    rng = np.random.default_rng(5)
    a, b = places(rng, 150), places(rng, 150)
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "id int, x double, y double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "other_id int, ox double, oy double")
    for radius in (3.0, 0.7, 30.0):
        got = grid.within_radius(left, right, radius).select("id", "other_id").collect()
        want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= radius * radius}
        assert set(map(tuple, got)) == want and len(got) == len(want)


def test_nearest_begins_with_a_grid_as_fine_as_the_rows(spark):
    rng = np.random.default_rng(7)
    a, b = places(rng, 200), places(rng, 80)
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "id int, x double, y double")
    sites = spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "other_id int, ox double, oy double")
    steps = []

    def own(df, step):
        steps.append(step)
        return df.withColumn("ix", grid.cell_of(F.col("ox"), 0.0, step)).withColumn("iy", grid.cell_of(F.col("oy"), 0.0, step))

    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    got = {r["id"]: (r["dist"], r["other_id"]) for r in grid.nearest(points, sites, own, d, 3000.0).collect()}
    want = {i: min((float(np.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)), j) for j, q in enumerate(b)) for i, p in enumerate(a)}
    assert got == want and min(steps) < 1000
    assert not grid.nearest(points.limit(0), sites, own, d, 5.0).count()
