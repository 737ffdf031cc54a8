"""Line work against plain versions: unions of squares on a lattice, straight and turned, stars, holes, and stretches of lines."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import linework, shapes

SEGMENT = "x1 double, y1 double, x2 double, y2 double"


def squares(spark, rows, turned):
    form = (lambda x, y: (3.0 * x - 4.0 * y, 4.0 * x + 3.0 * y)) if turned else (lambda x, y: (float(x), float(y)))
    def ring(x, y, n, way):
        return [{"x": a, "y": b} for a, b in (form(x + i * n, y + j * n) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)))][::way]
    return spark.createDataFrame([(g, [[ring(x, y, n, 1 if k % 2 else -1)]]) for k, (g, x, y, n) in enumerate(rows)], "g int, parts " + shapes.PARTS)


def lattice(rows):
    cells = defaultdict(set)
    for g, x, y, n in rows:
        cells[g] |= {(x + i, y + j) for i in range(n) for j in range(n)}
    sides = lambda own: sum((x + i, y + j) not in own for x, y in own for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    return {g: (len(own), sides(own)) for g, own in cells.items()}


def measured(pieces):
    area = F.sum((F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2)
    return {r["g"]: (r["a"], r["l"]) for r in pieces.groupBy("g").agg(area.alias("a"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("l")).collect()}


@pytest.mark.parametrize("turned", [False, True])
def test_unions_and_their_rings(spark, turned):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(x), int(y), int(n)) for g, x, y, n in zip(rng.integers(0, 3, 60), rng.integers(-6, 6, 60), rng.integers(-6, 6, 60), rng.integers(1, 4, 60))]
    rows += [(7, 0, 0, 2), (7, 0, 0, 2), (7, 2, 2, 1), (8, 5, 5, 1)]
    rows += [(9, x, y, 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)]  # a ring with a hole
    pieces = linework.outline(squares(spark, rows, turned), ["g"], 7.0).cache()
    got, want = measured(pieces), lattice(rows)
    unit = 5 if turned else 1
    assert set(got) == set(want)
    for g, (area, length) in want.items():
        assert abs(got[g][0] - area * unit * unit) < 1e-6 and abs(got[g][1] - length * unit) < 1e-6, g
    found = defaultdict(list)
    for r in linework.rings(pieces, ["g"]).collect():
        found[r["g"]].append((r["hole"], [(p["x"], p["y"]) for p in r["corners"]]))
    for g, (area, length) in want.items():
        ends = [list(zip(ring, ring[1:] + ring[:1])) for _, ring in found[g]]
        assert abs(sum(math.dist(a, b) for e in ends for a, b in e) - length * unit) < 1e-6
        assert abs(sum(a[0] * b[1] - a[1] * b[0] for e in ends for a, b in e) / 2 - area * unit * unit) < 1e-6
    assert sorted(hole for hole, _ in found[9]) == [False, True] and [hole for hole, _ in found[8]] == [False]
    assert len(found[7]) == 2  # squares that touch in a corner


def test_a_star_of_two_squares(spark):
    square = lambda turn: [{"x": math.sqrt(2) * math.cos(turn + k * math.pi / 2), "y": math.sqrt(2) * math.sin(turn + k * math.pi / 2)} for k in range(4)]
    df = spark.createDataFrame([(1, [[square(0.2)]]), (1, [[square(0.2 + math.pi / 4)]])], "g int, parts " + shapes.PARTS)
    pieces = linework.outline(df, ["g"], 0.7).cache()
    octagon = 2 * (math.sqrt(2) - 1)
    area, length = measured(pieces)[1]
    assert abs(area - (8 - octagon * 4)) < 1e-9 and abs(length - 8 * (2 - octagon)) < 1e-9 and pieces.count() == 16
    ring = linework.rings(pieces, ["g"]).collect()
    assert len(ring) == 1 and len(ring[0]["corners"]) == 16 and not ring[0]["hole"]


def test_what_lines_leave_of_lines(spark):
    rng = np.random.default_rng(4)
    new, old, want = [], [], {}
    for line in range(12):
        a, d = rng.integers(-50, 50, 2), rng.integers(-4, 5, 2)
        d = d if d.any() else np.array([1, 0])
        at = lambda t: (float(a[0] + t * d[0]), float(a[1] + t * d[1]))  # noqa: E731, B023
        gone = set()
        for _ in range(rng.integers(0, 6)):
            low = int(rng.integers(0, 40))
            high = low + int(rng.integers(1, 8))
            gone |= set(range(low, high))
            old.append((*at(low), *at(high)) if rng.random() < 0.5 else (*at(high), *at(low)))
        for k in range(4):
            low = int(rng.integers(0, 35))
            high = low + int(rng.integers(1, 12))
            new.append((line * 10 + k, *at(low), *at(high)))
            left = len(set(range(low, high)) - gone) * math.hypot(*d)
            if left:
                want[line * 10 + k] = left
    old += [(-60.0, -60.0, 60.0, 61.0), (3.0, 3.0, 3.0, 3.0)]
    left = linework.line_difference(spark.createDataFrame(new, "id int, " + SEGMENT), spark.createDataFrame(old, SEGMENT), 6.0, 1e-9)
    got = {r["id"]: r["l"] for r in left.groupBy("id").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("l")).collect()}
    # lines of different numbers may lie on each other by chance
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    none = linework.line_difference(spark.createDataFrame(new, "id int, " + SEGMENT), spark.createDataFrame([], SEGMENT), 6.0)
    assert none.count() == len(new)


def test_repeated_shapes_are_worked_once(spark, monkeypatch):
    rows = [(1, 0, 0, 2), (1, 1, 1, 2)] * 20 + [(2, 0, 0, 1)] * 30
    seen = []
    noded = linework.noded
    monkeypatch.setattr(linework, "noded", lambda sides, *more: seen.append(sides.count()) or noded(sides, *more))
    got = measured(linework.outline(squares(spark, rows, False), ["g"], 7.0))
    assert seen == [12] and {g: (round(a, 9), round(n, 9)) for g, (a, n) in got.items()} == {1: (7.0, 12.0), 2: (1.0, 4.0)}
