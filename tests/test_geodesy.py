"""Ellipsoidal distances and datum shifts against published values and closed forms."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.operators import geodesy


def degrees(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def test_distances(spark):
    rows = [
        # a published line of a national survey (on the ellipsoid of NAD83, whose lengths are WGS84's to a fraction of a millimetre)
        (degrees(144, 25, 29.52440), degrees(-37, 57, 3.72030), degrees(143, 55, 35.38390), degrees(-37, 39, 10.15610), 54972.271),
        (10.0, 0.0, 11.0, 0.0, math.radians(1) * 6378137.0),
        (179.5, 0.0, -179.5, 0.0, math.radians(1) * 6378137.0),
        (5.0, 0.0, 5.0, 90.0, geodesy.half_meridian()),
        (5.0, 90.0, 77.0, -90.0, 2 * geodesy.half_meridian()),
        (3.0, 4.0, 3.0, 4.0, 0.0),
        (0.0, 0.3, 179.9, -0.25, None),
        (None, 0.3, 1.0, 0.0, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double, d double, due double")
    got = [r[0] for r in df.orderBy("id").select(geodesy.geodesic(*map(F.col, "abcd"))).collect()]
    for (*_, due), m in zip(rows, got):
        assert (m is None) if due is None else abs(m - due) < 1e-3, (due, m)


def test_sql_says_the_same(spark):
    pairs = [(i, -120 + i * 0.7, 20 + i * 0.3, -119 + i * 0.4, 55 - i * 0.6) for i in range(60)]
    df = spark.createDataFrame(pairs, "id int, a double, b double, c double, d double")
    got = [r[0] for r in df.orderBy("id").select(geodesy.geodesic(*map(F.col, "abcd"))).collect()]
    values = ", ".join(str(p) for p in pairs)
    want = duckdb.sql("select m from (" + geodesy.geodesic_sql(f"(values {values}) v(id, a, b, c, d)", ("a", "b", "c", "d"), "m") + ") order by id").fetchall()
    assert max(abs(g - w[0]) for g, w in zip(got, want)) < 1e-5


def test_shifts(spark):
    df = spark.createDataFrame([(-degrees(98, 32, 30.506), degrees(39, 13, 26.686))], "x double, y double")
    x, y = df.select(*geodesy.shifted(F.col("x"), F.col("y"), "NAD27")).first()
    # the datum's origin, known in both; one shift for all states is right to some metres
    assert abs(x + degrees(98, 32, 31.74540)) * 86000 < 12 and abs(y - degrees(39, 13, 26.71220)) * 111000 < 12
    # there and back, and between ellipsoids of one centre
    lon, lat = geodesy.shifted(F.col("x"), F.col("y"), "NAD27")
    back = df.select(lon.alias("x"), lat.alias("y")).select(*geodesy.shifted(F.col("x"), F.col("y"), "WGS84", "NAD27")).first()
    assert abs(back[0] - df.first()[0]) < 1e-6 and abs(back[1] - df.first()[1]) < 1e-6
    same = df.select(*geodesy.shifted(F.col("x"), F.col("y"), "NAD83")).first()
    assert abs(same[0] - df.first()[0]) < 1e-9 and abs(same[1] - df.first()[1]) < 1e-8
    assert df.select(*geodesy.shifted(F.lit(None).cast("double"), F.col("y"), "NAD27")).first()[0] is None
    with pytest.raises(KeyError):
        geodesy.shifted(F.col("x"), F.col("y"), "moon")
