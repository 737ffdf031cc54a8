"""Distances on the ellipsoid and shifts between datums, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half axis in metres and flattening of the ellipsoids, and the shift of the datum's centre to WGS 84's, x, y and z in metres.
DATUMS = {
    "WGS84": (6378137.0, 1 / 298.257223563, (0.0, 0.0, 0.0)),
    "NAD83": (6378137.0, 1 / 298.257222101, (0.0, 0.0, 0.0)),
    "NAD27": (6378206.4, 1 / 294.978698214, (-8.0, 160.0, 176.0)),
}
#: Rounds of the distance's iteration; each leaves some 1/300 of the error, but for points that are nearly opposite.
ROUNDS = 20


def _let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a struct of ``values``, each of which is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), 1)


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, datum: str = "WGS84") -> Column:
    """Metres between two points along the ellipsoid, by Vincenty's iteration on the difference of longitude on the auxiliary sphere.

    Null where a coordinate is null or the iteration doesn't settle, which is so for points within about half a degree of each other's antipode.
    """
    a, f, _ = DATUMS[datum]
    b = a * (1 - f)
    reduced = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    turn = F.radians(lon2 - lon1)
    shorter = F.atan2(F.sin(turn), F.cos(turn))
    ends = {"s1": F.sin(reduced(lat1)), "c1": F.cos(reduced(lat1)), "s2": F.sin(reduced(lat2)), "c2": F.cos(reduced(lat2)), "l": shorter}

    def along(e: Column, lam: Column, then: Callable[[Column], Column]) -> Column:
        """What ``then`` makes of the arc's sine and cosine, its length, the azimuth at the equator, 1 - azimuth's square and the middle's cosine."""

        def with_arc(t: Column) -> Column:
            across = e.c2 * t.sin
            up = e.c1 * e.s2 - e.s1 * e.c2 * t.cos
            return _let({"sin": F.sqrt(across * across + up * up), "cos": e.s1 * e.s2 + e.c1 * e.c2 * t.cos, "turn": t.sin}, with_azimuth)

        def with_azimuth(g: Column) -> Column:
            azimuth = F.when(g.sin == 0, 0.0).otherwise(e.c1 * e.c2 * g.turn / g.sin)
            return _let({"sin": g.sin, "cos": g.cos, "sigma": F.atan2(g.sin, g.cos), "azimuth": azimuth}, with_square)

        def with_square(g: Column) -> Column:
            return _let({"of": g, "square": 1 - g.azimuth * g.azimuth}, with_middle)

        def with_middle(h: Column) -> Column:
            mid = F.when(h.square < 1e-15, 0.0).otherwise(h.of.cos - 2 * e.s1 * e.s2 / h.square)
            return _let({"sin": h.of.sin, "cos": h.of.cos, "sigma": h.of.sigma, "azimuth": h.of.azimuth, "square": h.square, "mid": mid}, then)

        return _let({"sin": F.sin(lam), "cos": F.cos(lam)}, with_arc)

    def length(e: Column) -> Column:
        start = F.struct(e.l.alias("lam"), F.lit(1.0).alias("moved"))

        def step(state: Column, _: Column) -> Column:
            def advance(g: Column) -> Column:
                k = f / 16 * g.square * (4 + f * (4 - 3 * g.square))
                return _let({"new": e.l + (1 - k) * f * g.azimuth * (g.sigma + k * g.sin * (g.mid + k * g.cos * (2 * g.mid * g.mid - 1)))}, moved)

            def moved(n: Column) -> Column:
                return F.struct(n.new.alias("lam"), F.abs(n.new - state.lam).alias("moved"))

            # settled points keep what they have
            return F.when(state.moved < 1e-13, state).otherwise(along(e, state.lam, advance))

        def finish(state: Column) -> Column:
            def metres(g: Column) -> Column:
                u = g.square * (a * a - b * b) / (b * b)
                big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
                small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
                bend = small * g.sin * (g.mid + small / 4 * (g.cos * (2 * g.mid * g.mid - 1) - small / 6 * g.mid * (4 * g.sin * g.sin - 3) * (4 * g.mid * g.mid - 3)))
                return F.when(state.moved < 1e-11, b * big * (g.sigma - bend))

            return along(e, state.lam, metres)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, finish)

    return _let(ends, length)


def shifted(lon: Column, lat: Column, datum: str, to: str = "WGS84") -> tuple[Column, Column]:
    """Longitude and latitude of a point on another datum, by a shift of the ellipsoid's centre; heights are taken as 0.

    For NAD27 one shift stands for all of the contiguous states, which is right to some 10 metres; NAD83 and WGS84 have the same centre.
    """
    a, f, (dx, dy, dz) = DATUMS[datum]
    a2, f2, (ex, ey, ez) = DATUMS[to]
    phi, lam = F.radians(lat), F.radians(lon)
    e = f * (2 - f)
    n = a / F.sqrt(1 - e * F.pow(F.sin(phi), 2))
    x, y = n * F.cos(phi) * F.cos(lam) + (dx - ex), n * F.cos(phi) * F.sin(lam) + (dy - ey)
    z = n * (1 - e) * F.sin(phi) + (dz - ez)
    # Bowring's formula, whose error near the ground is far below a millimetre
    b2, e2 = a2 * (1 - f2), f2 * (2 - f2)
    flat = F.sqrt(x * x + y * y)
    theta = F.atan2(z * a2, flat * b2)
    top = z + e2 / (1 - e2) * b2 * F.pow(F.sin(theta), 3)
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(top, flat - e2 * a2 * F.pow(F.cos(theta), 3)))


def geodesic_sql(source: str, names: tuple[str, str, str, str], out: str, rounds: int = 8) -> str:
    """A select of all of ``source`` and the distance ``out`` in DuckDB's SQL, the iteration written out as nested selects."""
    a, f, _ = DATUMS["WGS84"]
    b = a * (1 - f)
    lon1, lat1, lon2, lat2 = names
    u = lambda lat: f"atan({1 - f!r} * tan(radians({lat})))"
    sql = f"select *, radians({lon2} - {lon1}) as l_, radians({lon2} - {lon1}) as m_, sin({u(lat1)}) as s1_, cos({u(lat1)}) as c1_, sin({u(lat2)}) as s2_, cos({u(lat2)}) as c2_ from {source}"
    work = ["ss_", "cs_", "sa_", "q_", "mid_", "k_"]
    for turn in range(rounds + 1):
        sql = f"select *, sqrt((c2_ * sin(m_)) ** 2 + (c1_ * s2_ - s1_ * c2_ * cos(m_)) ** 2) as ss_, s1_ * s2_ + c1_ * c2_ * cos(m_) as cs_ from ({sql})"
        sql = f"select *, case when ss_ = 0 then 0 else c1_ * c2_ * sin(m_) / ss_ end as sa_ from ({sql})"
        sql = f"select *, 1 - sa_ * sa_ as q_ from ({sql})"
        sql = f"select *, case when q_ < 1e-15 then 0 else cs_ - 2 * s1_ * s2_ / q_ end as mid_, {f / 16!r} * q_ * (4 + {f!r} * (4 - 3 * q_)) as k_ from ({sql})"
        if turn < rounds:
            sql = f"select * exclude ({', '.join(work)}) replace (l_ + (1 - k_) * {f!r} * sa_ * (atan2(ss_, cs_) + k_ * ss_ * (mid_ + k_ * cs_ * (2 * mid_ * mid_ - 1))) as m_) from ({sql})"
    sql = f"select *, q_ * {(a * a - b * b) / (b * b)!r} as u_ from ({sql})"
    sql = f"select *, 1 + u_ / 16384 * (4096 + u_ * (-768 + u_ * (320 - 175 * u_))) as big_, u_ / 1024 * (256 + u_ * (-128 + u_ * (74 - 47 * u_))) as small_ from ({sql})"
    bend = "small_ * ss_ * (mid_ + small_ / 4 * (cs_ * (2 * mid_ * mid_ - 1) - small_ / 6 * mid_ * (4 * ss_ * ss_ - 3) * (4 * mid_ * mid_ - 3)))"
    gone = ", ".join([*work, "l_", "m_", "s1_", "c1_", "s2_", "c2_", "u_", "big_", "small_"])
    return f"select * exclude ({gone}), {b!r} * big_ * (atan2(ss_, cs_) - {bend}) as {out} from ({sql})"


def half_meridian(datum: str = "WGS84") -> float:
    """Metres from the equator to a pole, by the series in the third flattening."""
    a, f, _ = DATUMS[datum]
    n = f / (2 - f)
    return math.pi / 2 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
