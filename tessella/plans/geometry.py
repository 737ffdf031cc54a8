"""Polygons, rays, corridors, line work and rasters over the driver's tables."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import geometry, linework, raster, shapes
from tessella.operators.models import draw_summary, draw_sums, weights_sql
from tessella.plans.registry import query
from tessella.plans.spatial import STEP, _P, _R, _points, _raster
from tessella.session import settle, spread
from tessella.sources import features

c = F.col

# a diamond around a part's place: its corners are r to each side
_DIAMOND = "d as (select p_partkey as poly, cast((p_partkey * 31) % 3001 as double) as cx, cast((p_partkey * 47) % 2003 as double) as cy, cast(p_size * 2 as double) as r from part)"


def _diamonds(t):
    at = t.part.select(c("p_partkey").alias("poly"), ((c("p_partkey") * 31) % 3001).cast("double").alias("cx"), ((c("p_partkey") * 47) % 2003).cast("double").alias("cy"), (c("p_size") * 2).cast("double").alias("r"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(c("cx") - c("r"), c("cy")), corner(c("cx"), c("cy") - c("r")), corner(c("cx") + c("r"), c("cy")), corner(c("cx"), c("cy") + c("r")))
    return at.select("poly", ring.alias("corners"))


@query(_P + ", " + _DIAMOND + " select id, poly from p join d on abs(x - cx) + abs(y - cy) <= r")
def point_in_polygon(t):
    return geometry.points_in_polygons(_points(t).select("id", "x", "y"), _diamonds(t), out=["id"])


_CELL_GAP = "greatest(ix * 150 - cx, 0, cx - ix * 150 - 150) + greatest(iy * 150 - cy, 0, cy - iy * 150 - 150)"


@query("with " + _DIAMOND + f" select cast(ix as int) as ix, cast(iy as int) as iy, count(*) as n, 1 as flooded from d, range(-1, 22) a(ix), range(-1, 16) b(iy) where {_CELL_GAP} <= r group by 1, 2")
def polygon_cells(t):
    met = geometry.polygon_cells(_diamonds(t), STEP)
    return met.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.max(F.lit(1)).alias("flooded"))


@query("with " + _DIAMOND + f" select poly, round(any_value(2 * r * r), 3) as area, count(*) as cells from d, range(-1, 22) a(ix), range(-1, 16) b(iy) where {_CELL_GAP} < r group by 1")
def polygon_overlay_area(t):
    parts = geometry.overlay_areas(_diamonds(t), STEP, ["poly"])
    return parts.groupBy("poly").agg(F.round(F.sum("area"), 3).alias("area"), F.count("*").alias("cells"))


# two parts: a diamond with a hole of half its size, and one of a quarter beside it
_FAR = "(greatest(abs(ix * 150 - cx), abs(ix * 150 + 150 - cx)) + greatest(abs(iy * 150 - cy), abs(iy * 150 + 150 - cy)))"
_GAP_BESIDE = _CELL_GAP.replace("cx", "(cx + 3 * r)")


def _ring(cx, cy, a, b):
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(cx - a, cy), corner(cx, cy - b), corner(cx + a, cy), corner(cx, cy + b))


def _shapes(t, part=None):
    at = (t.part if part is None else part).select(c("p_partkey").alias("poly"), ((c("p_partkey") * 31) % 3001).cast("double").alias("cx"), ((c("p_partkey") * 47) % 2003).cast("double").alias("cy"), (c("p_size") * 2).cast("double").alias("r"))
    ring = lambda x, r: _ring(x, c("cy"), r, r)
    return at.select("poly", F.array(F.array(ring(c("cx"), c("r")), ring(c("cx"), c("r") / 2)), F.array(ring(c("cx") + 3 * c("r"), c("r") / 4))).alias("parts"))


@query(_P + ", " + _DIAMOND + " select id, poly from p join d on abs(x - cx) + abs(y - cy) between r / 2 and r or abs(x - cx - 3 * r) + abs(y - cy) <= r / 4")
def points_in_shapes(t):
    return shapes.points_in_shapes(_points(t).select("id", "x", "y"), _shapes(t), ["poly"], out=["id"])


@query(_P + ", " + _DIAMOND + " select id, count(d.poly) as holders from p left join d on abs(x - cx) + abs(y - cy) > r / 2 and abs(x - cx) + abs(y - cy) < r or abs(x - cx - 3 * r) + abs(y - cy) < r / 4 group by 1")
def points_within_shapes(t):
    # strictly inside, as contains has it; points in no shape stay
    held = shapes.holders_of_points(_points(t).select("id", "x", "y"), _shapes(t), boundary=False, out=["id"])
    return held.groupBy("id").agg(F.sum("holders").alias("holders"))


@query("with " + _DIAMOND + f", g as (select distinct cast(floor(x / 150) as int) as ix, cast(floor(y / 150) as int) as iy from (select (c_custkey * 7919) % 3001 as x, (c_custkey * 104729) % 2003 as y from customer))"
       f" select ix, iy, count(poly) as n, cast(count(poly) > 0 as int) as flooded from g left join d on ({_CELL_GAP} <= r and {_FAR} >= r / 2) or {_GAP_BESIDE} <= r / 4 group by 1, 2")
def flooded_cells(t):
    # every cell of the grid with the shapes that it meets: those that none meets, be it for a hole, are there with 0
    cell = lambda v: F.floor(c(v) / STEP).cast("int")
    cells = _points(t).select(cell("x").alias("ix"), cell("y").alias("iy")).distinct()
    met = shapes.shape_cells(_shapes(t), STEP, ["poly"]).groupBy("ix", "iy").agg(F.count("*").alias("met"))
    n = F.coalesce("met", F.lit(0))
    return cells.join(met, ["ix", "iy"], "left").select("ix", "iy", n.alias("n"), (n > 0).cast("int").alias("flooded"))


@query("with " + _DIAMOND + f" select poly, round(any_value(2 * r * r - r * r / 2 + r * r / 8), 3) as area, count(*) as cells from d, range(-2, 25) a(ix), range(-2, 16) b(iy) where ({_CELL_GAP} < r and {_FAR} > r / 2) or {_GAP_BESIDE} < r / 4 group by 1")
def shape_overlay_area(t):
    parts = shapes.overlay_areas(_shapes(t), STEP, ["poly"])
    return parts.groupBy("poly").agg(F.round(F.sum("area"), 3).alias("area"), F.count("*").alias("cells"))


@query("with " + _DIAMOND + " select poly, 'MultiPolygon' as kind, 2 as n_parts, 3 as n_rings, 9 + 2 * 9 + 3 * (4 + 5 * 16) as n_bytes, round(2 * r * r - r * r / 2 + r * r / 8, 3) as area from d")
def shape_wkb_round_trip(t):
    # shapes written as well-known binary and read again
    told = features.shapes_to_wkb(_shapes(t, spread(t.part)).withColumn("kind", F.lit("MultiPolygon"))).select("poly", "wkb")
    back = features.parse_wkb_shapes(told, "wkb")
    return back.select("poly", "kind", F.size("parts").alias("n_parts"), F.size(F.flatten("parts")).alias("n_rings"), F.length("wkb").alias("n_bytes"), F.round(shapes.area(c("parts")), 3).alias("area"))


_ZONES = "d as (select p_partkey as poly, p_partkey * 31 % 101 + 0.3 as cx, p_partkey * 47 % 499 + 0.2 as cy, p_size % 9 + 1.37 as a, p_size % 5 + 2.61 as b from part)"


@query(_R + ", " + _ZONES + """ select poly, count(*) as n, round(avg(z), 9) as mean from d join r on j between cx - a - 1 and cx + a + 1 and i between cy - b - 1 and cy + b + 1 and z >= 20
 and abs(j + 0.5 - cx) / a + abs(i + 0.5 - cy) / b between 0.5 and 1 group by 1""")
def zonal_mean_of_shapes(t):
    # pixels whose centres lie in slanted shapes with a hole; pixels without a value play no part
    k, size = c("p_partkey"), c("p_size")
    at = t.part.select(k.alias("poly"), (k * 31 % 101 + 0.3).alias("cx"), (-(k * 47 % 499 + 0.2)).alias("cy"), (size % 9 + 1.37).alias("a"), (size % 5 + 2.61).alias("b"))
    zones = at.select("poly", F.array(F.array(_ring(c("cx"), c("cy"), c("a"), c("b")), _ring(c("cx"), c("cy"), c("a") / 2, c("b") / 2))).alias("parts"))
    pixels = _raster(t).select(c("i").cast("int").alias("row"), c("j").cast("int").alias("col"), F.when(c("z") >= 20, c("z")).alias("value"))
    means = shapes.zonal_means(zones, ["poly"], pixels, 0.0, 0.0, (1.0, 1.0), 1 << 30, 100)
    return means.select("poly", "n", F.round("mean", 9).alias("mean"))


_ROADS = "r as (select o_orderkey as id, o_custkey % 100 as line, o_orderkey % 997 as low, o_orderkey % 997 + 5 + o_custkey % 20 as high, o_orderpriority as p from orders)"


@query("with " + _ROADS + """, u as (select id, line, unnest(range(cast(low as bigint), cast(high as bigint))) as k from r where p = '1-URGENT'), o as (select distinct line, unnest(range(cast(low as bigint), cast(high as bigint))) as k from r where p = '2-HIGH')
 select id, count(*) as length from u where not exists (select 1 from o where o.line = u.line and o.k = u.k) group by 1""")
def overlay_difference(t):
    low = (c("o_orderkey") % 997).cast("double")
    roads = t.orders.select(c("o_orderkey").alias("id"), (c("o_custkey") % 100).alias("line"), low.alias("low"), (low + 5 + c("o_custkey") % 20).alias("high"), c("o_orderpriority").alias("p"))
    left = geometry.line_difference(roads.where("p = '1-URGENT'").drop("p"), roads.where("p = '2-HIGH'").drop("p"), ["line"])
    return left.groupBy("id").agg(F.sum(c("high") - c("low")).cast("bigint").alias("length"))


@query("with " + _ROADS + """, u as (select id, line, unnest(range(cast(low as bigint), cast(high as bigint))) as k from r where p = '1-URGENT'), o as (select distinct line, unnest(range(cast(low as bigint), cast(high as bigint))) as k from r where p = '2-HIGH')
 select id, 5 * count(*) as length from u where not exists (select 1 from o where o.line = u.line and o.k = u.k) group by 1""")
def line_difference_plane(t):
    # the same roads as segments in the plane, of two directions, without their lines' names
    low, line = (c("o_orderkey") % 997).cast("double"), c("o_custkey") % 100
    high = low + 5 + c("o_custkey") % 20
    way = [F.when(line % 2 == 0, a).otherwise(b) for a, b in ((3.0, 4.0), (4.0, -3.0))]
    x, y = (lambda at: line * 10_000.0 + at * way[0]), (lambda at: at * way[1])
    ends = [x(low).alias("x1"), y(low).alias("y1"), x(high).alias("x2"), y(high).alias("y2")]
    roads = t.orders.select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("p"), *ends)
    left = linework.line_difference(roads.where("p = '1-URGENT'").drop("p"), roads.where("p = '2-HIGH'").drop("p"), 300.0, 1e-6)
    return left.groupBy("id").agg(F.round(F.sum(F.hypot(c("x2") - c("x1"), c("y2") - c("y1")))).cast("bigint").alias("length"))


_LATTICE = "s as (select p_size % 5 as zone, p_partkey * 31 % 211 as x, p_partkey * 47 % 97 as y, 1 + p_size % 3 as n from part), u as (select distinct zone, x + i as x, y + j as y from s, range(0, 3) a(i), range(0, 3) b(j) where i < n and j < n)"


@query("with " + _LATTICE + """, e as (select u.*, (select count(*) from range(0, 4) d(k) where not exists (select 1 from u v where v.zone = u.zone and v.x = u.x + [0, 1, 0, -1][k + 1] and v.y = u.y + [1, 0, -1, 0][k + 1])) as open from u)
 select cast(zone as int) as zone, count(*) as area, cast(sum(open) as bigint) as length from e group by 1""")
def dissolve_outline(t):
    # squares of one to three units, turned and drawn to five times their size, united by zone
    x, y, n = (c("p_partkey") * 31 % 211), (c("p_partkey") * 47 % 97), 1 + c("p_size") % 3
    corner = lambda i, j: F.struct((3.0 * (x + i * n) - 4.0 * (y + j * n)).alias("x"), (4.0 * (x + i * n) + 3.0 * (y + j * n)).alias("y"))
    squares = t.part.select((c("p_size") % 5).cast("int").alias("zone"), F.array(F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))).alias("parts"))
    pieces = linework.outline(squares, ["zone"], 12.0)
    area, length = F.sum(c("x1") * c("y2") - c("x2") * c("y1")) / 2, F.sum(F.hypot(c("x2") - c("x1"), c("y2") - c("y1")))
    return pieces.groupBy("zone").agg(F.round(area / 25).cast("bigint").alias("area"), F.round(length / 5).cast("bigint").alias("length"))


def _centroids(t):
    k = c("n_nationkey")
    return t.nation.select(F.lit(0).alias("city"), (k + 1).cast("bigint").alias("id"), ((k * 7919 + 100) % 3001).cast("double").alias("x"), ((k * 3079 + 300) % 2003).cast("double").alias("y"))


_RAYS = """n as (select cast(n_nationkey + 1 as bigint) as id, cast((n_nationkey * 7919 + 100) % 3001 as double) as x, cast((n_nationkey * 3079 + 300) % 2003 as double) as y from nation),
 seg as (select a.id, b.id as other, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from n a join n b on a.id < b.id union all select id, 0, x, y, 1500.0, 1000.0 from n),
 k as (select seg.*, cast(ix as int) as ix, cast(iy as int) as iy, x2 - x1 as dx, y2 - y1 as dy, ix * 150.0 as a, iy * 150.0 as b, ix * 150.0 + 150 as c, iy * 150.0 + 150 as d from seg, range(-4, 24) r(ix), range(-4, 18) q(iy)),
 l as (select *, [case when dx = 0 then case when x1 between a and c then 0.0 else 2.0 end else least((a - x1) / dx, (c - x1) / dx) end, case when dy = 0 then case when y1 between b and d then 0.0 else 2.0 end else least((b - y1) / dy, (d - y1) / dy) end, 0.0] as lo,
  [case when dx = 0 then 1.0 else greatest((a - x1) / dx, (c - x1) / dx) end, case when dy = 0 then 1.0 else greatest((b - y1) / dy, (d - y1) / dy) end, 1.0] as hi from k),
 e as (select *, list_max(lo) <= list_min(hi) as meets, sqrt(greatest(a - x1, 0, x1 - c) ** 2 + greatest(b - y1, 0, y1 - d) ** 2) as e1, sqrt(greatest(a - x2, 0, x2 - c) ** 2 + greatest(b - y2, 0, y2 - d) ** 2) as e2,
  list_transform([[a, b], [a, d], [c, b], [c, d]], lambda p: coalesce(sqrt((p[1] - x1 - least(1, greatest(0, ((p[1] - x1) * dx + (p[2] - y1) * dy) / nullif(dx * dx + dy * dy, 0))) * dx) ** 2 + (p[2] - y1 - least(1, greatest(0, ((p[1] - x1) * dx + (p[2] - y1) * dy) / nullif(dx * dx + dy * dy, 0))) * dy) ** 2), 1e9)) as corner from l),
 near as (select id, other, ix, iy, case when meets then 0.0 else least(e1, e2, list_min(corner)) end as dist from e)"""


@query("with " + _RAYS + " select id, other, ix, iy from near where dist <= 0")
def corridor_rays(t):
    rays = geometry.rays(_centroids(t), (1500.0, 1000.0), ["city"])
    return geometry.corridors(rays, STEP, 0.0, ["id", "other"])


_WIDTHS = (0, 100, 150, 200, 250, 300)


@query("with " + _RAYS + """, g as (select cast(floor(x / 150) as int) as ix, cast(floor(y / 150) as int) as iy, count(*) as n from (select cast((c_custkey * 7919) % 3001 as double) as x, cast((c_custkey * 104729) % 2003 as double) as y from customer) group by 1, 2),
 m as (select ix, iy, min(dist) as dist from near where other = 0 group by 1, 2),
 s as (select v.w as width, k.draw, n, coalesce(round(dist, 6) <= v.w, false) as inside, case when draw < 0 then 1 else """ + weights_sql("(ix * 1000 + iy)", "greatest(draw, 0)") + """ end as w from g left join m using (ix, iy), (values (0), (100), (150), (200), (250), (300)) v(w), range(-1, 500) k(draw)),
 f as (select width, draw, count(*) filter (inside) as cells, sum(w * n) filter (inside) / nullif(sum(w) filter (inside), 0) - sum(w * n) filter (not inside) / nullif(sum(w) filter (not inside), 0) as coef from s group by 1, 2)
 select width, any_value(cells) as cells, round(any_value(coef) filter (draw < 0), 6) as coef, round(stddev_pop(coef) filter (draw >= 0), 6) as se from f group by 1""")
def corridor_width_refit(t):
    # cells by their distance to the nearest ray to the centre, so all widths are refitted from one pass
    inward = geometry.rays(_centroids(t), (1500.0, 1000.0), ["city"]).where("other = 0")
    k = [c("ix") * STEP, c("iy") * STEP, (c("ix") + 1) * STEP, (c("iy") + 1) * STEP]
    box = [v.cast("double") for v in k]
    wide = geometry.corridors(inward, STEP, float(max(_WIDTHS)), ["id", "x1", "y1", "x2", "y2"])
    dist = F.round(geometry.segment_box_distance(c("x1"), c("y1"), c("x2"), c("y2"), *box), 6)
    nearest = wide.groupBy("ix", "iy").agg(F.min(dist).alias("dist"))
    cell = lambda v: F.floor(c(v) / STEP).cast("int")
    counts = _points(t).groupBy(cell("x").alias("ix"), cell("y").alias("iy")).agg(F.count("*").alias("n"))
    cells = counts.join(nearest, ["ix", "iy"], "left").select((c("ix") * 1000 + c("iy")).cast("bigint").alias("key"), c("n").cast("double").alias("y"), "dist")
    hit = {w: F.coalesce(c("dist") <= w, F.lit(False)).cast("double") for w in _WIDTHS}
    sums = {"y": c("y")} | {f"x{w}": x for w, x in hit.items()} | {f"xy{w}": x * c("y") for w, x in hit.items()}

    def coefs(frame):
        fits = [F.struct(F.lit(w).alias("width"), c(f"x{w}").cast("bigint").alias("cells"), (F.try_divide(c(f"xy{w}"), c(f"x{w}")) - F.try_divide(c("y") - c(f"xy{w}"), c("n") - c(f"x{w}"))).alias("coef")) for w in _WIDTHS]
        return frame.select(F.explode(F.array(*fits)).alias("f")).select("f.*")

    cells = settle(cells, "corridor-cells")
    whole = coefs(cells.agg(F.count("*").alias("n"), *[F.sum(e).alias(n) for n, e in sums.items()]))
    drawn = draw_summary(coefs(draw_sums(cells, "key", sums, 500)), "coef", ["width"])
    return whole.join(drawn, "width").select("width", "cells", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"))


@query("select event_id, cast(user_id % 40 - 5 as int) as r, cast(event_id % 60 - 10 as int) as c from events where user_id % 40 - 5 between 0 and 29 and event_id % 60 - 10 between 0 and 39 and value is not null and value <> 0")
def raster_valid_ids(t):
    r, col = (c("user_id") % 40 - 5).cast("int"), (c("event_id") % 60 - 10).cast("int")
    return t.events.select("event_id", r.alias("r"), col.alias("c"), "value").where(raster.valid(c("r"), c("c"), 30, 40, c("value"), 0.0)).drop("value")


@query(_R + """, v as (select i, j, case when z < 20 then null else z end as z from r), n as (select max(i) as mi, max(j) as mj from r),
 f as (select a.i, a.j, a.z, coalesce(a.z, 0) as z0, coalesce(w.z, 0) as w, coalesce(e.z, 0) as e, coalesce(u.z, 0) as u, coalesce(s.z, 0) as s, w.i is null as no_w, e.i is null as no_e, u.i is null as no_u, s.i is null as no_s from v a left join v w on w.i = a.i and w.j = a.j - 1 left join v e on e.i = a.i and e.j = a.j + 1 left join v u on u.i = a.i - 1 and u.j = a.j left join v s on s.i = a.i + 1 and s.j = a.j)
 select i, j, round(sqrt(((case when no_w then e - z0 when no_e then z0 - w else (e - w) / 2 end) / 30) ** 2 + ((case when no_u then s - z0 when no_s then z0 - u else (s - u) / 2 end) / 30) ** 2), 6) as slope from f where z is not null""")
def slope_nodata(t):
    cells = _raster(t).withColumn("z", F.when(c("z") >= 20, c("z")))
    return raster.slope(cells, 30.0, 30.0).select("i", "j", F.round("slope", 6).alias("slope"))


@query(_R + "select a.i, a.j, round(sum(coalesce(b.z, 0) * (3 * (di + 1) + dj + 2)), 3) as checksum, count(b.z) as held from r a, range(-1, 2) x(di), range(-1, 2) y(dj) left join r b on b.i = a.i + di and b.j = a.j + dj group by 1, 2")
def patch_extract(t):
    patches = raster.patches(_raster(t), 1)
    total = F.aggregate(F.transform("patch", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return patches.select("i", "j", F.round(total, 3).alias("checksum"), "held")


@query(_R + """, k as (select a.i, a.j, turn, mirror, di, dj, coalesce(b.z, 0) as z from r a, range(0, 4) t(turn), range(0, 2) m(mirror), range(-1, 2) x(di), range(-1, 2) y(dj) left join r b on b.i = a.i + di and b.j = a.j + dj),
 g as (select *, case turn when 0 then di when 1 then -dj when 2 then -di else dj end as ri, case turn when 0 then dj when 1 then di when 2 then -dj else -di end as rj from k)
 select i, j, cast(turn as int) as turn, mirror = 1 as mirror, round(sum(z * (3 * (ri + 1) + (case when mirror = 1 then -rj else rj end) + 2)), 3) as checksum from g group by 1, 2, 3, 4""")
def augment_patches(t):
    turned = raster.augmented(raster.patches(_raster(t), 1), 3)
    total = F.aggregate(F.transform("patch", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return turned.select("i", "j", "turn", "mirror", F.round(total, 3).alias("checksum"))


@query(_R + "select i, j, round(avg(prob), 6) as prob from (select a.i, a.j, 1 / (1 + exp(-b.z / 100)) as prob from r a join r b on b.i between a.i - 1 and a.i + 1 and b.j = a.j) group by 1, 2")
def focal_mean_prob(t):
    spread = _raster(t).withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select((c("i") + c("o")).alias("i"), "j", (1 / (1 + F.exp(-c("z") / 100))).alias("p"))
    return spread.join(_raster(t).select("i", "j"), ["i", "j"]).groupBy("i", "j").agg(F.round(F.avg("p"), 6).alias("prob"))


@query(_R + """, m as (select i, j, z, 0 as tile from r where j < 60 union all select i, j, z + 1, 1 from r where j >= 40)
 select i, j, round(z, 6) as z from (select *, row_number() over (partition by i, j order by tile) as n from m where z is not null) where n = 1""")
def mosaic_tiles(t):
    a, b = _raster(t).where("j < 60"), _raster(t).where("j >= 40").withColumn("z", c("z") + 1)
    return raster.mosaic([a, b], ["i", "j"], "z").select("i", "j", F.round("z", 6).alias("z"))


@query()
def cnn_inference(t):
    # logits averaged over the patches of 18 cells around all cells; the raster of each city is dealt to tiles
    weights = raster.network(channels=1, seed=42)
    cells = _raster(t).select((c("i") % 4).cast("int").alias("city"), F.floor(c("i") / 4).cast("int").alias("row"), c("j").cast("int").alias("col"), (c("z") / 100).alias("z"))
    return raster.predict_patches(cells, "city", ["z"], weights)


@query(_R + """, a as (select i as ai, j as aj from r), w as (select ai, aj, ai - 2 + x.d as i, aj - 2 + y.d as j from a, range(0, 4) x(d), range(0, 4) y(d)),
 v as (select w.*, greatest(ai - 2, least(ai + 1, i + p.d)) as ni, greatest(aj - 2, least(aj + 1, j + q.d)) as nj from w, range(-1, 2) p(d), range(-1, 2) q(d)),
 l as (select ai, aj, v.i, v.j, sum(coalesce(n.z, 0)) / 9 as logit from v left join r n on n.i = ni and n.j = nj group by 1, 2, 3, 4)
 select l.i, l.j, round(avg(logit), 6) as logit from l join r on r.i = l.i and r.j = l.j group by 1, 2""")
def patch_prediction(t):
    # a net of one smoothing layer, so that SQL can follow it: patches of 4 cells with their edge repeated, averaged where they overlap
    layer = {"weight": np.full((1, 1, 3, 3), 1 / 9), "bias": np.zeros(1), "dilation": 1}
    cells = _raster(t).select(F.lit(0).alias("city"), c("i").cast("int").alias("row"), c("j").cast("int").alias("col"), "z")
    found = raster.predict_patches(cells, "city", ["z"], [layer], window=4, tile=16)
    return found.select(c("row").cast("bigint").alias("i"), c("col").cast("bigint").alias("j"), F.round("logit", 6).alias("logit"))


@query(_R + """, m(angle, down, right_) as (values (90.0, 0.0, 0.0), (0.0, 0.5, 0.0), (180.0, 0.0, 1.0)), k as (select a.i, a.j, angle, down, right_, x.d as di, y.d as dj from r a, m, range(-1, 2) x(d), range(-1, 2) y(d)),
 -- the cells that a new cell is made of, with their weights
 s as (select *, dj as si, -di as sj, 1.0 as w from k where angle = 90 union all select *, di, dj, 0.5 from k where down = 0.5 union all select *, di - 1, dj, 0.5 from k where down = 0.5 union all select *, -di, 1 - dj, 1.0 from k where angle = 180)
 select s.i, s.j, angle, down, right_ as right, round(sum(case when si between -1 and 1 and sj between -1 and 1 then w * coalesce(b.z, 0) else 0 end * (3 * (di + 1) + dj + 2)), 3) as checksum from s left join r b on b.i = s.i + si and b.j = s.j + sj group by all""")
def moved_patches(t):
    moved = raster.moved_patches(raster.patches(_raster(t), 1), 3, [(90.0, 0.0, 0.0), (0.0, 0.5, 0.0), (180.0, 0.0, 1.0)])
    total = F.aggregate(F.transform("patch", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return moved.select("i", "j", "angle", "down", "right", F.round(total, 3).alias("checksum"))
