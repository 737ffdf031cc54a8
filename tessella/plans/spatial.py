"""Grids, spatial joins and distances. Customers and suppliers get coordinates from their keys; a city is a region."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import geodesy, grid, sequence
from tessella.plans.registry import query

c = F.col
STEP = 150
_P = "with p as (select c_custkey as id, n_regionkey as city, cast((c_custkey * 7919) % 3001 as double) as x, cast((c_custkey * 104729) % 2003 as double) as y, c_acctbal as v, c_mktsegment = 'BUILDING' as res from customer join nation on c_nationkey = n_nationkey), s as (select s_suppkey as id, cast((s_suppkey * 6151) % 3001 as double) as x, cast((s_suppkey * 3079) % 2003 as double) as y from supplier) "
_CELLS = ", g as (select city, ix, iy, count(*) as n, cast(ix * 14 + iy as bigint) as grid_id from (select city, cast(floor(x / 150) as int) as ix, cast(floor(y / 150) as int) as iy from p where x % 150 <> 0 and y % 150 <> 0) group by 1, 2, 3) "


def _points(t):
    city = F.broadcast(t.nation.select("n_nationkey", c("n_regionkey").alias("city")))  # one row per nation
    xy = [((c("c_custkey") * 7919) % 3001).cast("double").alias("x"), ((c("c_custkey") * 104729) % 2003).cast("double").alias("y")]
    return t.customer.join(city, c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("id"), "city", *xy, c("c_acctbal").alias("v"), (c("c_mktsegment") == "BUILDING").alias("res"))


def _sites(t):
    return t.supplier.select(c("s_suppkey").alias("other_id"), ((c("s_suppkey") * 6151) % 3001).cast("double").alias("ox"), ((c("s_suppkey") * 3079) % 2003).cast("double").alias("oy"))


def _in_cells(t):
    return _points(t).where(grid.strictly_inside(c("x"), c("y"), STEP)).withColumn("ix", grid.cell_of(c("x"), 0, STEP)).withColumn("iy", grid.cell_of(c("y"), 0, STEP))


def _cells(t):
    n = _in_cells(t).groupBy("city", "ix", "iy").agg(F.count("*").alias("n"))
    return n.withColumn("grid_id", (c("ix") * 14 + c("iy")).cast("bigint"))


@query(_P + ", b as (select city, min(x) as a, min(y) as b, max(x) as c, max(y) as d from p group by 1) select city, cast(ix as int) as ix, cast(iy as int) as iy, cast(ix * floor((d - b) / 150) + iy as bigint) as grid_id from b, range(0, 30) r(ix), range(0, 30) q(iy) where ix < floor((c - a) / 150) and iy < floor((d - b) / 150)")
def grid_generate(t):
    b = _points(t).groupBy("city").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    return grid.make_grid(b, STEP, ["city"])


@query(_P + "select id, cast(floor(x / 150) as int) as ix, cast(floor(y / 150) as int) as iy from p where x % 150 <> 0 and y % 150 <> 0")
def point_in_cell(t):
    return _in_cells(t).select("id", "ix", "iy")


@query(_P + """, a as (select city, cast(floor(x / 150) as int) as ix, cast(floor(y / 150) as int) as iy, sum(case when res then abs(v) else 0 end) as r, sum(abs(v)) as total, count(*) as n from p where x % 150 <> 0 and y % 150 <> 0 group by 1, 2, 3),
 m as (select city, sum(n) as all_n, avg(n) as mean_n from a group by 1)
 select a.city, ix, iy, n, round(r / nullif(total, 0), 6) as residential, case when r > total - r then 'residential' else 'other' end as majority, round(n / all_n, 9) as share, case when n > mean_n then 1 else 0 end as dense from a join m on a.city = m.city""")
def grid_majority_by_city(t):
    r = F.sum(F.when(c("res"), F.abs("v")).otherwise(0.0))
    cells = _in_cells(t).groupBy("city", "ix", "iy").agg(r.alias("r"), F.sum(F.abs("v")).alias("total"), F.count("*").alias("n"))
    by_city = cells.groupBy("city").agg(F.sum("n").alias("all_n"), F.avg("n").alias("mean_n"))
    joined = cells.join(F.broadcast(by_city), "city")  # one row per city
    majority = F.when(c("r") > c("total") - c("r"), "residential").otherwise("other")
    return joined.select("city", "ix", "iy", "n", F.round(F.try_divide("r", "total"), 6).alias("residential"), majority.alias("majority"), F.round(c("n") / c("all_n"), 9).alias("share"), F.when(c("n") > c("mean_n"), 1).otherwise(0).alias("dense"))


@query(_P + _CELLS + "select a.city, a.grid_id, b.grid_id as other_id from g a join g b on a.city = b.city and abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1 and (a.ix <> b.ix or a.iy <> b.iy)")
def grid_touches(t):
    return grid.touching(_cells(t).select("city", "ix", "iy", "grid_id"), ["city"])


@query(_P + _CELLS + "select a.city, a.grid_id, round(avg(b.n), 6) as around from g a left join g b on a.city = b.city and abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1 and (a.ix <> b.ix or a.iy <> b.iy) group by 1, 2")
def neighbor_mean(t):
    cells = _cells(t)
    near = grid.touching(cells.select("city", "ix", "iy", "grid_id"), ["city"])
    other = cells.select("city", c("grid_id").alias("other_id"), "n")
    mean = near.join(other, ["city", "other_id"]).groupBy("city", "grid_id").agg(F.round(F.avg("n"), 6).alias("around"))
    return cells.select("city", "grid_id").join(mean, ["city", "grid_id"], "left")


@query(_P + "select id, round(sqrt((x - 1500) ** 2 + (y - 1000) ** 2), 6) as dist from p")
def dist_to_anchor(t):
    return _points(t).select("id", F.round(F.sqrt((c("x") - 1500) ** 2 + (c("y") - 1000) ** 2), 6).alias("dist"))


def _segments(t):
    after = ((c("s_suppkey") + 17) * 3079) % 2003
    return t.supplier.select(c("s_suppkey").alias("seg"), ((c("s_suppkey") * 6151) % 3001).cast("double").alias("x1"), ((c("s_suppkey") * 3079) % 2003).cast("double").alias("y1"), (((c("s_suppkey") + 17) * 6151) % 3001).cast("double").alias("x2"), after.cast("double").alias("y2"))


_SEG = "seg as (select s_suppkey as seg, cast((s_suppkey * 6151) % 3001 as double) as x1, cast((s_suppkey * 3079) % 2003 as double) as y1, cast(((s_suppkey + 17) * 6151) % 3001 as double) as x2, cast(((s_suppkey + 17) * 3079) % 2003 as double) as y2 from supplier)"


@query("with " + _SEG + """, k as (select seg, cast(ix as int) as ix, cast(iy as int) as iy, x1, y1, x2 - x1 as dx, y2 - y1 as dy, ix * 150.0 as a, iy * 150.0 as b, ix * 150.0 + 150 as c, iy * 150.0 + 150 as d from seg, range(-1, 22) r(ix), range(-1, 16) q(iy)),
 w as (select *, [case when dx = 0 then case when x1 between a and c then 0.0 else 2.0 end else least((a - x1) / dx, (c - x1) / dx) end, case when dy = 0 then case when y1 between b and d then 0.0 else 2.0 end else least((b - y1) / dy, (d - y1) / dy) end, 0.0] as lo,
  [case when dx = 0 then 1.0 else greatest((a - x1) / dx, (c - x1) / dx) end, case when dy = 0 then 1.0 else greatest((b - y1) / dy, (d - y1) / dy) end, 1.0] as hi from k)
 select seg, ix, iy from w where list_max(lo) <= list_min(hi)""")
def segment_cell_intersect(t):
    return grid.segment_cells(_segments(t), STEP, ["seg"])


@query(_P + ", " + _SEG + """, g as (select distinct cast(floor(x / 150) as int) as ix, cast(floor(y / 150) as int) as iy from p), k as (select seg, g.ix, g.iy, x1, y1, x2 - x1 as dx, y2 - y1 as dy, g.ix * 150.0 as a, g.iy * 150.0 as b, g.ix * 150.0 + 150 as c, g.iy * 150.0 + 150 as d from g left join (select *, case when seg % 40 = 1 then 55 end as speed from seg) s on speed is not null),
 w as (select *, list_max([case when dx = 0 then case when x1 between a and c then 0.0 else 2.0 end else least((a - x1) / dx, (c - x1) / dx) end, case when dy = 0 then case when y1 between b and d then 0.0 else 2.0 end else least((b - y1) / dy, (d - y1) / dy) end, 0.0])
  <= list_min([case when dx = 0 then 1.0 else greatest((a - x1) / dx, (c - x1) / dx) end, case when dy = 0 then 1.0 else greatest((b - y1) / dy, (d - y1) / dy) end, 1.0]) as meets from k)
 select ix, iy, cast(coalesce(bool_or(meets), false) as int) as hwy from w group by 1, 2""")
def highway_cells(t):
    # most roads have no speed and count as none
    roads = _segments(t).withColumn("speed", F.when(c("seg") % 40 == 1, 55))
    cells = _points(t).select(grid.cell_of(c("x"), 0, STEP).alias("ix"), grid.cell_of(c("y"), 0, STEP).alias("iy")).distinct()
    return grid.crossed_cells(cells, roads, STEP, "speed", "hwy")


@query(_P + ", " + _SEG + """ select id, round(min(sqrt((x - x1 - u * (x2 - x1)) ** 2 + (y - y1 - u * (y2 - y1)) ** 2)), 6) as dist from (select *, least(1, greatest(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0))) as u from p, seg) group by 1""")
def min_point_segment_dist(t):
    ways = _segments(t).withColumnRenamed("seg", "other_id")
    touched = lambda df, step: grid.segment_cells(df, step, ["other_id", "x1", "y1", "x2", "y2"])
    d = grid.point_segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))
    return grid.nearest(_points(t).select("id", "x", "y"), ways, touched, d, float(STEP)).select("id", F.round("dist", 6).alias("dist"))


@query(_P + "select p.id, s.id as other_id, round(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), 6) as dist from p join s on (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 90000")
def pairs_within_radius(t):
    pairs = grid.within_radius(_points(t).select("id", "x", "y"), _sites(t), 300.0)
    return pairs.select("id", "other_id", F.round("dist", 6).alias("dist"))


@query(_P + "select p.id, round(sum(exp(-sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) / 100) * (s.id % 10)), 6) as access, round(sum(exp(-sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) / 100) * (s.id % 10)) / sum(exp(-sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) / 100)), 6) as mean from p join s on (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 250000 and p.id <> s.id group by 1")
def distance_decay_access(t):
    near = grid.within_radius(_points(t).select("id", "x", "y"), _sites(t), 500.0).where("id <> other_id")
    w, v = F.exp(-c("dist") / 100), c("other_id") % 10
    return near.groupBy("id").agg(F.round(F.sum(w * v), 6).alias("access"), F.round(F.sum(w * v) / F.sum(w), 6).alias("mean"))


@query(_P + "select p.id, round(coalesce(sum(exp(-sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) / 30) * (s.id % 10)), 0), 6) as access from p left join s on (p.x - s.x) ** 2 + (p.y - s.y) ** 2 <= 3600 and p.id <> s.id group by 1")
def distance_decay_or_zero(t):
    # a place without others in reach has access 0
    points = _points(t).select("id", "x", "y")
    near = grid.within_radius(points, _sites(t), 60.0).where("id <> other_id")
    sums = near.groupBy("id").agg(F.sum(F.exp(-c("dist") / 30) * (c("other_id") % 10)).alias("a"))
    return points.select("id").join(sums, "id", "left").select("id", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("access"))


@query(_P + "select id, other_id, round(sqrt(d2), 6) as dist from (select p.id, s.id as other_id, (p.x - s.x) ** 2 + (p.y - s.y) ** 2 as d2, row_number() over (partition by p.id order by (p.x - s.x) ** 2 + (p.y - s.y) ** 2, s.id) as n from p, s) where n = 1")
def nearest_neighbor(t):
    own = lambda df, step: df.withColumn("ix", grid.cell_of(c("ox"), 0.0, step)).withColumn("iy", grid.cell_of(c("oy"), 0.0, step))
    d = F.sqrt((c("x") - c("ox")) ** 2 + (c("y") - c("oy")) ** 2)
    return grid.nearest(_points(t).select("id", "x", "y"), _sites(t), own, d, float(STEP)).select("id", "other_id", F.round("dist", 6).alias("dist"))


@query(_P + "select city, cast(floor(x / 150) as int) as ix, cast(floor(y / 150) as int) as iy, max((v < 0)::int) as flooded from p group by 1, 2, 3")
def any_intersect_flag(t):
    at = _points(t).withColumn("ix", grid.cell_of(c("x"), 0, STEP)).withColumn("iy", grid.cell_of(c("y"), 0, STEP))
    return at.groupBy("city", "ix", "iy").agg(F.max((c("v") < 0).cast("int")).alias("flooded"))


_BOX = "select p_partkey as id, cast((p_partkey * 31) % 2000 as double) as x1, cast((p_partkey * 47) % 1500 as double) as y1, p_size * 10.0 as w from part"


@query("with b as (" + _BOX + """) select id, cast(ix as int) as ix, cast(iy as int) as iy, round(w, 4) as width, round((least(x1 + w, ix * 150 + 150) - greatest(x1, ix * 150)) * (least(y1 + w, iy * 150 + 150) - greatest(y1, iy * 150)), 4) as area
 from b, range(0, 20) r(ix), range(0, 20) q(iy) where least(x1 + w, ix * 150 + 150) > greatest(x1, ix * 150) and least(y1 + w, iy * 150 + 150) > greatest(y1, iy * 150)""")
def rect_overlay_area(t):
    b = t.part.select(c("p_partkey").alias("id"), ((c("p_partkey") * 31) % 2000).cast("double").alias("x1"), ((c("p_partkey") * 47) % 1500).cast("double").alias("y1"), (c("p_size") * 10.0).alias("w"))
    for axis, low in (("ix", "x1"), ("iy", "y1")):
        b = b.withColumn(axis, F.explode(F.sequence(F.floor(c(low) / STEP).cast("int"), F.floor((c(low) + c("w")) / STEP).cast("int"))))
    side = lambda low, k: F.least(c(low) + c("w"), c(k) * STEP + STEP) - F.greatest(c(low), c(k) * STEP)
    out = b.withColumn("sx", side("x1", "ix")).withColumn("sy", side("y1", "iy")).where("sx > 0 and sy > 0")
    return out.select("id", "ix", "iy", F.round("w", 4).alias("width"), F.round(c("sx") * c("sy"), 4).alias("area"))


@query(_P + "select id, round(radians(x / 100 - 100) * 6378137.0, 3) as mx, round(ln(tan(radians(y / 100 + 25) / 2 + pi() / 4)) * 6378137.0, 3) as my from p")
def web_mercator(t):
    x, y = grid.web_mercator(c("x") / 100 - 100, c("y") / 100 + 25)
    return _points(t).select("id", F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


def _shift_sql():
    (a, f, (dx, dy, dz)), (a2, f2, _) = geodesy.DATUMS["NAD27"], geodesy.DATUMS["WGS84"]
    e, b2, e2 = f * (2 - f), a2 * (1 - f2), f2 * (2 - f2)
    return f""", r as (select id, radians(x / 100 - 100) as lam, radians(y / 100 + 25) as phi from p), n as (select *, {a!r} / sqrt(1 - {e!r} * sin(phi) ** 2) as n from r),
 k as (select id, n * cos(phi) * cos(lam) + {dx!r} as x, n * cos(phi) * sin(lam) + {dy!r} as y, n * {1 - e!r} * sin(phi) + {dz!r} as z from n),
 t as (select *, sqrt(x * x + y * y) as flat, atan2(z * {a2!r}, sqrt(x * x + y * y) * {b2!r}) as theta from k)
 select id, round(degrees(atan2(y, x)), 8) as lon, round(degrees(atan2(z + {e2 / (1 - e2) * b2!r} * sin(theta) ** 3, flat - {e2 * a2!r} * cos(theta) ** 3)), 8) as lat from t"""


@query(_P + _shift_sql())
def datum_shift(t):
    # points on the old datum of North America, on that of satellites
    lon, lat = geodesy.shifted(c("x") / 100 - 100, c("y") / 100 + 25, "NAD27")
    return _points(t).select("id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query(_P + ", h as (select id, lag(x) over (order by id) / 100 as lon0, lag(y) over (order by id) / 100 as lat0, x / 100 as lon1, y / 100 as lat1, y / 100 as lon2, x / 100 as lat2 from p) select id, round(2 * 6371008.8 * asin(sqrt(sin(radians(lat1 - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat1)) * sin(radians(lon1 - lon0) / 2) ** 2)), 2) as first_m from h where lon0 is not null")
def haversine_tiebreak(t):
    now = sequence.row_before(_points(t).select("id", "x", "y"), "id", ["x", "y"]).where("before is not null")
    d = grid.haversine(c("before.x") / 100, c("before.y") / 100, c("x") / 100, c("y") / 100)
    return now.select("id", F.round(d, 2).alias("first_m"))


@query(_P + _CELLS + "select city, grid_id, count(*) as n from (select a.city, a.grid_id, b.grid_id as o from g a join g b on a.city = b.city and greatest(abs(a.ix - b.ix) - 1, 0) * 150 <= 150 and greatest(abs(a.iy - b.iy) - 1, 0) * 150 <= 150 and b.n >= 4 and greatest(abs(a.ix - b.ix) - 1, 0) ** 2 + greatest(abs(a.iy - b.iy) - 1, 0) ** 2 <= 1) group by 1, 2")
def buffer_widen(t):
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if max(abs(a) - 1, 0) ** 2 + max(abs(b) - 1, 0) ** 2 <= 1])
    roads = _cells(t).where("n >= 4").withColumn("o", F.explode(offsets)).select("city", (c("ix") + c("o.a")).alias("ix"), (c("iy") + c("o.b")).alias("iy"))
    return _cells(t).join(roads, ["city", "ix", "iy"]).groupBy("city", "grid_id").agg(F.count("*").alias("n"))


_R = "with r as (select event_id // 100 as i, event_id % 100 as j, value as z from events) "


def _raster(t):
    return t.events.select(F.expr("event_id div 100").alias("i"), (c("event_id") % 100).alias("j"), c("value").alias("z"))


@query(_R + "select i // 3 as zi, j // 3 as zj, round(avg(z), 6) as mean from r group by 1, 2")
def zonal_mean(t):
    return _raster(t).groupBy(F.expr("i div 3").alias("zi"), F.expr("j div 3").alias("zj")).agg(F.round(F.avg("z"), 6).alias("mean"))


@query(_R + "select i, j, round(sqrt(((e - w) / 2) ** 2 + ((s - n) / 2) ** 2), 5) as slope from (select i, j, lag(z) over (partition by i order by j) as w, lead(z) over (partition by i order by j) as e, lag(z) over (partition by j order by i) as n, lead(z) over (partition by j order by i) as s from r) where w is not null and e is not null and n is not null and s is not null")
def slope_gradient(t):
    row, col = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")
    g = _raster(t).withColumn("dx", (F.lead("z").over(row) - F.lag("z").over(row)) / 2).withColumn("dy", (F.lead("z").over(col) - F.lag("z").over(col)) / 2)
    return g.where("dx is not null and dy is not null").select("i", "j", F.round(F.sqrt(c("dx") ** 2 + c("dy") ** 2), 5).alias("slope"))


@query(_R + "select a.i, a.j, round(sum(b.z), 4) as total, count(*) as n from r a join r b on b.i between a.i - 1 and a.i + 1 and b.j between a.j - 1 and a.j + 1 group by 1, 2")
def focal_patch_sum(t):
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = _raster(t).withColumn("o", F.explode(offsets)).select((c("i") + c("o.a")).alias("i"), (c("j") + c("o.b")).alias("j"), "z")
    return spread.join(_raster(t).select("i", "j"), ["i", "j"]).groupBy("i", "j").agg(F.round(F.sum("z"), 4).alias("total"), F.count("*").alias("n"))


@query(_R + "select i, j, round(1 / (1 + exp(-avg(z / 100))), 6) as prob from (select a.i, a.j, b.z from r a join r b on b.i between a.i - 1 and a.i + 1 and b.j = a.j) group by 1, 2")
def focal_mean_logit(t):
    spread = _raster(t).withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select((c("i") + c("o")).alias("i"), "j", "z")
    return spread.join(_raster(t).select("i", "j"), ["i", "j"]).groupBy("i", "j").agg(F.round(1 / (1 + F.exp(-F.avg(c("z") / 100))), 6).alias("prob"))


@query(_P + "select cast(floor(x / 150) as int) as col, cast(floor(y / 150) as int) as row, max(id) as id from p group by 1, 2")
def rasterize(t):
    return _points(t).groupBy(grid.cell_of(c("x"), 0, STEP).alias("col"), grid.cell_of(c("y"), 0, STEP).alias("row")).agg(F.max("id").alias("id"))


@query(_P + "select id, case id % 4 when 0 then x when 1 then -y when 2 then -x else y end as rx, case id % 4 when 0 then y when 1 then x when 2 then -y else -x end as ry from p")
def inverse_rotate(t):
    k = c("id") % 4
    rx = F.when(k == 0, c("x")).when(k == 1, -c("y")).when(k == 2, -c("x")).otherwise(c("y"))
    ry = F.when(k == 0, c("y")).when(k == 1, c("x")).when(k == 2, -c("y")).otherwise(-c("x"))
    return _points(t).select("id", rx.alias("rx"), ry.alias("ry"))
