"""Regular grids and the joins of points, segments, boxes and cells to them.

A cell is (ix, iy); a grid with ny cells to a column numbers them first + ix * ny + iy, column by column.
Every join here is an equi-join on cells followed by an exact test, so it is hash-partitioned and never a cross join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import settle
from tessella.session import spread as shared


def make_grid(bounds: DataFrame, step: float, by: list[str]) -> DataFrame:
    """Cells of boxes (minx, miny, maxx, maxy); a last strip narrower than ``step`` is left out."""
    nx = F.floor((F.col("maxx") - F.col("minx")) / step).cast("int")
    ny = F.floor((F.col("maxy") - F.col("miny")) / step).cast("int")
    sized = bounds.withColumn("nx", nx).withColumn("ny", ny).where("nx > 0 and ny > 0")
    cells = sized.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    cells = cells.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    return cells.select(*by, "ix", "iy", (F.col("ix") * F.col("ny") + F.col("iy")).cast("bigint").alias("grid_id"))


def cell_of(value: Column, start: float, step: float) -> Column:
    return F.floor((value - start) / step).cast("int")


def strictly_inside(x: Column, y: Column, step: float) -> Column:
    """Not on a cell's edge."""
    return (F.pmod(x, F.lit(step)) != 0) & (F.pmod(y, F.lit(step)) != 0)


def touching(cells: DataFrame, by: list[str]) -> DataFrame:
    """Each cell with the cells that share an edge or corner with it: an equi-join on shifted cells."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    shifted = cells.withColumn("o", F.explode(offsets)).select(
        *by, (F.col("ix") + F.col("o.a")).alias("ix"), (F.col("iy") + F.col("o.b")).alias("iy"), F.col("grid_id")
    )
    return shifted.join(cells.withColumnRenamed("grid_id", "other_id"), [*by, "ix", "iy"]).select(*by, "grid_id", "other_id")


def clip_parameter(p: Column, q: Column) -> tuple[Column, Column]:
    """Where along a segment the half plane p * t <= q begins and ends to hold, within [0, 1]."""
    t = F.try_divide(q, p)
    low = F.when(p < 0, t).when((p == 0) & (q < 0), 2.0).otherwise(0.0)
    high = F.when(p > 0, t).otherwise(1.0)
    return low, high


def segment_meets_box(x1, y1, x2, y2, minx, miny, maxx, maxy) -> Column:
    """Liang-Barsky: whether the segment has a point in the closed box."""
    dx, dy = x2 - x1, y2 - y1
    clips = [clip_parameter(p, q) for p, q in ((-dx, x1 - minx), (dx, maxx - x1), (-dy, y1 - miny), (dy, maxy - y1))]
    return F.greatest(F.lit(0.0), *[c[0] for c in clips]) <= F.least(F.lit(1.0), *[c[1] for c in clips])


def stepped(segments: DataFrame, step: float, width: float = 0.0) -> DataFrame:
    """``segments`` (x1, y1, x2, y2) with the cells (ix, iy) that may lie within ``width`` of each, edges included: as many as it is long.

    A segment is followed by columns of cells; in a column it takes the rows that it reaches there.
    """
    c = F.col
    low = lambda v: (F.ceil(v / step) - 1).cast("int")
    high = lambda v: F.floor(v / step).cast("int")
    wide = segments.withColumn("ix", F.explode(F.sequence(low(F.least("x1", "x2") - width), high(F.greatest("x1", "x2") + width))))
    dx, dy, room = c("x2") - c("x1"), c("y2") - c("y1"), width + 1e-9 * step
    # where along the segment the column, widened, begins and ends
    t = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(edge - c("x1"), dx), F.lit(other)))) for edge, other in ((c("ix") * step - room, 0.0), ((c("ix") + 1) * step + room, 1.0))]
    ys = [c("y1") + k * dy for k in t]
    return wide.withColumn("iy", F.explode(F.sequence(low(F.least(*ys) - room), high(F.greatest(*ys) + room))))


def segment_cells(segments: DataFrame, step: float, keep: list[str]) -> DataFrame:
    """(keep..., ix, iy) of the cells that each segment x1, y1, x2, y2 meets, edges included."""
    c = F.col
    box = (c("ix") * step, c("iy") * step, (c("ix") + 1) * step, (c("iy") + 1) * step)
    return stepped(segments, step).where(segment_meets_box(c("x1"), c("y1"), c("x2"), c("y2"), *box)).select(*keep, "ix", "iy")


def crossed_cells(cells: DataFrame, segments: DataFrame, step: float, attribute: str, flag: str) -> DataFrame:
    """``cells`` (ix, iy and more) with ``flag``: 1 where a segment whose ``attribute`` is known meets the cell, edges included, else 0.

    A segment that meets the cell but whose attribute is null counts as none.
    """
    met = segment_cells(segments.where(F.col(attribute).isNotNull()), step, []).distinct().withColumn(flag, F.lit(1))
    return cells.join(met, ["ix", "iy"], "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.sqrt((px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2)


#: Bins to a radius, so that few of the pairs that meet in a bin are farther apart.
BINS_TO_RADIUS = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by keys to several partitions a core, as many whatever its bytes: for joins whose pairs are far more than the rows."""
    return df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def within_radius(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (id, x, y) and (other_id, ox, oy) at most ``radius`` apart, self included if both sides hold it.

    The right side is dealt to the bins within reach of its own one, so each pair meets once, in the left point's bin. Bins are a part of the
    radius wide: what meets in them is little more than what is found, and they are many, so that no task holds much of it.
    """
    side = radius / BINS_TO_RADIUS
    bins = lambda v: F.floor(F.col(v) / side).cast("int")
    reach = range(-BINS_TO_RADIUS - 1, BINS_TO_RADIUS + 2)  # one more, as quotients are rounded
    gap = lambda o: max(abs(o) - 1, 0)
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in reach for b in reach if gap(a) ** 2 + gap(b) ** 2 <= BINS_TO_RADIUS**2])
    spread = right.withColumn("o", F.explode(offsets)).withColumn("bx", bins("ox") + F.col("o.a")).withColumn("by", bins("oy") + F.col("o.b")).drop("o")
    d2 = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
    own = left.withColumn("bx", bins("x")).withColumn("by", bins("y"))
    joined = dealt(own, "bx", "by").join(dealt(spread, "bx", "by").hint("merge"), ["bx", "by"])
    return joined.where(d2 <= radius * radius).withColumn("dist", F.sqrt(d2)).drop("bx", "by")


def _first_step(points: DataFrame, sites: DataFrame, cells: Callable[[DataFrame, float], DataFrame], step: float) -> tuple[float, float]:
    """The step to begin with, ``step`` at most, and the largest coordinate.

    A step at which a cell holds about one point leaves as many pairs as the sites have cells; where sites are sparser, one at which a cell holds about one
    of them. So neither grows with the square of the rows.
    """
    box = points.agg(F.count("*").alias("n"), *[f(v).alias(f"{k}{v}") for v in ("x", "y") for k, f in (("low", F.min), ("high", F.max))]).first()
    if not box["n"]:
        return step, 0.0
    reach = max(abs(box[f"{k}{v}"] or 0.0) for v in ("x", "y") for k in ("low", "high"))
    area = ((box["highx"] or 0.0) - (box["lowx"] or 0.0)) * ((box["highy"] or 0.0) - (box["lowy"] or 0.0))
    begin = (area / box["n"]) ** 0.5
    if not 0 < begin < step:
        return step, reach
    while begin < step and cells(sites, begin).count() * begin * begin < area:
        begin *= 2
    return min(begin, step), reach


def nearest(points: DataFrame, sites: DataFrame, cells: Callable[[DataFrame, float], DataFrame], distance: Column, step: float) -> DataFrame:
    """id, other_id and dist of the site nearest to each point, however far; ties to the smaller other_id.

    ``cells`` gives a site a row (ix, iy) for each cell it touches on a grid of some step. A point meets the sites of its own and the
    eight cells around it; what is found within one step is the nearest there is. Points that found none meet the next grid, twice as
    wide, so each pass deals with cells that hold few sites, and the number of passes is the logarithm of the largest distance. The first grid is
    as fine as the rows are dense, its cells at most ``step`` wide.
    """
    extent = sites.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c, t in sites.dtypes if t == "double"])).alias("m")).first()["m"]
    if extent is None:
        return points.select("id", F.lit(None).cast(sites.schema["other_id"].dataType).alias("other_id"), F.lit(None).cast("double").alias("dist")).limit(0)
    sites = shared(sites)
    step, far = _first_step(points, sites, cells, step)
    reach = max(extent, far)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left, found = points, []
    while True:
        # points go to the nine cells, not sites: a site may touch many cells
        asked = left.withColumn("o", F.explode(around))
        asked = asked.withColumn("ix", cell_of(F.col("x"), 0.0, step) + F.col("o.a")).withColumn("iy", cell_of(F.col("y"), 0.0, step) + F.col("o.b")).drop("o")
        met = dealt(asked, "ix", "iy").join(dealt(cells(sites, step), "ix", "iy").hint("merge"), ["ix", "iy"])
        best = met.withColumn("dist", distance).groupBy("id").agg(F.min(F.struct("dist", "other_id")).alias("b"))
        last = step > 2 * reach  # one cell and those around it hold everything
        done = settle(best.select("id", "b.other_id", "b.dist").where(F.lit(last) | (F.col("dist") <= step)), "nearest")
        found.append(done)
        left = settle(left.join(done.select("id"), "id", "left_anti"), "points-left")
        if last or not left.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        step *= 2


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to 3857 on the sphere of 6378137 m."""
    r = 6378137.0
    return F.radians(lon) * r, F.ln(F.tan(F.radians(lat) / 2 + F.lit(3.141592653589793 / 4))) * r


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * F.asin(F.sqrt(a))
