"""Line work in the plane: what other lines leave of lines, outlines of united shapes, and rings chained from pieces.

Segments (x1, y1, x2, y2) meet in the cells of a grid that both pass, so only neighbours are ever compared. Where segments cross, touch or
lie on each other they are cut; what is cut at one place gets the same corner on both, so pieces are told equal by their corners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import shapes
from tessella.operators.grid import dealt, segment_cells
from tessella.session import discard, settle, spread

_ENDS = ["x1", "y1", "x2", "y2"]


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def _along(x, y, tag: str = "") -> Column:
    """How far along a segment, as a share of it, a point lies that is projected on it."""
    x1, y1, x2, y2 = (F.col(n + tag) for n in _ENDS)
    dx, dy = x2 - x1, y2 - y1
    return ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)


def _off(x, y, tag: str = "") -> Column:
    """A point's distance from the line through a segment."""
    x1, y1, x2, y2 = (F.col(n + tag) for n in _ENDS)
    dx, dy = x2 - x1, y2 - y1
    return F.abs(_cross(dx, dy, x - x1, y - y1)) / F.sqrt(dx * dx + dy * dy)


def line_difference(new: DataFrame, old: DataFrame, step: float, tolerance: float = 0.0) -> DataFrame:
    """What ``old`` segments leave of ``new`` ones: ``new``'s columns with the ends of each piece that is left.

    A stretch goes where an old segment lies on it, that is, has both ends within ``tolerance`` of its line; crossings take nothing. Segments
    without length are left out, pieces shorter than the tolerance too.
    """
    keep = [n for n in new.columns if n not in _ENDS]
    long = lambda df: df.where("x1 <> x2 or y1 <> y2")
    rows = settle(long(new).withColumn("_id", F.monotonically_increasing_id()), "lines-new")
    there = segment_cells(rows.select("_id", *_ENDS), step, ["_id", *_ENDS])
    other = segment_cells(long(old).select(*_ENDS), step, _ENDS).withColumnsRenamed({n: n + "_o" for n in _ENDS})
    on = (_off(F.col("x1_o"), F.col("y1_o")) <= tolerance) & (_off(F.col("x2_o"), F.col("y2_o")) <= tolerance)
    a, b = _along(F.col("x1_o"), F.col("y1_o")), _along(F.col("x2_o"), F.col("y2_o"))
    met = there.join(other, ["ix", "iy"]).where(on)
    met = met.select("_id", F.greatest(F.lit(0.0), F.least(a, b)).alias("low"), F.least(F.lit(1.0), F.greatest(a, b)).alias("high")).where("low < high").distinct()
    w = Window.partitionBy("_id").orderBy("low", "high")
    reach = F.coalesce(F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gaps = met.select("_id", reach.alias("begin"), F.col("low").alias("end"))
    last = met.groupBy("_id").agg(F.max("high").alias("begin")).withColumn("end", F.lit(1.0))
    left = gaps.unionByName(last).where("begin < end")
    touched = rows.join(met.select("_id").distinct(), "_id", "left_anti").withColumn("begin", F.lit(0.0)).withColumn("end", F.lit(1.0))
    pieces = touched.unionByName(rows.join(left, "_id"))
    at = lambda p, q, t: F.when(t == 0.0, F.col(p)).when(t == 1.0, F.col(q)).otherwise(F.col(p) + t * (F.col(q) - F.col(p)))
    out = pieces.select(*keep, at("x1", "x2", F.col("begin")).alias("a"), at("y1", "y2", F.col("begin")).alias("b"), at("x1", "x2", F.col("end")).alias("c"), at("y1", "y2", F.col("end")).alias("d"))
    out = out.withColumnsRenamed(dict(zip("abcd", _ENDS)))
    return out.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > tolerance)


def noded(segments: DataFrame, by: list[str], step: float, tolerance: float) -> DataFrame:
    """``segments`` (``_id``, ``by`` and more) cut wherever another of their group crosses, touches or lies on them.

    Ends within ``tolerance`` of a segment cut it at that end; a crossing is worked out once for both, so their pieces share its corner.
    """
    cells = dealt(segment_cells(spread(segments), step, ["_id", *by, *_ENDS]), *by, "ix", "iy")
    other = cells.withColumnsRenamed({n: n + "_o" for n in ["_id", *_ENDS]})
    pairs = cells.join(other, [*by, "ix", "iy"]).where("_id < _id_o").drop("ix", "iy")  # pairs of several cells come again; cuts are told apart below
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corner = lambda k, tag: (F.col(f"x{k}{tag}"), F.col(f"y{k}{tag}"))

    def ends_on(tag: str, other: str) -> Column:
        """Ends of the segment ``other`` that lie on the segment ``tag``, between its own ends."""
        hits = [F.when((_off(x, y, tag) <= tolerance) & (_along(x, y, tag) > 0) & (_along(x, y, tag) < 1), place(x, y)) for x, y in (corner(1, other), corner(2, other))]
        return F.filter(F.array(*hits), lambda p: p.isNotNull())

    dx, dy, ex, ey = (F.col(q) - F.col(p) for p, q in (("x1", "x2"), ("y1", "y2"), ("x1_o", "x2_o"), ("y1_o", "y2_o")))
    whole = _cross(dx, dy, ex, ey)
    t = F.try_divide(_cross(F.col("x1_o") - F.col("x1"), F.col("y1_o") - F.col("y1"), ex, ey), whole)
    u = F.try_divide(_cross(F.col("x1_o") - F.col("x1"), F.col("y1_o") - F.col("y1"), dx, dy), whole)
    inner = (t > 0) & (t < 1) & (u > 0) & (u < 1)
    crossing = F.when(inner, F.array(place(F.col("x1") + t * dx, F.col("y1") + t * dy))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    found = pairs.select("*", ends_on("", "_o").alias("_a"), ends_on("_o", "").alias("_b"))
    # where an end lies on the other segment, that end is the place of the crossing
    both = F.when((F.size("_a") > 0) | (F.size("_b") > 0), F.array().cast("array<struct<x:double,y:double>>")).otherwise(crossing)
    found = found.select("_id", "_id_o", F.concat("_a", both).alias("_a"), F.concat("_b", both).alias("_b"))
    cuts = found.select("_id", F.explode("_a").alias("p")).unionByName(found.select(F.col("_id_o").alias("_id"), F.explode("_b").alias("p")))
    cuts = cuts.groupBy("_id").agg(F.collect_set("p").alias("cuts"))
    ordered = F.array_sort(F.transform("cuts", lambda p: F.struct(_along(p["x"], p["y"]).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
    path = F.concat(
        F.array(place(F.col("x1"), F.col("y1"))), F.coalesce(F.transform(ordered, lambda p: place(p["x"], p["y"])), F.array().cast("array<struct<x:double,y:double>>")),
        F.array(place(F.col("x2"), F.col("y2"))),
    )
    rest = [n for n in segments.columns if n not in _ENDS]
    walked = segments.join(cuts, "_id", "left").select(*rest, path.alias("path"))
    walked = walked.select(*rest, "path", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("k"))
    p, q = F.get("path", F.col("k")), F.get("path", F.col("k") + 1)
    pieces = walked.select(*rest, p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return pieces.where("x1 <> x2 or y1 <> y2")


def outline(polygons: DataFrame, by: list[str], step: float, tolerance: float = 1e-9) -> DataFrame:
    """(by..., x1, y1, x2, y2): the outline of each group's united shapes (column ``parts``) in pieces that have the union to their left.

    Sides are cut where sides of the group meet; a piece that shapes on both of its sides share is inside the union and goes, as does one whose
    middle lies inside another shape; of equal ones one stays. The union's area is the sum of (x1 * y2 - x2 * y1) / 2, its outline's length
    that of the pieces.
    """
    # equal shapes of a group, and equal sides of its shapes, are worked once: a union doesn't change with repeats
    rows = settle(polygons.select(*by, "parts").distinct().withColumn("_poly", F.monotonically_increasing_id()), "shapes-united")
    sides = shapes.boxed(rows, ["_poly", *by]).select("_poly", *by, F.explode("sides").alias("e")).where("e.s <> 0 and (e.x1 <> e.x2 or e.y1 <> e.y2)")
    end = lambda a, b: F.when(F.col("e.s") > 0, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}"))
    directed = sides.select("_poly", *by, end("x1", "x2").alias("x1"), end("y1", "y2").alias("y1"), end("x2", "x1").alias("x2"), end("y2", "y1").alias("y2"))
    directed = directed.groupBy(*by, *_ENDS).agg(F.collect_set("_poly").alias("_polys"))
    directed = settle(directed.withColumn("_id", F.monotonically_increasing_id()), "sides-united")
    pieces = noded(directed, by, step, tolerance)
    # each piece the same way round, with the shapes to its left and to its right
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    turned = pieces.select("_polys", *by, forward.alias("f"), *[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_ENDS, ("x2", "y2", "x1", "y1"))])
    shared = turned.groupBy(*by, *_ENDS).agg(F.bool_or("f").alias("left"), F.bool_or(~F.col("f")).alias("right"), F.array_distinct(F.flatten(F.collect_list("_polys"))).alias("owners"))
    bare = settle(shared.where("left <> right").withColumn("_piece", F.monotonically_increasing_id()), "pieces-united")
    middles = bare.select(*[F.col(b).alias(f"_{b}") for b in by], "_piece", "owners", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    held = shapes.points_in_shapes(middles, rows, ["_poly", *by], step, boundary=False)
    same = ~F.array_contains("owners", F.col("_poly"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    inner = held.where(same).select("_piece").distinct()
    free = bare.join(inner, "_piece", "left_anti")
    return free.select(*by, *[F.when(F.col("left"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_ENDS, ("x2", "y2", "x1", "y1"))])


def rings(pieces: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ring, hole, corners): pieces with the inside to their left chained to rings; a hole's corners run clockwise.

    A piece is followed by the one that begins where it ends, at corners where rings touch by the sharpest left turn. Rings are numbered and
    ordered by pointers that reach twice as far in each round.
    """
    rows = settle(pieces.select(*by, *_ENDS).withColumn("id", F.monotonically_increasing_id()), "pieces")
    begins = rows.select(*by, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("out"))
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    # of the pieces that go out, the first one clockwise from the way back
    turn = F.pmod(back - F.col("out") - F.lit(1e-12), F.lit(2 * 3.141592653589793))
    follow = rows.withColumn("back", back).join(begins, [*by, "x2", "y2"]).groupBy("id").agg(F.min_by("next", turn).alias("next"))
    state = settle(follow.select("id", "next", F.least("id", "next").alias("low")), "ring-numbers")
    while True:
        far = state.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("low").alias("seen"))
        after = settle(state.join(far, "next").select("id", F.col("beyond").alias("next"), F.least("low", "seen").alias("now"), "low"), "ring-numbers")
        changed = after.where("now <> low").limit(1).count()
        discard(state)
        state = after.select("id", "next", F.col("now").alias("low"))
        state.settled_at = after.settled_at
        if not changed:
            break
    numbers = state.select("id", F.col("low").alias("ring"))
    # steps to the ring's first piece, which nothing steps over
    ahead = follow.join(numbers, "id").select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).alias("steps"), "ring")
    ahead = settle(ahead, "ring-steps")
    while ahead.where("next is not null").limit(1).count():
        far = ahead.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("steps").alias("more"))
        after = settle(ahead.join(far, "next", "left").select("id", F.col("beyond").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "ring"), "ring-steps")
        discard(ahead)
        ahead = after
    corner = F.struct((-F.col("steps")).alias("o"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    whole = rows.join(ahead, "id").groupBy(*by, "ring").agg(F.array_sort(F.collect_list(corner)).alias("c"), F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("twice"))
    return whole.select(*by, "ring", (F.col("twice") < 0).alias("hole"), F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("corners"))
