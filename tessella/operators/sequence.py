"""Operators on rows in a stated order: gap filling, propagation, sandwich and lag fills.

The loops that such cleaning is usually written as have closed forms over windows; each is one sort per partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import settle


def fill_nearest(df: DataFrame, value: str, number: str, by: list[str], order: str, gap: int) -> DataFrame:
    """Null ``value`` takes the nearest known one along a chain of rows whose numbers differ by ``gap`` at most; ties to the earlier."""
    w = Window.partitionBy(*by).orderBy(order)
    broken = F.coalesce((F.abs(F.col(number) - F.lag(number).over(w)) > gap) | F.col(number).isNull() | F.lag(number).over(w).isNull(), F.lit(True))
    df = df.withColumn("_s", F.sum(broken.cast("int")).over(w)).withColumn("_r", F.row_number().over(w))
    s = Window.partitionBy(*by, "_s").orderBy(order)
    back, ahead = s.rowsBetween(Window.unboundedPreceding, 0), s.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("_r"))
    before, after = F.last(at, True).over(back), F.first(at, True).over(ahead)
    df = df.withColumn("_b", before).withColumn("_a", after).withColumn("_bv", F.last(value, True).over(back)).withColumn("_av", F.first(value, True).over(ahead))
    nearer = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_r") - F.col("_b") <= F.col("_a") - F.col("_r")))
    return df.withColumn("filled", F.when(nearer, F.col("_bv")).otherwise(F.col("_av"))).drop("_s", "_r", "_b", "_a", "_bv", "_av")


def propagate(df: DataFrame, value: str, similar: Column, by: list[str], order: str, reach: int = 31) -> DataFrame:
    """Null ``value`` takes the last known one at most ``reach`` rows before it, over rows that are ``similar`` to their predecessor."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_s", F.sum(F.when(similar, 0).otherwise(1)).over(w))
    s = Window.partitionBy(*by, "_s").orderBy(order).rowsBetween(-reach, 0)
    return df.withColumn("carried", F.last(value, True).over(s)).drop("_s")


def sandwich(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """The rows whose null ``value`` lies between two equal ones, with that value as ``filled``."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w))
    return df.where(F.col(value).isNull() & (F.col("_p") == F.col("_n"))).withColumn("filled", F.col("_p")).drop("_p", "_n")


def fill_numbers(df: DataFrame, number: str, street: str, owner: Column, by: list[str], order: str) -> DataFrame:
    """``df`` with ``filled``: a null ``number`` takes that of the row before it if that one has the same street: tenants (all who aren't
    ``owner``) the same number, and then owners the number after next, tenants' new numbers included. Unknown streets are like none."""
    w = Window.partitionBy(*by).orderBy(order)
    same = F.coalesce(F.col(street) == F.lag(street).over(w), F.lit(False))
    own = F.coalesce(owner, F.lit(False))
    rows = df.withColumn("_x", F.when(F.col(number).isNull() & ~own & same, F.lag(number).over(w)).otherwise(F.col(number))).withColumn("_same", same).withColumn("_own", own)
    after = F.when(F.col("_x").isNull() & F.col("_own") & F.col("_same"), F.lag("_x").over(w) + 2).otherwise(F.col("_x"))
    return rows.withColumn("filled", after).drop("_x", "_same", "_own")


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def row_before(df: DataFrame, key: str, columns: list[str], width: int = 4096, levels: int = 3) -> DataFrame:
    """``df`` with ``before``, a struct of ``columns`` of the row with the next smaller ``key`` (whole numbers, no two alike), whatever the gaps; null for the first.

    Rows are ordered within ranges of ``width`` keys. A range's first row takes the last row of the range before it, found in the
    same way among the ranges; only the last level, one row for each width ** levels keys, is ordered in one task.
    """
    value = F.struct(*columns)
    if not levels:
        return df.withColumn("before", F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(key)))
    at = f"_range{levels}"
    ranged = df.withColumn(at, F.floor(F.col(key) / width).cast("bigint"))
    inside = ranged.withColumn("before", F.lag(value).over(Window.partitionBy(at).orderBy(key)))
    lasts = ranged.groupBy(at).agg(F.max_by(value, F.col(key)).alias("_last"))
    carried = row_before(lasts, at, ["_last"], width, levels - 1).select(at, F.col("before._last").alias("_carried"))
    return inside.join(carried, at).withColumn("before", F.coalesce("before", "_carried")).drop(at, "_carried")


def running(df: DataFrame, by: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``place``, its place from 1 in the ``order`` of its group, and a sum of each of ``sums`` up to the row itself.

    All rows are dealt to ranges of (by, order), and sums are made in the ranges and carried from range to range, of which there are as many
    as shuffle partitions; so no task holds a group, however many rows it has. Rows that tie in ``order`` may stand in any order among themselves.
    """
    wanted = {"place": F.lit(1)} | sums
    ordered = df.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.expr("shiftright(_at, 33)"))
    ordered = settle(ordered, "ranges")
    totals = ordered.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_{n}") for n, v in wanted.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    known = [F.col(b).alias(f"_by_{b}") for b in by]
    before = totals.select(*known, F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in wanted])
    own = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = ordered.select("*", *[F.sum(v).over(own).alias(n) for n, v in wanted.items()])
    return inside.join(before, same).select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in wanted])


def centred_mean(df: DataFrame, value: str, by: list[str], order: list[str], least: int = 50, part: int = 20, rows: int = 10) -> DataFrame:
    """``df`` with ``mean`` over a centred window of max(``least``, n // ``part``) rows, n being the group's; null with fewer than ``rows`` values.

    ``order`` should end with a column that tells rows apart; rows that tie in all of it may stand either way round. A window that differs by
    group is two lookups in running sums, so its width costs nothing; the sums are of what values differ by from their group's mean, which
    keeps digits.
    """
    sizes = settle(df.groupBy(*by).agg(F.count("*").alias("_n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("_m")), "group-sizes")
    # a row for each group; one of them may hold most rows, so it comes to them where they are
    same = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by]
    small = F.broadcast if sizes.limit(10_001).count() <= 10_000 else (lambda x: x)
    known = df.join(small(sizes.withColumnsRenamed({b: f"_g_{b}" for b in by})), same).drop(*[f"_g_{b}" for b in by])
    off = F.coalesce(F.col(value).cast("double") - F.col("_m"), F.lit(0.0))
    run = settle(running(known, by, order, {"_s": off, "_c": F.when(F.col(value).isNotNull(), 1).otherwise(0)}), "running-sums")
    width = F.greatest(F.lit(least), F.floor(F.col("_n") / part))
    out = run.withColumn("_low", F.col("place") - F.floor(width / 2) - 1).withColumn("_high", F.least(F.col("_n"), F.col("place") + F.floor((width - 1) / 2))).drop("_s", "_c")
    for at, s, n in (("_low", "_s0", "_c0"), ("_high", "_s1", "_c1")):
        found = run.select(*[F.col(b).alias(f"_g_{b}") for b in by], F.col("place").alias("_k"), F.col("_s").alias(s), F.col("_c").alias(n))
        out = out.join(found, [F.col(at) == F.col("_k"), *same], "left").drop("_k", *[f"_g_{b}" for b in by])
    count = F.col("_c1") - F.coalesce("_c0", F.lit(0))
    mean = F.when(count >= rows, F.col("_m") + (F.col("_s1") - F.coalesce("_s0", F.lit(0.0))) / count)
    return out.withColumn("mean", mean).select(*df.columns, "mean")
