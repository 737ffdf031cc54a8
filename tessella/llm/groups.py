"""Totals of groups, brought back to their rows, and ranks of groups, where a group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import settle

#: A group with more than one in HOT of all rows is hot; there are fewer than HOT of them, so they can be broadcast whatever the input.
HOT = 1000


def clamped(value: Column) -> Column:
    """A decimal as the nearest long."""
    limit = F.lit(str(2**63 - 1)).cast("decimal(38,0)")
    return F.least(F.greatest(value, -limit), limit).cast("bigint")


def bring_back(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group; nulls of ``key`` are one group.

    ``groups`` has one row for each key, with the number of its rows in ``count``; ``total`` is that of all rows. Hot groups meet their
    rows where those are, the others by a shuffle in which no key has more than one in HOT of all rows.
    """
    groups = groups.withColumnRenamed(key, "_key")
    is_hot = F.col(count).cast("double") * HOT > float(total)
    same = F.col(key).eqNullSafe(F.col("_key"))
    hot, rest = F.broadcast(groups.where(is_hot)), groups.where(~is_hot)
    near = rows.join(hot, same)
    far = rows.join(hot.select("_key"), same, "left_anti").join(rest, same)
    return near.unionByName(far).drop("_key")


def placed(df: DataFrame, order: list, sums: dict[str, str], label: str) -> DataFrame:
    """``df`` in ``order`` with ``place`` (from 0) and a running sum, up to the row itself, of each of ``sums`` (new name: column).

    The order is dealt to ranges; what is before a range comes from the ranges' own sums, of which there are as many as shuffle partitions.
    Rows that tie may stand in any order among themselves.
    """
    at = F.monotonically_increasing_id()
    ranges = settle(df.orderBy(*order).withColumn("_at", at).withColumn("_range", F.expr("shiftright(_at, 33)")), label)
    wanted = {"place": F.lit(1)} | {new: F.col(old) for new, old in sums.items()}
    totals = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in wanted.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in wanted])
    own = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranges.select("*", *[F.sum(c).over(own).alias(n) for n, c in wanted.items()]).join(F.broadcast(before), "_range")
    done = {n: F.col(n) + F.col(f"_{n}") for n in wanted} | {"place": F.col("place") + F.col("_place") - 1}
    return summed.select(*df.columns, *[c.alias(n) for n, c in done.items()])
