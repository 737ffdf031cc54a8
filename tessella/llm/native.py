"""Small helpers for operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def opaque(value: Column) -> Column:
    """The same value, which the optimizer neither copies into a filter above it nor evaluates twice."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def sketch(df, value: Column, bits: int = 1 << 20):
    """A test that is true for every 64-bit ``value`` of ``df`` and false for most others.

    The sketch has ``bits`` bits, whatever the input; a full one lets all rows pass, so it saves work and never changes a result.
    It comes to the test by a scalar subquery: as a literal, some 200 KB of its numbers would stand in the text of every plan
    that uses it, of which the driver makes one with each stage and keeps many.
    """
    place = df.select(F.pmod(value, F.lit(bits)).alias("p"))
    words = place.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    masks = [0] * (bits // 64)
    for row in words.collect():
        masks[row["w"]] = row["m"]
    table = df.sparkSession.createDataFrame([(masks,)], "masks array<bigint>").coalesce(1).scalar()

    def may_hold(x: Column) -> Column:
        at = F.pmod(x, F.lit(bits))
        mask = F.get(table, F.floor(at / 64).cast("int"))
        return F.call_function("shiftright", mask, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return may_hold
