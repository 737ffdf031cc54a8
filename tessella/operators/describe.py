"""Descriptive measures that need an order over all rows, without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.sequence import running


def ranked(df: DataFrame, value: str, tie: str) -> DataFrame:
    """``rank`` from 1 by (value, tie)."""
    return running(df, [], [value, tie], {}).withColumnRenamed("place", "rank")


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient of positive values, from each distinct value and how many rows hold it, which together take ranks in a row."""
    held = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = running(held, [], ["v"], {"high": F.col("n")})
    rank = F.col("n") * (F.col("high") - F.col("n")) + F.col("n") * (F.col("n") + 1) / 2
    r = upto.agg(F.sum(rank * F.col("v")).alias("rx"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum("n").alias("n"))
    return r.select(F.round((2 * F.col("rx") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s")), 8).alias("gini"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], parts: int = 256) -> list[float | None]:
    """Interpolated quantiles of a column, exactly, without an order over all rows; null where there is no value.

    Approximate edges cut the values into ``parts`` ranges, whose sizes tell in which range each wanted rank lies. Only in those
    ranges are values counted, each distinct one once, so a value that many rows hold is one row of the order.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    edges = rows.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)]).alias("e")).first()["e"]
    if edges is None:
        return [None] * len(shares)
    cut = sorted(set(edges))
    table = F.array(*[F.lit(float(e)) for e in cut])
    ranged = rows.withColumn("p", F.size(F.filter(table, lambda e: e < F.col("v"))))
    sizes = {r["p"]: r["n"] for r in ranged.groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most ``parts`` rows
    total = sum(sizes.values())
    places = [s * (total - 1) for s in shares]
    ranks = sorted({int(k) for x in places for k in (x // 1, -(-x // 1))})
    before, start, wanted = {}, 0, {}
    for p in sorted(sizes):
        before[p] = start
        for k in ranks:
            if start <= k < start + sizes[p]:
                wanted.setdefault(p, []).append(k)
        start += sizes[p]
    found: dict[int, float] = {}
    some = ranged.where(F.col("p").isin(list(wanted))).groupBy("p", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    counted = some.withColumn("high", upto).withColumn("low", F.col("high") - F.col("n"))
    hits = [(F.col("p") == p) & (F.col("low") <= k - before[p]) & (F.col("high") > k - before[p]) for p, ks in wanted.items() for k in ks]
    number = [k for ks in wanted.values() for k in ks]
    picked = counted.select("v", F.array_compact(F.array(*[F.when(h, F.lit(k)) for h, k in zip(hits, number)])).alias("k")).where(F.size("k") > 0)
    for r in picked.collect():  # a row for each rank at most
        found.update(dict.fromkeys(r["k"], r["v"]))
    out = []
    for x in places:
        low, high = int(x // 1), int(-(-x // 1))
        out.append(found[low] if low == high else (high - x) * found[low] + (x - low) * found[high])
    return out
