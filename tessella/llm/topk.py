"""Exact top-k search by inner product with norm buckets.

Vectors are grouped by length into buckets whose lengths differ by a few hundredths; a bucket of many vectors is split.
A first pass over the longest vectors gives every query a lower bound of its k-th score. For a bucket, that
bound is a cosine threshold: bound / (length of the query * greatest length in the bucket). Over 1 the
bucket is left out; high thresholds prune by coordinates (a vector's coordinate must lie in the interval that the
threshold leaves around the query's largest coordinates); low ones prune by length. What is left is verified
by its integer product. Pruning is strict, so no vector that could tie is lost.

Queries meet buckets in blocks, so a task holds one block of queries and one bucket of vectors, whatever the table's size.

Defined results: vectors that are null, empty, or hold null or non-finite components (or such that can't be scaled within a double) take no
part, nor do rows without an id; vectors of unlike dimension are never compared. Rows are told apart by themselves and not by their ids:
a row equal to the query in id or in all is a candidate, and an id that is asked for in several rows is answered for each. A query without
candidates gives no row. Products beyond 64 bits are compared exactly and returned as the nearest long. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import settle, ship

#: Buckets to an octave of squared length, vectors of a bucket and queries of a block.
FINENESS, BUCKET_ROWS, BLOCK_ROWS = 16, 8192, 2048
#: Vectors that give the first bounds; cosine thresholds from which coordinates prune; coordinates looked at.
SEEDS, HIGH, FOCUS = 256, 0.5, 4
#: The highest bin: of vectors whose squared length may not be a double; none of them is ruled out by its length.
TOP_BIN = 1000 * FINENESS


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """row, id, whole components (as doubles), dimension and bucket (of the squared length) of the vectors that take part."""
    v = F.col(vector_col)
    product = lambda x: x.cast("double") * float(scale)
    # from 2**53 on doubles are whole numbers
    whole = F.transform(v, lambda x: F.when(F.abs(product(x)) < 2.0**53, F.floor(product(x)).cast("double")).otherwise(product(x)))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(product(x)) < float("inf")))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    short = F.when(F.col("norm2") > 0, F.floor(F.log2("norm2") * FINENESS)).otherwise(-1).cast("int")
    return (
        vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(F.coalesce(fine, F.lit(False)))
        .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("norm2", norm2)
        .withColumn("bin", F.when(F.col("norm2") < 2.0 ** (TOP_BIN // FINENESS - 1), F.greatest(F.lit(-1), short)).otherwise(TOP_BIN))
    )


def exact_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of whole numbers, by floating point where it is exact for certain; beyond 64 bits as Python's numbers."""
    if not len(queries) or not len(vectors):
        return np.zeros((len(queries), len(vectors)), dtype=np.int64)
    bound = np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1]
    if bound < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    if bound < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(queries) @ whole(vectors).T


def best_of(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, then rows."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i], rows[i]))[:k], dtype=np.int64)
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((rows[some], ids[some], -scores[some]))[:k]]


def search(q_rows: np.ndarray, q: np.ndarray, bound: np.ndarray, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple]:
    """(query's row, vector's row, id, score) of each query's k best in one bucket that may reach its bound (nan: no bound)."""
    out: list[tuple] = []
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        length = np.sqrt((v**2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        rows, ids, v, length = rows[order], ids[order], v[order], length[order]
        q_length = np.sqrt((q**2).sum(axis=1))
        useful = ~np.isnan(bound) & (bound > 0) & np.isfinite(q_length) & np.isfinite(length[0])
        cosine = np.where(useful, bound / (q_length * length[0]) * (1 - 1e-9), -1.0)
        shortest = np.where(useful, bound / q_length * (1 - 1e-9), 0.0)
    by_coordinates = np.flatnonzero((cosine >= HIGH) & (cosine <= 1))
    by_length = np.flatnonzero(cosine < HIGH)
    if len(by_coordinates):
        unit = v / np.maximum(length, 1e-300)[:, None]
        for i in by_coordinates:
            t, direction = cosine[i], q[i] / q_length[i]
            alive = length >= shortest[i]
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2))) + 1e-9
                alive &= (unit[:, f] >= direction[f] * t - spread) & (
                    (unit[:, f] <= direction[f] * t + spread) | (direction[f] >= t)
                ) if direction[f] >= 0 else (unit[:, f] <= direction[f] * t + spread) & (
                    (unit[:, f] >= direction[f] * t - spread) | (-direction[f] >= t)
                )
            some = np.flatnonzero(alive)
            out += _verified(q_rows[i], exact_products(q[i : i + 1], v[some])[0], rows[some], ids[some], bound[i], k)
    for at in range(0, len(by_length), 256):
        some = by_length[at : at + 256]
        reach = int(np.searchsorted(-length, -shortest[some].min(), side="right"))
        scores = exact_products(q[some], v[:reach])
        for n, i in enumerate(some):
            out += _verified(q_rows[i], scores[n], rows[:reach], ids[:reach], bound[i], k)
    return out


def _verified(query: int, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, bound: float, k: int) -> list[tuple]:
    fine = rows != query if np.isnan(bound) else (rows != query) & (scores >= bound * (1 - 1e-12) - 1e-12 if scores.dtype == object else scores >= bound)
    rows, ids, scores = rows[fine], ids[fine], scores[fine]
    return [(int(query), int(rows[j]), int(ids[j]), int(scores[j])) for j in best_of(ids, rows, scores, k)]


def far(excess: int) -> str:
    """How far a score lies beyond the longs, in letters that sort like it."""
    digits = str(abs(excess))
    if excess >= 0:
        return f"p{len(digits):06d}{digits}" if excess else "m"
    return "a" + f"{999_999 - len(digits):06d}" + "".join(str(9 - int(d)) for d in digits)


def _round(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Queries (with ``bound`` and the buckets they visit) against the buckets' vectors."""
    keys = ["dim", "bucket", "block"]
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in keys], F.col("row").alias("q_row"), F.col("v").alias("q"), "bound")
    vectors = vectors.select(*[F.col(c).alias(f"v_{c}") for c in keys], "row", "vec_id", "v")

    def together(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from tessella.llm.topk import far, search

        rows: list[tuple] = []
        if len(left) and len(right):
            q, v = np.stack(left["q"].to_list()), np.stack(right["v"].to_list())
            bound = left["bound"].to_numpy(dtype=float)
            rows = search(left["q_row"].to_numpy(), q, bound, right["row"].to_numpy(), right["vec_id"].to_numpy(), v, k)
        places = np.array([r[:3] for r in rows], dtype="int64").reshape(-1, 3)
        limit = 2**63 - 1
        long = [max(-limit - 1, min(limit, r[3])) for r in rows]
        beyond = [far(r[3] - s) for r, s in zip(rows, long)]
        return pd.DataFrame({"query": places[:, 0], "row": places[:, 1], "vec_id": places[:, 2], "score": np.array(long, dtype="int64"), "beyond": np.array(beyond, dtype=object)})

    return (
        queries.groupBy(*[f"q_{c}" for c in keys]).cogroup(vectors.groupBy(*[f"v_{c}" for c in keys]))
        .applyInPandas(together, "query bigint, row bigint, vec_id bigint, score bigint, beyond string")
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, query_filter: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best for each vector that ``query_filter`` (on vec_id) names."""
    spark = vectors.sparkSession
    ship(spark)
    rows = settle(scaled(vectors, id_col, vector_col, scale), "vectors")
    # a dimension has at most TOP_BIN + 2 bins, so this table is small whatever the input
    bins = sorted(((r["dim"], r["bin"], r["count"]) for r in rows.groupBy("dim", "bin").count().collect()), reverse=True)
    queries = rows.where(query_filter)
    asked = {r["dim"]: r["count"] for r in queries.groupBy("dim").count().collect()}
    table, seeds, used = [], [], {}
    for dim, number, n in bins:
        parts = -(-n // BUCKET_ROWS)
        longest = float("inf") if number == TOP_BIN else float(2.0 ** ((number + 1) / FINENESS / 2) if number >= 0 else 1.0)
        table.append((dim, number, parts, max(1, -(-asked.get(dim, 0) // BLOCK_ROWS)), longest))
        for part in range(parts):
            if used.get(dim, 0) >= SEEDS:
                break
            used[dim] = used.get(dim, 0) + n // parts
            seeds.append((dim, number * 1_000_000 + part))
    layout = spark.createDataFrame(table or [(-1, 0, 1, 1, 0.0)], "dim int, bin int, parts int, blocks int, longest double")
    is_seed = spark.createDataFrame(seeds or [(-1, 0)], "dim int, bucket bigint").withColumn("seed", F.lit(True))
    placed = rows.join(F.broadcast(layout), ["dim", "bin"]).withColumn(
        "bucket", F.col("bin").cast("bigint") * 1_000_000 + F.pmod(F.xxhash64("row"), F.col("parts"))
    )
    placed = placed.join(F.broadcast(is_seed), ["dim", "bucket"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    candidates = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = layout.groupBy("dim").agg(F.max("blocks").alias("blocks"))
    asking = queries.join(F.broadcast(blocks), "dim").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(7), "row"), F.col("blocks")).cast("int")
    ).select("dim", "row", "v", "norm2", "block")
    first = asking.withColumn("bound", F.lit(None).cast("double")).join(F.broadcast(is_seed.drop("seed")), "dim")
    seeded = settle(_round(first, candidates.where("seed"), k), "seeded")
    bounds = (
        _ranked(seeded, k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        .select(F.col("query").alias("row"), F.when(F.col("n") >= k, F.col("least")).cast("double").alias("bound"))
    )
    # a query meets the bins that its bound lets it reach, of which there is a bounded number, and visits their buckets
    reach = F.coalesce(F.col("bound") <= F.sqrt("norm2") * F.col("longest") * (1 + 1e-9), F.lit(True))
    second = asking.join(bounds, "row", "left").join(F.broadcast(layout.select("dim", "bin", "parts", "longest")), "dim").where(reach)
    second = second.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    second = second.withColumn("bucket", F.col("bin").cast("bigint") * 1_000_000 + F.col("part")).join(F.broadcast(is_seed.drop("seed")), ["dim", "bucket"], "left_anti")
    found = _ranked(seeded.unionByName(_round(second, candidates.where("not seed"), k)), k)
    ids = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(ids, "query").select("query_id", "rank", "vec_id", "score")
