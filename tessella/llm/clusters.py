"""Lloyd's clustering of vectors by their distinct forms.

Equal vectors are grouped with their number, so that a vector costs its distances once, however often it is repeated. Every round assigns the
distinct vectors in Arrow batches, sums components times numbers as whole numbers inside each task, and adds the tasks' sums up by cluster;
only centroids reach the driver. In the end the assignments are joined back to the rows: vectors that hold more than a thousandth of all rows
by a broadcast, the others by a shuffle.

Defined results: vectors that are null, of another dimension, or hold null, non-finite or too large components (see ``whole_vectors``) take no
part. Rows that repeat count as often as they are there and are returned as often. A null id is clustered like others but starts no centroid
unless ids are short; with fewer vectors than centroids there are as many centroids as vectors; equal starting vectors are centroids of their own,
of which the later ones stay empty. Rows of equal id start in the order of their vectors. An empty table gives an empty one. Inertia beyond a long
is returned as the greatest long. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.groups import bring_back
from tessella.llm.whole import squared_distances, whole_vectors
from tessella.session import discard, settle, ship


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; ties go to the smaller number."""
    d = squared_distances(x, centroids)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at].astype(np.int64)


def weighted_sums(x: np.ndarray, n: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For each cluster the sum of n and of n * x, as Python's numbers."""
    wide = int(np.abs(x).max(initial=1)) * int(n.sum()) >= 2**62
    values = np.column_stack([np.ones(len(x), dtype=np.int64), x.astype(np.int64)])
    values = (values.astype(object) if wide else values) * n[:, None]
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    out = np.zeros((k, values.shape[1]), dtype=object)
    out[used] = np.add.reduceat(values[order], first, axis=0).astype(object)
    return out


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape[0], centroids.shape[1] + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, width), dtype=object)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_list()).astype(np.int64)
                total = total + weighted_sums(x, batch["n"].to_numpy(dtype=np.int64), nearest(x, centroids)[0], k)
        place = np.arange(k * width)
        yield pd.DataFrame({"cluster": (place // width).astype(np.int32), "place": (place % width).astype(np.int32), "total": [Decimal(int(t)) for t in total.ravel()]})

    # k rows of width sums, whatever the input
    found = distinct.select("v", "n").mapInPandas(sums, "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((k, width), dtype=object)
    for r in found:
        total[r["cluster"], r["place"]] = int(r["total"])
    out = centroids.copy()
    for c in range(k):
        if total[c, 0]:
            out[c] = [int(t) // int(total[c, 0]) for t in total[c, 1:]]
    return out


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance, cluster_inertia, inertia) of every vector, and the final centroids.

    Centroids start as the ``k`` vectors whose ids, behind ``salt``, have the smallest sha256.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale, dim, id_col, vector_col)
    distinct = settle(rows.groupBy("v").agg(F.count("*").alias("n")), "distinct-vectors")
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    start = rows.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], dtype=np.int64).reshape(-1, dim)
    if not len(start):
        empty = "vec_id bigint, v array<int>, cluster int, distance bigint, cluster_inertia bigint, inertia bigint"
        return spark.createDataFrame([], empty), centroids
    for _ in range(rounds):
        centroids = _moved(distinct, centroids)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, d = nearest(np.stack(batch["v"].to_list()).astype(np.int64), centroids)
                yield batch.assign(cluster=at.astype(np.int32), distance=d)

    coded = settle(distinct.select("v", "n").mapInPandas(assigned, "v array<int>, n bigint, cluster int, distance bigint"), "clustered-vectors")
    discard(distinct)
    product = F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")
    inertia = coded.groupBy("cluster").agg(F.sum(product.cast("decimal(38,0)")).alias("s"), F.sum("n").alias("rows")).collect()
    limit, whole = 2**63 - 1, sum(int(r["s"]) for r in inertia)
    table = [(r["cluster"], min(limit, int(r["s"])), min(limit, whole)) for r in inertia]
    sums = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint")  # at most k rows
    back = bring_back(rows, coded, "v", "n", sum(r["rows"] for r in inertia)).drop("n")
    return back.join(F.broadcast(sums), "cluster").select("vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def digests(centroids: np.ndarray) -> list[str]:
    """Lowercase sha256 of each centroid's components, joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
