"""Vectors as whole numbers, and exact distances between them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greatest_component(dim: int) -> int:
    """Up to this size of all components, no squared distance between vectors of ``dim`` components exceeds a long."""
    return min(2**31 - 1, math.isqrt((2**63 - 1) // (4 * dim)))


def whole_vectors(vectors: DataFrame, scale: int, dim: int, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """vec_id, v (floor(scale * x) of every component x) and, if asked for, the label as a string, of vectors of ``dim`` components.

    Vectors that are null, of another dimension, or hold null or non-finite components are left out; so are those with components beyond
    ``greatest_component`` when scaled, whose distances no long can hold.
    """
    v, limit = F.col(f"`{vector_col}`"), float(greatest_component(dim))
    scaled = lambda x: F.floor(x.cast("double") * float(scale))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & F.coalesce((F.abs(x.cast("double")) * float(scale)) <= limit - 1, F.lit(False)))
    label = [] if label_col is None else [(F.col(f"`{label_col}`") if label_col in vectors.columns else F.lit(None)).cast("string").alias("label")]
    chosen = vectors.where(v.isNotNull() & (F.size(v) == dim)).where(F.coalesce(fine, F.lit(False)))
    return chosen.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.transform(v, lambda x: scaled(x).cast("int")).alias("v"), *label)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``y``, exact: by floating point where all sums stay below 2**53."""
    most = int(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 2**53 else np.int64
    x, y = x.astype(kind), y.astype(kind)
    if kind is np.float64:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - y[:, j]) ** 2
    return out
