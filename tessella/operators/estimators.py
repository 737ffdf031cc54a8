"""Linear, Poisson and logit fits from sums: one aggregation of X'WX and X'Wz per step, a small solve on the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import ship

#: Rows and draws whose weights a task holds at once.
ROWS_AT_ONCE, DRAWS_AT_ONCE = 4096, 64


def moments(df: DataFrame, x: list[str], y: str, weight=None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'WX, X'Wy, y'Wy and n, with an intercept before ``x``. (k + 1) * (k + 4) / 2 sums in one pass."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    w, out = (F.lit(1.0) if weight is None else weight), F.col(y).cast("double")
    k = len(cols)
    aggs = [F.sum(w * cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(w * cols[i] * out).alias(f"b{i}") for i in range(k)]
    row = df.agg(*aggs, F.sum(w * out * out).alias("yy"), F.count("*").alias("n")).first()
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[f"a{i}_{j}"] or 0.0
    return xx, np.array([row[f"b{i}"] or 0.0 for i in range(k)]), row["yy"] or 0.0, row["n"]


def normal_p(z: float) -> float:
    """Two-sided p-value."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def linear(x: list[str], beta) -> "F.Column":
    return sum((F.lit(float(b)) * F.col(c).cast("double") for c, b in zip(x, beta[1:])), F.lit(float(beta[0])))


def ols(df: DataFrame, x: list[str], y: str, cluster: str | None = None) -> DataFrame:
    """term, coef, se, p. With ``cluster`` the sandwich over cluster scores with the factor G/(G-1) * (n-1)/(n-k)."""
    df = df.dropna(subset=[*x, y])
    xx, xy, yy, n = moments(df, x, y)
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    inv, k = np.linalg.pinv(xx), len(beta)
    if cluster is None:
        cov = inv * max(0.0, yy - beta @ xy) / max(1, n - k)
    else:
        e = F.col(y).cast("double") - linear(x, beta)
        sums = df.groupBy(cluster).agg(F.sum(e).alias("s0"), *[F.sum(e * F.col(c)).alias(f"s{i}") for i, c in enumerate(x, 1)])
        # the scores' cross products are summed by Spark, so the number of clusters is unbounded
        cross = sums.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        meat = np.array([[cross[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
        g = cross["g"]
        cov = inv @ meat @ inv * (g / max(1, g - 1)) * ((n - 1) / max(1, n - k))
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    rows = [(t, float(b), float(s), normal_p(b / s) if s > 0 else None) for t, b, s in zip(["const", *x], beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, p double")


def glm(df: DataFrame, x: list[str], y: str, family: str, rounds: int = 50, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Poisson (log) or binomial (logit) by iterated weighted least squares; coefficients and (X'WX)^-1.

    Raises ValueError for an outcome whose mean no finite fit has, and ArithmeticError where ``rounds`` don't suffice.
    """
    df = df.dropna(subset=[*x, y])
    mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    if mean is None or mean <= 0 or (family == "binomial" and mean >= 1):
        raise ValueError(f"no {family} fit for an outcome of mean {mean}")
    beta = np.zeros(len(x) + 1)
    beta[0] = math.log(mean) if family == "poisson" else math.log(mean / (1 - mean))
    inv = np.eye(len(beta))
    for _ in range(rounds):
        eta = linear(x, beta)
        mu = F.exp(eta) if family == "poisson" else 1 / (1 + F.exp(-eta))
        w = mu if family == "poisson" else mu * (1 - mu)
        step = df.withColumn("_z", eta + (F.col(y).cast("double") - mu) / w)
        xx, xz, _, _ = moments(step, x, "_z", w)
        new = np.linalg.solve(xx, xz)
        inv = np.linalg.inv(xx)
        done = np.abs(new - beta).max() < tolerance
        beta = new
        if done:
            return beta, inv
    raise ArithmeticError(f"no convergence in {rounds} rounds")


def _poisson_table() -> np.ndarray:
    """Poisson(1) counts by 16 random bits."""
    p = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(12)])
    return np.searchsorted(p, (np.arange(1 << 16) + 0.5) / (1 << 16), side="left").astype(np.uint8)


def draw_weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson(1) counts of every draw (rows) and key (columns), from a mixed 64-bit hash of both; four draws share a hash."""
    table = _poisson_table()
    groups, group_of = np.unique(draws // 4, return_inverse=True)
    z = keys.view(np.uint64)[None, :] + (groups.astype(np.uint64)[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    shift = (16 * (draws % 4)).astype(np.uint64)
    return table[((z[group_of] >> shift[:, None]) & np.uint64(0xFFFF)).astype(np.intp)]


def bootstrap(df: DataFrame, x: list[str], y: str, key: str, draws: int) -> DataFrame:
    """draw, term, coef under Poisson(1) resampling by a hash of (key, draw): reproducible, and the same rows on any partitioning.

    Each task sums its rows for blocks of draws, so no row is copied and only k x k sums per draw and task are shuffled.
    """
    ship(df.sparkSession)
    k = len(x) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = [f"a{i}_{j}" for i, j in pairs] + [f"b{i}" for i in range(k)]
    clean = df.dropna(subset=[*x, y]).select(
        F.xxhash64(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x, 1)], F.col(y).cast("double").alias("y")
    )

    def add(batches):
        from tessella.operators import estimators as own

        totals, rows = np.zeros((draws, len(names))), 0
        for batch in batches:
            rows += batch.num_rows
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                keys, *rest = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                cols, out = [np.ones(len(keys)), *rest[:-1]], rest[-1]
                terms = np.stack([*[cols[i] * cols[j] for i, j in pairs], *[c * out for c in cols]], axis=1)
                for low in range(0, draws, DRAWS_AT_ONCE):
                    block = np.arange(low, min(draws, low + DRAWS_AT_ONCE))
                    totals[block] += own.draw_weights(keys, block).astype(float) @ terms
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws), pa.int32()), *map(pa.array, totals.T.copy())], ["draw", *names])

    added = clean.mapInArrow(add, ", ".join(["draw int", *[f"{n} double" for n in names]]))
    sums = added.groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])
    terms = ["const", *x]

    def solve(batches):
        for frame in batches:
            rows = []
            for row in frame.to_dict("records"):
                xx = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                beta = np.linalg.lstsq(xx, np.array([row[f"b{i}"] for i in range(k)]), rcond=None)[0]
                rows += [(int(row["draw"]), t, float(b)) for t, b in zip(terms, beta)]
            yield pd.DataFrame(rows, columns=["draw", "term", "coef"])

    return sums.mapInPandas(solve, "draw int, term string, coef double")
