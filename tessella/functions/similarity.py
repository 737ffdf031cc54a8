"""String similarities that Spark lacks, as Arrow-batched functions meant for distinct inputs.

The plain definitions are ``..._of``; batches go through array versions, which do one step of all pairs at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised by a common start of up to four letters where it is over 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(left, right)) // 2
    score = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if score > 0.7:
        start = 0
        while start < min(4, len(a), len(b)) and a[start] == b[start]:
            start += 1
        score += start * 0.1 * (1 - score)
    return score


def damerau_levenshtein_of(a: str, b: str) -> int:
    """Unrestricted distance: insertions, deletions, substitutions and swaps of neighbours with edits between them."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


#: Pairs that are compared at once, and the longest strings that are; longer ones go one by one.
TOGETHER, LONGEST = 4096, 64


def _letters(texts: list[str], width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, padded to ``width``, and lengths."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.full((len(texts), width), pad, dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out, size


def damerau_levenshtein_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Distances of pairs, by one table for all of them."""
    x, m = _letters(left, max(map(len, left), default=0), -1)
    y, n = _letters(right, max(map(len, right), default=0), -2)
    count, width, height = len(left), y.shape[1], x.shape[1]
    _, codes = np.unique(np.concatenate([x, y], axis=1), return_inverse=True)
    codes = codes.reshape(count, -1) if count else codes
    cx, cy = codes[:, :height], codes[:, height:]
    each = np.arange(count)
    last = np.zeros((count, int(codes.max(initial=0)) + 1), dtype=np.int64)
    far = (m + n)[:, None]
    table = np.zeros((height + 2, width + 2, count), dtype=np.int64)
    table[0] = far.T
    table[:, 0] = far.T
    table[1:, 1] = np.arange(height + 1)[:, None]
    table[1, 1:] = np.arange(width + 1)[:, None]
    for i in range(1, height + 1):
        match = np.zeros(count, dtype=np.int64)
        for j in range(1, width + 1):
            same = x[:, i - 1] == y[:, j - 1]
            k = last[each, cy[:, j - 1]]
            swap = table[k, match, each] + (i - k - 1) + 1 + (j - match - 1)
            table[i + 1, j + 1] = np.minimum(np.minimum(table[i, j] + ~same, swap), np.minimum(table[i + 1, j], table[i, j + 1]) + 1)
            match = np.where(same, j, match)
        last[each, cx[:, i - 1]] = i
    return table[m + 1, n + 1, each]


def jaro_winkler_batch(left: list[str], right: list[str]) -> np.ndarray:
    """Similarities of pairs; each letter of the left strings finds its match in all right ones at once."""
    x, m = _letters(left, max(1, max(map(len, left), default=0)), -1)
    y, n = _letters(right, max(1, max(map(len, right), default=0)), -2)
    each, count = np.arange(len(left)), len(left)
    reach = np.maximum(0, np.maximum(m, n) // 2 - 1)
    place = np.arange(y.shape[1])
    used = np.zeros(y.shape, dtype=bool)
    found = np.zeros(x.shape, dtype=bool)
    for i in range(x.shape[1]):
        fits = (x[:, i, None] == y) & ~used & (np.abs(place - i) <= reach[:, None])
        first = fits.argmax(axis=1)
        hit = fits[each, first]
        used[each[hit], first[hit]] = True
        found[:, i] = hit
    common = found.sum(axis=1)
    # the matched letters of both sides, in order
    line = np.arange(max(1, int(common.max(initial=0))))[None, :]
    ends = np.cumsum(common) - common
    at = np.minimum(ends[:, None] + line, max(0, int(common.sum()) - 1))
    real = line < common[:, None]
    a, b = x[found], y[used]
    wrong = (real & (a[at] != b[at])).sum(axis=1) // 2 if len(a) else np.zeros(count, dtype=np.int64)
    c = common.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(common > 0, (c / m + c / n + (c - wrong) / c) / 3, 0.0)
    begin = min(4, x.shape[1], y.shape[1])
    start = np.logical_and.accumulate(x[:, :begin] == y[:, :begin], axis=1).sum(axis=1)
    return np.where(score > 0.7, score + start * 0.1 * (1 - score), score)


def _in_batches(left: pd.Series, right: pd.Series, batch, single) -> np.ndarray:
    out = np.full(len(left), np.nan)
    there = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    a, b = left.to_numpy(dtype=object), right.to_numpy(dtype=object)
    size = np.array([max(len(a[i]), len(b[i])) for i in there], dtype=np.int64)
    for i in there[size > LONGEST]:
        out[i] = single(a[i], b[i])
    # pairs of like lengths share a table
    some = there[size <= LONGEST][np.argsort(size[size <= LONGEST], kind="stable")]
    for at in range(0, len(some), TOGETHER):
        part = some[at : at + TOGETHER]
        out[part] = batch(a[part].tolist(), b[part].tolist())
    return out


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_in_batches(a, b, jaro_winkler_batch, jaro_winkler_of))


@F.pandas_udf(DoubleType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - distance / longer length; two empty strings are alike."""
    distance = _in_batches(a, b, damerau_levenshtein_batch, damerau_levenshtein_of)
    longer = np.array([np.nan if x is None or y is None else max(len(x), len(y), 1) for x, y in zip(a.to_numpy(dtype=object), b.to_numpy(dtype=object))], dtype=float)
    return pd.Series(1.0 - distance / longer)
