"""Compression of vectors to short codes: every part of a vector becomes the number of its nearest codebook entry.

Codebooks are found by Lloyd's rounds, which skip what can't have changed. A row keeps, for each of its parts, the entry and a key: the slack
between the distances to the second nearest entry (lower bound) and to its own (upper bound), plus the drift that its entry had gathered when that
was worked out. The drift that an entry gathers in a round is its own way and the longest way of any other entry. A task heaps the parts of an
Arrow batch by entry, least key first, and pops a heap as long as its head is not above the drift that the entry has gathered by now; only
popped parts are compared with all entries again, exactly. Parts that change entry are subtracted from one sum and added to the other;
the batches' changes are added up by Spark, so that entries and drifts alone (parts * entries * dimension / parts numbers) reach the driver.

Distances are whole numbers; bounds are doubles, shrunk by more than they can be off, so a skipped part could not even tie.

Defined results: the dimension is the most frequent one of those that can be cut into equal parts (ties: the greater); vectors of another one
take no part, nor do those that are null, or hold null, non-finite or too large components (see ``whole_vectors``). Rows that repeat are coded as
often as they are there. Codebooks start from the smallest ids (equal ones in the order of their vectors, null ids last); with fewer vectors than
entries, there are as many entries as vectors; entries may be equal, of which the later ones stay unused. An empty table gives an empty one. Error
sums beyond a long are returned as the greatest long. A missing label column counts as null. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from heapq import heapify, heappop

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.groups import bring_back, clamped
from tessella.llm.whole import squared_distances, whole_vectors
from tessella.session import discard, settle, ship

#: What bounds are shrunk by, relative to their size: far more than doubles are off.
SAFETY = 1e-9
STATE = "vec_id bigint, label string, v array<int>, at binary, keys array<double>, moved array<bigint>"


def rescan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties: the lower one) and its slack."""
    d = squared_distances(x, book)
    at = d.argmin(axis=1)
    if len(book) == 1:
        return at, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return at, two[:, 1] - two[:, 0] - SAFETY * (1 + two.sum(axis=1))


def violated(at: np.ndarray, keys: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Numbers of the parts whose bounds the drift of their entry has violated, popped from the entries' heaps."""
    heaps: list[list] = [[] for _ in drift]
    for i, (entry, key) in enumerate(zip(at.tolist(), keys.tolist())):
        heaps[entry].append((key, i))
    out = []
    for heap, limit in zip(heaps, drift.tolist()):
        heapify(heap)
        while heap and heap[0][0] <= limit:
            out.append(heappop(heap)[1])
    return np.array(out, dtype=np.int64)


def _changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> np.ndarray:
    """By entry: the number of parts and the sum of components that it gained, less what it lost."""
    values = np.column_stack([np.ones(len(x), dtype=np.int64), x])
    out = np.zeros((entries, values.shape[1]), dtype=np.int64)
    np.add.at(out, new, values)
    if old is not None:
        np.subtract.at(out, old, values)
    return out


def step(x: np.ndarray, at: np.ndarray | None, keys: np.ndarray | None, books: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and keys of a batch's parts, changes of sums, and the number of parts compared with all entries.

    ``x``: row, part, component; ``books``: part, entry, component; ``drift``: what each entry of each part's book has gathered.
    """
    n, parts, width = x.shape
    entries = books.shape[1]
    new_at, new_keys = (np.zeros((n, parts), dtype=np.uint8), np.zeros((n, parts))) if at is None else (at.copy(), keys.copy())
    changes, compared = np.zeros((parts, entries, width + 1), dtype=np.int64), 0
    for p in range(parts):
        some = np.arange(n) if at is None else violated(at[:, p], keys[:, p], drift[p])
        compared += len(some)
        if len(some):
            mine, slack = rescan(x[some, p], books[p])
            changes[p] = _changes(x[some, p], None if at is None else at[some, p], mine, entries)
            new_at[some, p], new_keys[some, p] = mine, slack + drift[p][mine]
    return new_at, new_keys, changes, compared


def _arrays(batch: pd.DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    x = np.stack(batch["v"].to_list()).astype(np.int64)
    x = x.reshape(len(x), parts, -1)
    if "at" not in batch:
        return x, None, None
    at = np.frombuffer(b"".join(batch["at"]), dtype=np.uint8).reshape(len(x), parts)
    return x, at, np.stack(batch["keys"].to_list())


def _assign(rows: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The rows with their entries and keys of this round; a batch's changes stand in its first row."""
    parts = books.shape[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, keys, changes, _ = step(*_arrays(batch, parts), books, drift)
                out = batch[["vec_id", "label", "v"]].assign(at=[a.tobytes() for a in at], keys=list(keys))
                yield out.assign(moved=[changes.ravel()] + [None] * (len(out) - 1))

    return rows.mapInPandas(run, STATE)


def _changed(state: DataFrame, size: int) -> list[int]:
    """All batches' changes, added up by task and then by Spark; ``size`` numbers, whatever the input."""

    def by_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=object)
        for batch in batches:
            for m in batch["moved"]:
                total = total + np.asarray(m, dtype=np.int64).astype(object)
        yield pd.DataFrame({"place": np.arange(size), "total": [Decimal(int(t)) for t in total]})

    summed = state.where("moved is not null").select("moved").mapInPandas(by_task, "place bigint, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    out = [0] * size
    for r in summed.collect():
        out[r["place"]] = int(r["total"])
    return out


def _gathered(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By part and entry: how far the entry and the one that went farthest of the others may have changed a part's slack."""
    way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=2)) * (1 + SAFETY)
    if way.shape[1] == 1:
        return way
    order = np.sort(way, axis=1)
    others = np.where(way == order[:, -1:], order[:, -2:-1], order[:, -1:])
    ties = (way == order[:, -1:]).sum(axis=1) > 1
    others[ties] = order[ties, -1:]
    return way + others


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code (a byte for each part), error, label_error) of every vector, and the codebooks (part, entry, component)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    size = F.size(F.col(f"`{vector_col}`"))
    common = vectors.select(size.alias("dim")).where((F.col("dim") > 0) & (F.col("dim") % parts == 0)).groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    none = spark.createDataFrame([], "vec_id bigint, label string, code binary, error bigint, label_error bigint")
    if common is None:
        return none, np.zeros((parts, 0, 0), dtype=np.int64)
    rows = whole_vectors(vectors, scale, common["dim"], id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return none, np.zeros((parts, 0, 0), dtype=np.int64)
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    shape = (parts, len(first), books.shape[2] + 1)
    drift, sums = np.zeros(shape[:2]), np.zeros(shape, dtype=object)
    state = settle(_assign(rows, books, drift), "code-state")
    for number in range(rounds):
        sums = sums + np.array(_changed(state, int(np.prod(shape))), dtype=object).reshape(shape)
        used = sums[:, :, 0] > 0
        new = books.copy()
        new[used] = (sums[used][:, 1:] // sums[used][:, :1]).astype(np.int64)
        drift, books = drift + _gathered(books, new), new
        if number < rounds - 1:
            before, state = state, settle(_assign(state.drop("moved"), books, drift), "code-state")
            discard(before)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, at, keys = _arrays(batch, parts)
                at = step(x, at, keys, books, drift)[0]
                own = books[np.arange(parts), at]
                error = ((x - own) ** 2).sum(axis=(1, 2))
                yield batch[["vec_id", "label"]].assign(code=[a.tobytes() for a in at], error=error)

    coded = settle(state.drop("moved").mapInPandas(final, "vec_id bigint, label string, code binary, error bigint"), "codes")
    discard(state)
    labels = settle(coded.groupBy("label").agg(clamped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count("*").alias("n")), "label-errors")
    total = labels.agg(F.sum("n")).first()[0]
    return bring_back(coded, labels, "label", "n", total).select("vec_id", "label", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """Lowercase sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
