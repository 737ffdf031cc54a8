"""Best-fit packing of token sequences by a configuration linear program.

Lengths fall into at most ``capacity`` classes, however many documents there are, so the packing is
planned on the histogram of lengths: the configuration linear program is solved by multiplicative
weights, whose pricing problem is an unbounded knapsack solved by dynamic programming, to a gap of 5%
against the knapsack's bound (or 1,000 rounds), and the fractional solution is rounded to whole configurations; the same is done twice
more with what is left over. All else fills the room that these have and then, best-fit, configurations of its own. The plan has a bounded size. Pieces then find their places by their
rank among the pieces of equal length, which is counted in salted groups.

Defined results: null and empty texts are one piece holding the closing id alone; a row's null id
stays null; equal rows are packed one by one; an empty table gives an empty result; columns other
than the two named ones play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.byte_tokens import KEPT_CHUNKS
from tessella.llm.words import release, slices
from tessella.session import settle, ship

#: Rows that one task ranks; longer classes are dealt to several.
RANKED_TOGETHER = 20_000
#: Configurations that the linear program's solution is rounded to at most.
ROUNDED = 8_000
#: Programs solved, each but the first on what rounding left over of the one before it.
LEVELS = 3
#: Configurations of a program's solution that are held between rounds.
HELD = 32_000
_PACKED = np.dtype(">u4")
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, kept: int = KEPT_CHUNKS) -> DataFrame:
    """One row per piece: ids by the tokenizer file, then ``end_id``; only the first piece may be short. A worker remembers the ids of ``kept`` chunks."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.byte_tokens import opened

        coder = opened(tokenizer, kept)
        for batch in slices(batches, "text"):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                total = len(ids)
                short = total % capacity or capacity
                for k, end in enumerate(range(short, total + 1, capacity)):
                    begin = max(0, end - capacity) if k else 0
                    for column, value in zip(rows, (doc, k, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(pieces, _PIECES)


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``capacity``, the most that lengths s with value[s], any number of each, are worth; and one of them, or 0 if room - 1 is as good."""
    sizes = np.flatnonzero(value > 0)
    worth = value[sizes]
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            total = best[room - sizes[:n]] + worth[:n]
            k = int(total.argmax())
            if total[k] > best[room]:
                best[room], last[room] = total[k], sizes[k]
    return best, last


def filled(firsts: np.ndarray, last: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(configuration, length) rows of each of ``firsts`` with the most valuable lengths beside it, by ``last`` from ``knapsack``."""
    filled_at = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))
    rows, pieces = [np.arange(len(firsts))], [firsts]
    at, room = rows[0], filled_at[capacity - firsts]
    while (more := room > 0).any():
        at, room = at[more], room[more]
        rows.append(at)
        pieces.append(last[room])
        room = filled_at[room - last[room]]
    return np.concatenate(rows), np.concatenate(pieces)


def thinned(configs: list[bytes], times: np.ndarray, limit: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``limit`` configurations, in the order of their lengths, that stand for all: equal ones are added up, and of more one is
    taken at each whole step of the running sum, so every stretch of the order keeps its share."""
    order = sorted(range(len(configs)), key=configs.__getitem__, reverse=True)
    total = np.cumsum(times[order])
    first = [k for k, i in enumerate(order) if k == 0 or configs[i] != configs[order[k - 1]]]
    upto = total[np.array([*first[1:], len(order)]) - 1]
    distinct = [configs[order[k]] for k in first]
    if len(distinct) <= limit:
        return distinct, np.diff(upto, prepend=0.0)
    step = float(upto[-1]) / limit
    number = np.diff(np.floor(upto / step * (1 + 1e-12)), prepend=0)
    some = np.flatnonzero(number)
    return [distinct[k] for k in some.tolist()], number[some] * step


def solve(counts: np.ndarray, capacity: int, rounds: int, step: float, gap: float, near: float = 0.01) -> tuple[list[bytes], np.ndarray, float]:
    """Multiplicative weights on the configuration program: configurations with their fractional numbers, and the gap reached.

    A length's price is its weight over its count, at first its share of the volume. In each round every length's best configuration
    that is worth nearly as much (1 - ``near``) as the best of all is taken, as often as serves no length more than once;
    weights fall by exp(-step * share served). The rounds' mean is the solution; weights over the knapsack's best value bound the optimum from below. Rounds end where the mean is within ``gap`` of that bound.
    The numbers are scaled so that the lengths are served once, on average by volume. A configuration is its lengths, longest first, as
    numbers of equal width (``_PACKED``) that sort like them. Every 16 rounds the mean is thinned to ``HELD`` configurations, so what is
    held doesn't grow with the rounds.
    """
    sizes = np.flatnonzero(counts)
    need = counts.astype(float)
    weight = sizes * need[sizes]
    weight /= weight.max()
    configs: list[bytes] = []
    times = np.zeros(0)
    new: list[np.ndarray] = []
    served = np.zeros(capacity + 1)
    least, reached, total = 0.0, np.inf, 0.0
    for done in range(1, rounds + 1):
        value = np.zeros(capacity + 1)
        value[sizes] = weight / need[sizes]
        best, last = knapsack(value, capacity)
        least = max(least, weight.sum() / best[capacity])
        firsts = sizes[value[sizes] + best[capacity - sizes] >= (1 - near) * best[capacity]]
        rows, pieces = filled(firsts, last, capacity)
        wish = need[firsts]
        asked = np.bincount(pieces, weights=wish[rows], minlength=capacity + 1)
        allowed = np.full(len(firsts), np.inf)
        np.minimum.at(allowed, rows, need[pieces] / asked[pieces])
        much = wish * allowed
        got = np.bincount(pieces, weights=much[rows], minlength=capacity + 1)
        order = np.lexsort((-pieces, rows))
        flat, ends = pieces[order].astype(_PACKED).tobytes(), (_PACKED.itemsize * np.cumsum(np.bincount(rows, minlength=len(firsts)))).tolist()
        configs += [flat[begin:end] for begin, end in zip([0, *ends], ends)]
        new.append(much)
        total += float(much.sum())
        served += got
        weight *= np.exp(-step * got[sizes] / need[sizes])
        weight = np.maximum(weight / weight.max(), 1e-12)
        if done % 16 == 0 or done == rounds:
            configs, times = thinned(configs, np.concatenate([times, *new]), HELD)
            new = []
            reached = total / max(1e-12, (served[sizes] / need[sizes]).min()) / least - 1
            if reached <= gap:
                break
    scale = float((sizes * need[sizes]).sum() / (sizes * served[sizes]).sum())
    return configs, times * scale, reached


def rounded(configs: list[bytes], fractional: np.ndarray, left: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Whole numbers of configurations (in the order that ``thinned`` gives), at most ``ROUNDED`` of them, that take no more than is in ``left``, which they lower.

    Numbers are summed up in order of the configurations' lengths and one is taken at each whole step of the sum, so lengths
    keep their shares. The fullest come first where a length runs out.
    """
    each = max(1, math.ceil(float(fractional.sum()) / ROUNDED))
    steps = np.diff(np.floor(np.cumsum(fractional) / each), prepend=0).astype(np.int64) * each
    chosen = []
    picked = [(tuple(np.frombuffer(key, dtype=_PACKED).tolist()), times) for key, times in zip(configs, steps.tolist()) if times]
    for key, times in sorted(picked, key=lambda x: (-sum(x[0]), x[0])):
        config = Counter(key)
        times = min(times, *(int(left[s]) // n for s, n in config.items()))
        if times:
            for s, n in config.items():
                left[s] -= times * n
            chosen.append((times, dict(config)))
    return chosen


def filled_up(chosen: list[tuple[int, dict[int, int]]], left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The configurations with the longest lengths from ``left``, which is lowered, in the room that they have."""
    out = []
    stack = sorted(((t, c, capacity - sum(s * n for s, n in c.items())) for t, c in chosen), key=lambda x: -x[2])
    while stack:
        times, config, room = stack.pop()
        fits = np.flatnonzero(left[: room + 1])
        if not len(fits):
            out.append((times, config))
            continue
        s = int(fits[-1])
        n = min(times, int(left[s]))
        left[s] -= n
        if n < times:
            stack.append((times - n, config, room))
        stack.append((n, config | {s: config.get(s, 0) + 1}, room - s))
    return out


def planned(counts: np.ndarray, capacity: int, rounds: int = 1000, step: float = 0.05, gap: float = 0.05) -> tuple[list[tuple[int, dict[int, int]]], int, float]:
    """The linear program's plan with best-fit for what rounding leaves over, how many sequences are the program's, and its gap."""
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[int, dict[int, int]]] = []
    if left[capacity]:
        chosen.append((int(left[capacity]), {capacity: 1}))
        left[capacity] = 0
    if not left.any():
        return chosen, 0, 0.0
    all_: list[tuple[int, dict[int, int]]] = []
    reached = 0.0
    for level in range(LEVELS):
        if not left.any():
            break
        configs, fractional, gap_here = solve(left, capacity, rounds, step, gap)
        reached = gap_here if level == 0 else reached
        all_ += rounded(configs, fractional, left)
    whole = filled_up(all_, left, capacity)
    return chosen + whole + best_fit(left, capacity), sum(t for t, _ in whole), reached


def plan(counts: np.ndarray, capacity: int, rounds: int = 1000, step: float = 0.05) -> list[tuple[int, dict[int, int]]]:
    """Whole configurations and how often each is used; together they hold every length exactly ``counts`` times."""
    return planned(counts, capacity, rounds, step)[0]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Configurations filled with the longest length left that fits, each used as often as lengths last."""
    left, chosen = counts.astype(np.int64).copy(), []
    while left.any():
        config: dict[int, int] = {}
        room = capacity
        for s in np.flatnonzero(left)[::-1].tolist():
            if s <= room and (n := min(room // s, int(left[s]))):
                config[s] = n
                room -= s * n
        times = min(int(left[s]) // n for s, n in config.items())
        for s, n in config.items():
            left[s] -= times * n
        chosen.append((times, config))
    return chosen


def placement(chosen: list[tuple[int, dict[int, int]]]) -> list[tuple]:
    """For each configuration and length: the ranks it takes, its first sequence, its slots and their place."""
    rows, sequence, taken = [], 0, {}
    for times, config in chosen:
        offset = 0
        for s, n in sorted(config.items(), reverse=True):
            low = taken.get(s, 0)
            taken[s] = low + times * n
            rows.append((s, low, taken[s], sequence, n, offset))
            offset += s * n
        sequence += times
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept: int = KEPT_CHUNKS,
) -> DataFrame:
    """Pieces with their sequence and offset.

    The driver gets the histogram (``capacity`` counts at most) and makes the plan; the plan's table
    has a row for each length of its configurations, of which there are some ten thousand, and is broadcast.
    """
    spark = docs.sparkSession
    pieces = settle(cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, kept), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    salts = F.array(*[F.lit(int(n) // RANKED_TOGETHER + 1) for n in counts])
    salted = pieces.withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(salts, F.col("length").cast("int") + 1))
    )
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("own"))
    )
    release()
    rows = placement(plan(counts, capacity))
    release()
    places = spark.createDataFrame(
        rows or [(0, 0, 0, 0, 1, 0)], "p_length bigint, low bigint, high bigint, first bigint, slots bigint, place bigint"
    )
    inside = F.col("rank") - F.col("low")
    return (
        ranked.join(
            F.broadcast(places),
            (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
        )
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first") + F.floor(inside / F.col("slots"))).cast("bigint").alias("sequence_id"),
            (F.col("place") + F.pmod(inside, F.col("slots")) * F.col("length")).cast("bigint").alias("offset"),
        )
    )
