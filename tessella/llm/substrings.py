"""Removal of long repeated byte strings, by sorting suffixes with hashes of their prefixes.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in the
corpus. Sorting the suffixes of the whole corpus would move every suffix, so only those are sorted that may have an equal:

1. Anchors. Each start of a string has an anchor: of the ``gram`` + 1 strings of ``gram`` bytes next behind it the one with the least
   hash. Strings that are equal have equal anchors at equal distances, so a start whose anchor occurs once is alone.
2. Contexts. The starts with one anchor follow each other. If all the bytes that their strings cover occur again around an equal
   anchor, all are repeated; this is where most of long repetitions ends.
3. Ranges. Where contexts of an anchor differ, distances to the anchor fall into ``CELLS`` ranges. What all strings begun in a range
   have in common must occur again, or none of them does; ranges where it doesn't are left out.
4. Suffixes. What is left is brought together by that common string, as bytes, and sorted by mergesort: two suffixes are
   compared by a binary search for their common extension on polynomial prefix hashes modulo 2**61 - 1 (``suffixes``). Neighbours
   that agree in ``length`` bytes are repeated; they are held against each other byte by byte. A range that more than
   ``TOGETHER`` contexts share is sorted in parts; what a part leaves open is compared between parts by hash.
5. Verification. Each repetition found by hashes alone (2., and between the parts of 4.) names a place where its bytes stand. These bytes
   are brought to the text and compared before they are cut. Should any differ, all is done again with another
   polynomial, so the result is exact: equal strings always have equal hashes, and what is cut was compared.

Only anchors, places and repeated bytes travel: groups are counted with map-side sums, so a passage that a third of
all documents hold costs one row per task until its places are known.

``n_shared`` counts the anchors of a text that occur elsewhere too. Every string of 2 * ``gram`` bytes holds an anchor, so it also shows
passages too short to be removed, of 280 bytes or more for certain and of 140 at least.

Where words count too (``words`` of ``remove_repeats``), all this is done for strings of ``WORD_BYTES`` bytes a word. Of the maximal runs of
bytes that they cover, those go that hold so many whole words, or ``length`` bytes; so every repetition of ``length`` bytes goes as well.

Defined results: null and empty texts have 0 bytes and nothing to remove; texts shorter than ``length`` are
left alone; rows equal in id and text are two texts, each a repetition of the other; a row's null id stays null;
other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.native import sketch
from tessella.llm.suffixes import PrefixHashes, repeated
from tessella.llm.words import mixed, slices
from tessella.session import discard, settle, ship

GRAM = 140
#: Bytes of a word, with the space behind it, in the shortest repetitions that are looked for where words count.
WORD_BYTES = 4
#: Ranges of distances to an anchor that are ruled out together; contexts sorted together.
CELLS, TOGETHER = 4, 2048
SLICE, PIECE = 1 << 19, 1 << 22
_ROLL = 0x9E3779B97F4A7C15
_KEY = "doc_id bigint, k1 bigint, "
_TABLES: list[np.ndarray] = []


def gram_of(length: int) -> int:
    return min(GRAM, length // 2)


def _rolling(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64: enough to choose anchors by, which need not be collision-free."""
    if not _TABLES or len(_TABLES[0]) < size:
        n = max(size, SLICE + 4096)
        _TABLES.clear()
        for step in (_ROLL, pow(_ROLL, -1, 2**64)):
            factors = np.full(n, step, dtype=np.uint64)
            factors[0] = 1
            _TABLES.append(np.cumprod(factors))
    return _TABLES[0], _TABLES[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes at 0, 1, ..."""
    if len(data) < gram:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _rolling(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each i with ``width`` values from there on: the first place of the least of them, by its upper 36 bits."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64((1 << 28) - 1)
    blocks = -(-len(values) // width)
    keyed = np.full(blocks * width, ~np.uint64(0), dtype=np.uint64)
    keyed[: len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    grid = keyed.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


def pieces(column: pa.Array, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts one after the other; where each begins and ends, where strings begin in it, its row and its place in its text.

    Texts over ``PIECE`` bytes are cut; each piece goes on for ``overlap`` bytes, so every string of one byte more begins in one piece only.
    """
    raw, row, base, own = [], [], [], []
    for i, text in enumerate(column.to_pylist()):
        data = (text or "").encode()
        for at in range(0, max(1, len(data) - overlap), PIECE):
            raw.append(data[at : at + PIECE + overlap])
            row.append(i)
            base.append(at)
            own.append(PIECE if at + PIECE < len(data) - overlap else len(data) - at)
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    end = np.cumsum(size)
    begin = end - size
    row, base, own = (np.array(x, dtype=np.int64) for x in (row, base, own))
    return np.frombuffer(b"".join(raw), dtype=np.uint8), begin, end, begin + own, row, base


def anchors(data: np.ndarray, end: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of starts before ``own`` in pieces that end at ``end``: piece, place, hash, least and greatest distance of their strings' starts.

    Anchors of places near an end, where no string of ``length`` bytes begins, have a least distance over the greatest.
    """
    gram = gram_of(length)
    hashes = gram_hashes(data, gram)
    least = least_places(hashes, gram + 1)
    start = np.arange(len(least))
    piece = np.searchsorted(end, start, side="right")
    inside = (start + 2 * gram <= end[piece]) & (start < own[piece])
    start, piece, least = start[inside], piece[inside], least[inside]
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none, none
    full = start + length <= end[piece]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])])
    first = np.flatnonzero(new)
    at, piece, begin = least[first], piece[first], start[first]
    n_full = np.add.reduceat(full.astype(np.int64), first)
    far = at - begin
    return piece, at, hashes[at], far - n_full + 1, far


def cell_bounds(length: int) -> list[tuple[int, int]]:
    """For each range: its least and greatest distance."""
    gram = gram_of(length)
    width = -(-(gram + 1) // CELLS)
    return [(low, min(low + width, gram + 1) - 1) for low in range(0, gram + 1, width)]


def _anchor_rows(texts: DataFrame, length: int, which: int) -> DataFrame:
    """Anchors with the hash ``c`` of their context, if they have one, and of what each range's strings have in common (q0, q1, ...).

    Contexts that a task meets again are marked ``twice``; one of each is ``shown`` to other tasks.
    """
    names = [f"q{i}" for i in range(len(cell_bounds(length)))]

    def marked(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(kept)
        a, c = (table.column(x).to_numpy() for x in ("a", "c"))
        order = np.lexsort((c, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])])
        group = np.cumsum(new) - 1
        shown, twice = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
        shown[order[new]] = True
        twice[order] = (np.bincount(group) > 1)[group]
        table = table.append_column("twice", pa.array(twice)).append_column("shown", pa.array(shown))
        yield from table.combine_chunks().to_batches(50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm import substrings as own

        kept: list[pa.RecordBatch] = []
        for batch in own.slices(batches, "text", own.SLICE):
            data, begin, end, limit, row, base = own.pieces(batch.column("text"), length - 1)
            piece, at, gram, near, far = own.anchors(data, end, limit, length)
            if not len(at):
                continue
            hashes = own.PrefixHashes(data, which)
            some = near <= far
            context = np.zeros(len(at), dtype=np.uint64)
            low, high = at[some] - far[some], at[some] - near[some] + length
            context[some] = own.mixed(hashes.of(low, high) + ((far[some] << 10) + near[some]).astype(np.uint64)) | np.uint64(1)
            cells = []
            for i, (least, most) in enumerate(own.cell_bounds(length)):
                here = (near <= most) & (far >= least) & some
                core = own.mixed(hashes.of(at[here] - least, at[here] + length - most) + np.uint64(i))
                values = np.zeros(len(at), dtype=np.int32)
                values[here] = (core >> np.uint64(32)).astype(np.uint32).view(np.int32)
                cells.append(pa.array(values, mask=~here))
            owner = pa.array(row[piece])
            kept.append(
                pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(owner), batch.column("k1").take(owner), pa.array((at - begin[piece] + base[piece]).astype(np.int32)),
                        pa.array(near.astype(np.int16)), pa.array(far.astype(np.int16)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), *cells,
                    ],
                    ["doc_id", "k1", "place", "near", "far", "a", "c", *names],
                )
            )
            if sum(b.num_rows for b in kept) > 300_000:
                yield from marked(kept)
                kept = []
        if kept:
            yield from marked(kept)

    schema = _KEY + "place int, near smallint, far smallint, a bigint, c bigint, "
    return texts.mapInArrow(run, schema + "".join(f"{n} int, " for n in names) + "twice boolean, shown boolean")


def _range_rows(located: DataFrame, length: int) -> DataFrame:
    """The bytes around each of a text's ``ranges``: the strings begun ``near`` to ``far`` bytes before an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out: dict[str, list] = {n: [] for n in ("doc_id", "k1", "g", "salt", "parts", "place", "near", "far", "bytes")}
            for doc, k1, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "text", "ranges"))):
                data = text.encode()
                for r in ranges:
                    for name, value in (("doc_id", doc), ("k1", k1), *((n, r[n]) for n in ("g", "salt", "parts", "place", "near", "far"))):
                        out[name].append(value)
                    out["bytes"].append(data[r["place"] - r["far"] : r["place"] - r["near"] + length])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return located.mapInArrow(run, _KEY + "g bigint, salt int, parts int, place int, near int, far int, bytes binary")


def _sorted_ranges(rows: DataFrame, length: int, which: int) -> DataFrame:
    """Runs of repeated strings among the ranges of a group: low and high (bytes they cover), and of groups in several parts
    each string that another part may hold, with its hash ``h``, distance and whether it was found (``low`` and ``high`` its own)."""

    def result(batch: pa.RecordBatch) -> pa.RecordBatch:
        from tessella.llm import substrings as own

        get = lambda c: batch.column(c).to_numpy().astype(np.int64)
        bytes_ = batch.column("bytes")
        sizes = np.fromiter((len(b) for b in bytes_.to_pylist()), dtype=np.int64, count=batch.num_rows)
        data = np.frombuffer(b"".join(bytes_.to_pylist()), dtype=np.uint8)
        near, far, place, parts = get("near"), get("far"), get("place"), get("parts")
        row, back, whole, found = own.repeated(data, np.concatenate([[0], np.cumsum(sizes)]), far, near, far, get("g"), length, which)
        at = place[row] - back
        # distances ascend within a row: found ones that follow each other are one run
        index = np.flatnonzero(found)
        new = np.concatenate([[True], (row[index][1:] != row[index][:-1]) | (back[index][1:] != back[index][:-1] + 1)]) if len(index) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(index)]])[: len(first)] - 1
        run_row, low, high = row[index[first]], at[index[last]], at[index[first]] + length
        split = np.flatnonzero(parts[row] > 1)
        if len(split):
            # of strings found equal in this part one stands for all
            g = get("g")[row[split]]
            order = np.lexsort((whole[split], back[split], g))
            s = split[order]
            again = np.concatenate([[False], (g[order][1:] == g[order][:-1]) & (back[s][1:] == back[s][:-1]) & (whole[s][1:] == whole[s][:-1])])
            split = s[~(again & found[s])]
        owner = pa.array(np.concatenate([run_row, row[split]]))
        n, m = len(first), len(split)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(owner), batch.column("k1").take(owner),
                pa.array(np.concatenate([low, at[split]]).astype(np.int32)), pa.array(np.concatenate([high, at[split] + length]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(n, np.int64), get("g")[row[split]]]), mask=np.arange(n + m) < n),
                pa.array(np.concatenate([np.zeros(n, np.int64), back[split]]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(n, np.int64), whole[split].view(np.int64)])),
                pa.array(np.concatenate([np.ones(n, bool), found[split]])),
            ],
            ["doc_id", "k1", "low", "high", "g", "back", "h", "found"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part: some parts are sorted at once, none is divided
        held: list[pa.RecordBatch] = []
        rows_held = 0
        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held < TOGETHER:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            g, salt = (table.column(c).to_numpy() for c in ("g", "salt"))
            ends = np.flatnonzero((g[1:] != g[:-1]) | (salt[1:] != salt[:-1])) + 1
            begin = 0
            while len(ends) and ends[-1] > begin:
                fitting = ends[(ends > begin) & (ends <= begin + TOGETHER)]
                end = int(fitting[-1]) if len(fitting) else int(ends[ends > begin][0])
                yield result(table.slice(begin, end - begin))
                begin = end
            rest = table.slice(begin)
            held, rows_held = [rest], rest.num_rows
        if rows_held:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield result(table)

    return rows.mapInArrow(run, _KEY + "low int, high int, g bigint, back int, h bigint, found boolean")


def _merged(claims: DataFrame) -> DataFrame:
    """Claims whose bytes meet or overlap, in one text and at one place of another, as one; and all places (lows) for which a text has the same claim."""
    claims = claims.withColumn("shift", F.col("w_low") - F.col("low"))
    own = Window.partitionBy("doc_id", "k1", "w_id", "w1", "shift").orderBy("low")
    before = F.max("high").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.coalesce(F.col("low") <= F.col("reach"), F.lit(False)), 0).otherwise(1)).over(own)
    numbered = claims.withColumn("reach", before).withColumn("island", island)
    spans = numbered.groupBy("doc_id", "k1", "w_id", "w1", "shift", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = spans.select("doc_id", "k1", "w_id", "w1", "low", (F.col("low") + F.col("shift")).alias("w_low"), (F.col("high") - F.col("low")).alias("size"))
    return spans.groupBy("doc_id", "k1", "w_id", "w1", "w_low", "size").agg(F.collect_set("low").alias("lows"))


def _quoted(texts: DataFrame, merged: DataFrame) -> DataFrame:
    """The bytes that each claim names."""
    wanted = merged.groupBy("w_id", "w1").agg(F.collect_set(F.struct("w_low", "size")).alias("places"))
    joined = texts.dropDuplicates(["doc_id", "k1"]).join(
        wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("k1") == F.col("w1"))
    ).select("doc_id", "k1", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = [
                (doc, k1, p["w_low"], p["size"], text.encode()[p["w_low"] : p["w_low"] + p["size"]])
                for doc, k1, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "text", "places")))
                for p in places
            ]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["w_id", "w1", "w_low", "size", "bytes"])

    return joined.mapInArrow(run, "w_id bigint, w1 bigint, w_low int, size int, bytes binary")


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that are in any of the spans."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def spans_of(starts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of ``length`` bytes at ``starts`` cover."""
    return united([(s, s + length) for s in starts])


def whole_words(data: bytes, low: int, high: int) -> int:
    """Words (bytes other than ASCII's white space) that lie in data[low:high] with both ends."""
    words = data[low:high].split()
    cut_first = low > 0 and bool(data[low - 1 : low].strip()) and bool(data[low : low + 1].strip())
    cut_last = high < len(data) and bool(data[high : high + 1].strip()) and bool(data[high - 1 : high].strip())
    return max(0, len(words) - cut_first - cut_last)


def _cut(joined: DataFrame, with_text: bool, carried: str | None = None, length: int = 0, words: int | None = None) -> DataFrame:
    """Texts without their ``spans``, with ``words`` only those of ``length`` bytes or ``words`` words; ``wrong`` counts the claims whose bytes aren't the text's."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared bigint, wrong bigint"
    schema += ", k1 bigint, kept string" if with_text else ""
    schema += f", carried {carried}" if carried else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.substrings import united as union
        from tessella.llm.substrings import whole_words as held

        for batch in slices(batches, "text", 1 << 20):
            rows, kept = [], []
            for text, spans, claims in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "claims"))):
                raw = (text or "").encode()
                wrong = sum(raw[low : low + len(c["bytes"])] != c["bytes"] for c in claims or [] for low in c["lows"])
                found = union([(s["low"], s["high"]) for s in spans or []])
                if words is not None:
                    found = [(low, high) for low, high in found if high - low >= length or held(raw, low, high) >= words]
                parts, at = [], 0
                for low, high in found:
                    parts.append(raw[at:low])
                    at = high
                left = b"".join([*parts, raw[at:]])
                rows.append((len(raw), len(raw) - len(left), len(found), hashlib.sha256(left).hexdigest(), wrong))
                if with_text:
                    kept.append(left.decode(errors="ignore"))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            more = [batch.column("k1"), pa.array(kept, pa.string())] if with_text else []
            more += [batch.column("carried")] if carried else []
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "wrong", *(["k1", "kept"] if with_text else []), *(["carried"] if carried else [])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns[:4], batch.column("n_shared"), columns[4], *more], names)

    return joined.mapInArrow(run, schema)


def found_spans(texts: DataFrame, length: int, which: int) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Spans of repeated bytes (low to high), claims of the bytes that stand for them elsewhere, each text's number of shared
    anchors, and the settled tables that the spans are read from."""
    rows = settle(_anchor_rows(texts, length, which), "anchors")
    often = rows.where("shown").groupBy("a").agg(F.count("*").alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("a")
    often = settle(often, "anchors-often")
    may = sketch(often, F.col("a"))
    again = settle(rows.where(may(F.col("a"))).join(often, "a", "left_semi").drop("twice", "shown"), "again")
    discard(rows, often)
    shared = settle(again.groupBy("doc_id", "k1").agg(F.count("*").alias("n_shared")), "shared")
    full = again.where("near <= far")
    cells = [f"q{i}" for i in range(len(cell_bounds(length)))]
    one = F.min(F.struct("doc_id", "k1", "place", "near", "far", *cells)).alias("one")
    contexts = settle(full.groupBy("a", "c").agg(F.count("*").alias("n"), one), "contexts")
    witness = contexts.where("n > 1").select("a", "c", F.col("one.doc_id").alias("w_id"), F.col("one.k1").alias("w1"), F.col("one.place").alias("w_place"))
    through = full.join(witness, ["a", "c"]).select(
        "doc_id", "k1", (F.col("place") - F.col("far")).alias("low"), (F.col("place") - F.col("near") + length).alias("high"),
        "w_id", "w1", (F.col("w_place") - F.col("far")).alias("w_low"),
    )
    through = settle(through, "through")
    groups = contexts.groupBy("a").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1")
    edges = contexts.join(groups.select("a"), "a", "left_semi").select("a", "one.*")
    ranges = [
        F.struct(F.greatest("near", F.lit(low)).cast("int").alias("near"), F.least("far", F.lit(high)).cast("int").alias("far"), F.xxhash64("a", F.lit(i), q).alias("g"), F.col(q).isNotNull().alias("there"))
        for i, (q, (low, high)) in enumerate(zip(cells, cell_bounds(length)))
    ]
    edges = settle(edges.select("doc_id", "k1", "place", F.inline(F.array(*ranges))).where("there"), "edges")
    discard(again, contexts)
    open_ = edges.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts"))
    dealt = edges.join(open_, "g").withColumn("salt", F.pmod(F.xxhash64("doc_id", "k1", "place"), F.col("parts")).cast("int"))
    by_text = dealt.groupBy(F.col("doc_id").alias("e_id"), F.col("k1").alias("e1")).agg(
        F.collect_set(F.struct("g", "salt", "parts", "place", "near", "far")).alias("ranges")
    )
    located = texts.join(by_text.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("k1") == F.col("e1")))
    located = _range_rows(located.select("doc_id", "k1", "text", "ranges"), length)
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = located.repartition(tasks, "g", "salt").sortWithinPartitions("g", "salt")
    suffixes = settle(_sorted_ranges(together, length, which), "suffixes")
    runs = suffixes.where("g is null").select("doc_id", "k1", "low", "high")
    # groups in several parts: strings that parts have in common
    parts = suffixes.where("g is not null")
    met = parts.groupBy("g", "back", "h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k1", "low")).alias("w")).where("n > 1")
    across = parts.where(~F.col("found")).join(met, ["g", "back", "h"]).select(
        "doc_id", "k1", "low", "high", F.col("w.doc_id").alias("w_id"), F.col("w.k1").alias("w1"), F.col("w.low").alias("w_low")
    )
    claims = through.unionByName(across)
    spans = claims.select("doc_id", "k1", "low", "high").unionByName(runs)
    elsewhere = ~(F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("k1") == F.col("w1")) & (F.col("low") == F.col("w_low")))
    claims = settle(_merged(claims.where(elsewhere)), "claims")
    return spans, claims, shared, [through, suffixes, edges]


def remove_repeats(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_shared: bool = False,
    carry: Column | None = None, words: int | None = None,
) -> DataFrame:
    """What is left of every text: sizes, number of removed runs and a digest; with ``with_text`` the text and its key k1, with
    ``with_shared`` n_shared. ``carry``, a column over ``docs``, comes along as ``carried``. With ``words``, shorter repetitions that hold
    so many words go too."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("k1"), text.alias("text")]
    texts = docs.select(*own)
    whole = texts if carry is None else docs.select(*own, carry.alias("carried"))
    carried = None if carry is None else whole.schema["carried"].dataType.simpleString()
    least = length if words is None else min(length, WORD_BYTES * words)
    which = 0
    while True:
        spans, claims, shared, used = found_spans(texts, least, which)
        quoted = settle(_quoted(texts, claims), "quoted")
        met = claims.join(
            quoted,
            claims["w_id"].eqNullSafe(quoted["w_id"]) & (claims["w1"] == quoted["w1"]) & (claims["w_low"] == quoted["w_low"]) & (claims["size"] == quoted["size"]),
        ).select("doc_id", "k1", "lows", "bytes")
        no_span, no_claim = F.lit(None).cast("struct<low:int,high:int>"), F.lit(None).cast("struct<lows:array<int>,bytes:binary>")
        fact = lambda df, span, claim, n: df.select("doc_id", "k1", span.alias("span"), claim.alias("claim"), n.cast("bigint").alias("n_shared"))
        facts = fact(spans, F.struct("low", "high"), no_claim, F.lit(0)).unionByName(fact(met, no_span, F.struct("lows", "bytes"), F.lit(0)))
        facts = facts.unionByName(fact(shared, no_span, no_claim, F.col("n_shared")))
        # null spans and claims are not collected
        by_text = facts.groupBy(F.col("doc_id").alias("s_id"), F.col("k1").alias("s1")).agg(
            F.collect_set("span").alias("spans"), F.collect_list("claim").alias("claims"), F.sum("n_shared").alias("n_shared")
        )
        joined = whole.join(
            by_text.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("k1") == F.col("s1")), "left"
        ).select("doc_id", "k1", "text", "spans", "claims", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"), *(["carried"] if carried else []))
        result = settle(_cut(joined, with_text, carried, length, words), "cut")
        discard(claims, quoted, shared, *used)
        wrong = result.agg(F.sum("wrong")).first()[0]
        if not wrong:
            return result.drop("wrong", *(() if with_shared else ("n_shared",)))
        discard(result)
        which += 1
