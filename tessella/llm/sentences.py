"""Removal of repeated passages by sliding sentence spans.

From every sentence on, the shortest run of consecutive sentences that holds ``span_words`` words and ``span_sentences`` sentences is
hashed, and so is the shortest such run that ends with it (128 bits; case and white space do not count). Runs are joined globally: of
equal runs the first, by document and place, stays, and every sentence that a later one covers is removed. The last sentences of a
text or of a passage, which begin no such run of their own, are covered by the runs that end with them. A sentence alone is no run,
however long, nor are few words: a passage of one sentence, a text of one, and one of fewer words than a run's stay where they repeat.
A line end ends a sentence. A blank sentence counts for none; it goes with the one before it, at a text's start with the one behind it.

Defined results: null and empty texts have no sentences; texts without a word keep theirs; a row's null id stays
null and comes first in order; rows equal in id and text count as one document and are cut alike; other columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import slices
from tessella.session import discard, settle, ship

_SENTENCE = regex.compile(r"(?:[^.!?\n]|[.!?]+(?=[^\s.!?]))*+(?:[.!?]+|\n|\Z)\s*")


def sentences(text: str) -> list[str]:
    """Sentences with the white space behind them; joined they are the text."""
    return [s for s in _SENTENCE.findall(text) if s]


def runs(parts: list[str], span_words: int, span_sentences: int = 2) -> list[tuple[int, int, bytes]]:
    """(first, end, 128-bit hash) of the runs."""
    plain = [" ".join(p.lower().split()) for p in parts]
    size = [p.count(" ") + 1 if p else 0 for p in plain]
    before = [0]
    for n in size:
        before.append(before[-1] + n)
    worded = [i for i, n in enumerate(size) if n]
    if not worded:
        return []
    # where a run that ends with a sentence ends: behind the blank sentences that follow it
    ends = dict(zip(worded, [*worded[1:], len(parts)]))
    words = lambda a, b: before[worded[b] + 1] - before[worded[a]]
    spans, many = set(), len(worded)
    b = 0
    for a in range(many):
        b = max(b, a + span_sentences - 1)
        while b < many and words(a, b) < span_words:
            b += 1
        if b >= many:
            break
        spans.add((worded[a], worded[b]))
    a = 0
    for b in range(span_sentences - 1, many):
        while a + span_sentences <= b and words(a + 1, b) >= span_words:
            a += 1
        if words(a, b) >= span_words:
            spans.add((worded[a], worded[b]))
    return [
        (
            0 if first == worded[0] else first,
            ends[end],
            xxhash.xxh3_128_digest(" ".join(p for p in plain[first : end + 1] if p).encode()),
        )
        for first, end in sorted(spans)
    ]


def _run_rows(texts: DataFrame, span_words: int, span_sentences: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm import sentences as own

        for batch in own.slices(batches, "text"):
            docs, first, end, digests = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for a, b, d in own.runs(own.sentences(text or ""), span_words, span_sentences):
                    docs.append(i)
                    first.append(a)
                    end.append(b)
                    digests.append(d)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("k1").take(at), pa.array(first, pa.int32()), pa.array(end, pa.int32()),
                    pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])),
                ],
                ["doc_id", "k1", "first", "end", "h1", "h2"],
            )

    return texts.mapInArrow(run, "doc_id bigint, k1 bigint, first int, end int, h1 bigint, h2 bigint")


def _cut(joined: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm import sentences as own

        for batch in own.slices(batches, "text"):
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                parts = own.sentences(text or "")
                gone = bytearray(len(parts))
                for span in spans or []:
                    gone[span["first"] : span["end"]] = b"\1" * (span["end"] - span["first"])
                rows.append((len(parts), sum(gone), "".join(p for p, g in zip(parts, gone) if not g)))
            kinds = (pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "n_sentences", "n_removed", "text"]
            )

    return joined.mapInArrow(run, "doc_id bigint, n_sentences bigint, n_removed bigint, text string")


def remove_repeated_sentences(
    docs: DataFrame, span_words: int = 20, id_col: str = "doc_id", text_col: str = "text", span_sentences: int = 2
) -> DataFrame:
    """Every text without the sentences that repeat a passage of ``span_sentences`` sentences or more seen before."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("k1"), text.alias("text"))
    rows = settle(_run_rows(texts, span_words, span_sentences), "runs")
    # both tables of a join are read from shuffles of their own, so a run that a large share of all texts hold is split
    often = settle(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "runs-often")
    again = settle(rows.join(often, ["h1", "h2"], "left_semi"), "runs-again")
    discard(rows, often)
    heads = settle(again.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "k1", "first")).alias("head")), "runs-heads")
    later = again.join(heads, ["h1", "h2"]).where(~F.struct("doc_id", "k1", "first").eqNullSafe(F.col("head")))
    spans = later.groupBy(F.col("doc_id").alias("s_id"), F.col("k1").alias("s1")).agg(
        F.collect_set(F.struct("first", "end")).alias("spans")
    )
    joined = texts.join(
        spans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("k1") == F.col("s1")), "left"
    )
    return _cut(joined.select("doc_id", "text", "spans"))
