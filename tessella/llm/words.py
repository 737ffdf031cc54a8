"""Words of a batch of texts, found once per distinct word.

A corpus holds far fewer distinct words than words. The helpers here cut a batch into words with
Arrow kernels, give each distinct word of the batch a number, and leave per-word work in Python to
the distinct ones. Batches are cut by bytes, so a batch of long texts uses no more memory than others.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> pa.Array:
    """Texts as large strings; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def release() -> None:
    """Give memory that is free but held back to the system; a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only some C libraries have it
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text stands alone. Memory is released behind the last one."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        total = np.cumsum(size)
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word's distinct form, and the distinct forms."""
    encoded = words.dictionary_encode()
    return np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... (lengths[0] of them), then those of starts[1], and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
