"""Token ids of whole texts by a ``tokenizers`` file, looked up once per distinct blank-separated chunk.

The byte-level pattern of such a file never joins what stands before a blank to what follows it,
unless white space meets the blank from both sides. So a text is cut before every blank, each
distinct chunk goes through ``tokenizers`` once per worker, and the ids are joined. Texts in
which the cut could matter (white space on both sides of a blank, a blank at the end after white space, or a special
token's text) are given to ``tokenizers`` whole. For the same reason unknown chunks that begin with a blank and don't end in white space
are encoded as one text; their ids part where a token begins with a blank, of which each chunk has one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.llm.words import coded, ragged, texts

#: Chunks and ids a worker remembers; beyond, it forgets all and goes on. This bounds memory only.
KEPT_CHUNKS, KEPT_IDS = 700_000, 4_000_000
_UNSAFE = re.compile(r"\s (?:\s|$)|<\|")
_OPEN: dict[str, "ByteTokens"] = {}


def opened(path: str, kept: int = KEPT_CHUNKS) -> "ByteTokens":
    """The tokenizer at ``path``, one per worker process, remembering ``kept`` chunks at most."""
    if path not in _OPEN:
        _OPEN[path] = ByteTokens(path)
    _OPEN[path].kept = kept
    return _OPEN[path]


class ByteTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kept = KEPT_CHUNKS
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        # byte-level vocabularies write a blank as this letter
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _whole(self, several: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(several, add_special_tokens=False)]

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and how many each has."""
        joined = np.fromiter((c[:1] == " " and not c[-1].isspace() for c in chunks), dtype=bool, count=len(chunks))
        apart = np.flatnonzero(~joined)
        ids = self.tokenizer.encode_batch_fast(["".join(c for c, j in zip(chunks, joined.tolist()) if j)], add_special_tokens=False)[0].ids
        flat = np.array(ids, dtype=np.uint32)
        begin = np.flatnonzero(self.opens[flat])
        if len(begin) + len(apart) != len(chunks) or (len(flat) and not self.opens[flat[0]]):
            # a vocabulary whose tokens don't part at blanks
            apart, flat, begin = np.arange(len(chunks)), flat[:0], begin[:0]
        found = self._whole([chunks[i] for i in apart])
        size = np.zeros(len(chunks), dtype=np.int64)
        size[apart] = [len(x) for x in found]
        together = np.ones(len(chunks), dtype=bool)
        together[apart] = False
        size[together] = np.diff(np.append(begin, len(flat)))
        out = np.zeros(int(size.sum()), dtype=np.uint32)
        own = np.repeat(together, size)
        out[own] = flat
        out[~own] = [i for x in found for i in x]
        return out, size

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The place of each chunk, all unlike, in what is remembered; unknown ones are encoded."""
        known = self.number
        place = np.array(list(map(known.get, chunks, repeat(-1))), dtype=np.int64)
        unknown = np.flatnonzero(place < 0)
        if len(unknown) and (len(known) + len(unknown) > self.kept or self.used > KEPT_IDS) and known:
            self._forget()
            known = self.number
            unknown = np.arange(len(chunks))
        new = [chunks[i] for i in unknown.tolist()]
        place[unknown] = len(known) + np.arange(len(new))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            flat, size = self._encoded(part)
            first = len(known)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while first + len(part) > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.start[first : first + len(part)] = self.used + np.cumsum(size) - size
            self.length[first : first + len(part)] = size
            self.used += len(flat)
            known.update(zip(part, range(first, first + len(part))))
        return place

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order; null counts as empty."""
        column = texts(column)
        plain = column.to_pylist()
        whole = {i: t for i, t in enumerate(plain) if _UNSAFE.search(t)}
        if whole:
            column = pa.array(["" if i in whole else t for i, t in enumerate(plain)], type=pa.large_string())
        parts = pc.split_pattern(column, " ")
        bounds = np.asarray(parts.offsets, dtype=np.int64)
        index, words = coded(parts.flatten())
        bounds = bounds - bounds[0]
        # all but a text's first chunk begin with the blank before them
        first = np.zeros(len(index), dtype=bool)
        first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        spelled = words.to_pylist()
        openers, later = (np.flatnonzero(np.bincount(x, minlength=len(spelled))) for x in (index[first], index[~first]))
        place = self._numbers([spelled[i] for i in openers.tolist()] + [" " + spelled[i] for i in later.tolist()])
        as_first, as_later = np.zeros(len(spelled), dtype=np.int64), np.zeros(len(spelled), dtype=np.int64)
        as_first[openers], as_later[later] = place[: len(openers)], place[len(openers) :]
        at = np.where(first, as_first[index], as_later[index])
        size = self.length[at]
        flat = self.ids[ragged(self.start[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[bounds]
        long = iter(self._whole(list(whole.values())))
        for i in range(len(plain)):
            yield np.array(next(long), dtype=np.uint32) if i in whole else flat[ends[i] : ends[i + 1]]
