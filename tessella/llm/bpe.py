"""Byte-pair encoding and decoding of whole texts with a word-end vocabulary.

Each pre-token is held as a contiguous array of parts beside the array of its adjacent pairs' ranks.
The smallest rank is looked for, the boundary inside that pair is deleted and the two neighbouring
ranks are refreshed, until no pair has a rank. Pre-tokens of equal length are worked side by side,
one row each, so a step costs a few array operations for thousands of them. Pre-tokens of over
``SHORT`` bytes use the same rule with a heap, which does not scan.

A worker remembers the codes of blank-separated chunks; what it remembers is bounded and never
changes a result. Defined results: null texts count as empty; empty texts have no tokens; a row's
null id stays null; equal rows give equal rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import coded, slices, texts
from tessella.session import ship

SHORT = 48
KEPT_CHUNKS = 250_000
NO_RANK = np.int64(1 << 40)
_OPEN: dict[str, "WordBpe"] = {}


def opened(path: str) -> "WordBpe":
    """The coder for the vocabulary file at ``path``, one per worker process."""
    if path not in _OPEN:
        with open(path, encoding="utf-8") as file:
            _OPEN[path] = WordBpe(json.load(file))
    return _OPEN[path]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it shows, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    def __init__(self, spec: dict):
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spelling = dict(zip(vocabulary.values(), vocabulary)) | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocabulary[c + end] for c in letters], dtype=np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s stands for Unicode's white space, which is less than what Python's \s holds
        self.pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.width = 1 + max(max(vocabulary.values()), *self.special.values())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.width + right
        # the last of equal pairs counts, as in a map filled in order
        by_key = np.lexsort((-np.arange(len(keys)), keys))
        first = np.concatenate([[True], keys[by_key][1:] != keys[by_key][:-1]])
        self.keys, self.ranks = keys[by_key][first], by_key[first].astype(np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens: list[list[int]] = []
        self.id_text = np.empty(1 << 12, dtype=object)
        self.decoded = np.empty(1 << 12, dtype=object)
        self.size = np.zeros(1 << 12, dtype=np.int64)

    # pre-tokens ------------------------------------------------------------------------------------

    def pretokens(self, text: str) -> list[str]:
        """Composed, lower-cased letter by letter, and cut by the vocabulary's pattern."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                return self.pattern.findall("".join(map(str.lower, text)))
        return self.pattern.findall(text.lower())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of parts; a part under 0 is none."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.ranks[at], NO_RANK)

    def merge_equal(self, raw: list[bytes]) -> list[list[int]]:
        """The parts of pre-tokens that have equally many bytes."""
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
        n = data.shape[1]
        parts = np.full((len(raw), n + 1), -1, dtype=np.int64)
        parts[:, :n] = self.inner[data]
        parts[:, n - 1] = self.final[data[:, -1]]
        done = parts.copy()
        rows = np.arange(len(raw))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        columns = np.arange(n + 1)
        while len(rows):
            least = ranks.argmin(axis=1)
            at = np.arange(len(rows))
            value = ranks[at, least]
            open_ = value < NO_RANK
            if not open_.all():
                done[rows[~open_]] = parts[~open_]
                rows, parts, ranks, least, value = rows[open_], parts[open_], ranks[open_], least[open_], value[open_]
                if not len(rows):
                    break
                at = np.arange(len(rows))
            # delete the boundary inside the pair: all that stands right of it moves one place left
            moved = np.minimum(columns + (columns > least[:, None]), n)
            parts[at, least] = self.merged[value]
            parts = np.take_along_axis(parts, moved, axis=1)
            parts[:, n] = -1
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, :n], n - 1), axis=1)
            ranks[:, n - 1] = NO_RANK
            ranks[at, least] = self.rank(parts[at, least], parts[at, least + 1])
            back = np.maximum(least - 1, 0)
            has = least > 0
            ranks[at[has], back[has]] = self.rank(parts[at[has], back[has]], parts[at[has], least[has]])
        return [row[row >= 0].tolist() for row in done]

    def merge_long(self, raw: bytes) -> list[int]:
        """The same rule for one long pre-token: a heap gives the smallest rank, leftmost first."""
        parts = self.inner[list(raw)].tolist()
        parts[-1] = int(self.final[raw[-1]])
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, width = self.rank_of, self.width
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of.get(parts[i] * width + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := rank_of.get(parts[x] * width + parts[y])) is not None:
                    heapq.heappush(heap, (found, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode_pretokens(self, several: list[str]) -> list[list[int]]:
        raw = [t.encode() for t in several]
        out: list[list[int]] = [[]] * len(raw)
        by_size: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > SHORT:
                out[i] = self.merge_long(b)
            else:
                by_size.setdefault(len(b), []).append(i)
        for same in by_size.values():
            for at in range(0, len(same), 20_000):
                some = same[at : at + 20_000]
                for i, parts in zip(some, self.merge_equal([raw[i] for i in some])):
                    out[i] = parts
        return out

    # chunks ----------------------------------------------------------------------------------------

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of texts without ASCII white space; special tokens stand for themselves."""
        numbers: dict[str, int] = {}
        shapes: list[list[int]] = []
        for chunk in chunks:
            shape: list[int] = []
            pieces = self.specials.split(chunk) if self.specials and "<|" in chunk else (chunk,)
            for piece in pieces:
                if piece in self.special:
                    shape.append(-1 - self.special[piece])
                elif piece:
                    shape += [numbers.setdefault(t, len(numbers)) for t in self.pretokens(piece)]
            shapes.append(shape)
        coded_ = self.encode_pretokens(list(numbers))
        return [[i for k in shape for i in (coded_[k] if k >= 0 else (-1 - k,))] for shape in shapes]

    def decode(self, ids: list[int]) -> str:
        """Spellings joined by blanks, special tokens included."""
        return " ".join([self.spelling[i] for i in ids])

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        new = [c for c in chunks if c not in self.number]
        if new and self.number and len(self.number) + len(new) > KEPT_CHUNKS:
            self._forget()
            new = chunks
        if new:
            first = len(self.number)
            found = self.encode_chunks(new)
            while first + len(new) > len(self.size):
                self.id_text = np.concatenate([self.id_text, np.empty_like(self.id_text)])
                self.decoded = np.concatenate([self.decoded, np.empty_like(self.decoded)])
                self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.id_text[first : first + len(new)] = [" ".join(map(str, ids)) for ids in found]
            self.decoded[first : first + len(new)] = [self.decode(ids) for ids in found]
            self.size[first : first + len(new)] = [len(ids) for ids in found]
            self.tokens += found
            self.number.update(zip(new, range(first, first + len(new))))
        return np.fromiter((self.number[c] for c in chunks), dtype=np.int64, count=len(chunks))

    def _placed(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text, the numbers of its chunks that have tokens."""
        parts = pc.ascii_split_whitespace(texts(column))
        bounds = np.asarray(parts.offsets, dtype=np.int64)
        bounds = bounds - bounds[0]
        index, words = coded(parts.flatten())
        at = self._numbers(words.to_pylist())[index] if len(index) else index
        full = self.size[at] > 0
        ends = np.concatenate([[0], np.cumsum(full)])[bounds]
        at = at[full]
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield at[begin:end]

    def encode(self, column: pa.Array) -> Iterator[list[int]]:
        """The ids of each text."""
        for at in self._placed(column):
            yield [i for k in at.tolist() for i in self.tokens[k]]

    def round_trips(self, column: pa.Array) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of its ids, its ids in decimal joined by blanks, and the decoded text."""
        for at in self._placed(column):
            yield int(self.size[at].sum()), " ".join(self.id_text[at].tolist()), " ".join(self.decoded[at].tolist())


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of its text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.bpe import opened as coder

        for batch in slices(batches, "text"):
            ids = pa.array(list(coder(vocabulary).encode(batch.column("text"))), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text that its ids spell, special tokens included."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.bpe import opened as coder

        for batch in batches:
            spelled = [coder(vocabulary).decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spelled, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's ids and of what they decode to, without moving ids or decoded texts out of the worker."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.bpe import opened as coder

        def digest(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        for batch in slices(batches, "text"):
            rows = [(n, digest(i), digest(t)) for n, i, t in coder(vocabulary).round_trips(batch.column("text"))]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
