"""Token counts under a unigram model, scored once per shared prefix.

The distinct pre-tokens of a batch are inserted in a trie by walking them in sorted order: the forward
scores of the trie's current path are held, a pre-token keeps those of the prefix it shares with the
one before it and adds its own letters, and its terminal count is stored. A letter's forward score is the best
over all pieces that end there; the count is that of the pieces on the best path, ties to the longest last piece.

Pieces come from a sentencepiece file. Its scores are ranks, so a piece of rank r weighs -ln(r + 2).
A letter that no piece covers costs its bytes: as many tokens as it has in UTF-8, each of the least weight.

Defined results: null and empty texts have 0 words and 0 tokens; a row's null id stays null; equal
rows give equal rows; other columns play no part. Pre-tokens are runs of other than ASCII white space, each led by
the sign for a blank; one of over ``LONGEST`` letters is scored apart, so the path stays short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import coded, slices, texts
from tessella.session import ship

BLANK = "▁"
LONGEST = 1000
KEPT = 400_000
_OPEN: dict[str, "UnigramCounter"] = {}


def opened(path: str) -> "UnigramCounter":
    if path not in _OPEN:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        _OPEN[path] = UnigramCounter({model.id_to_piece(i): -math.log(2.0 - model.get_score(i)) for i in ordinary})
    return _OPEN[path]


class UnigramCounter:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.lengths = sorted({len(p) for p in weights})
        self.least = min(weights.values()) - 1.0
        self.known: dict[str, int] = {}

    def _extend(self, word: str, score: list[float], count: list[int], shared: int) -> None:
        """Forward scores of the letters from ``shared`` on; those before it stand."""
        del score[shared + 1 :], count[shared + 1 :]
        weights = self.weights
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode())
            best, n = score[end - 1] + size * self.least, count[end - 1] + size
            for length in self.lengths:
                if length > end:
                    break
                weight = weights.get(word[end - length : end])
                if weight is not None and score[end - length] + weight >= best:
                    best, n = score[end - length] + weight, count[end - length] + 1
            score.append(best)
            count.append(n)

    def counts(self, words: list[str]) -> np.ndarray:
        """The token count of each pre-token."""
        new = sorted(w for w in set(words) if w not in self.known)
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = sorted(set(words))
        score, count, before = [0.0], [0], ""
        for word in new:
            path = BLANK + word
            if len(path) > LONGEST:
                own_score, own_count = [0.0], [0]
                self._extend(path, own_score, own_count, 0)
                self.known[word] = own_count[-1]
                continue
            shared = 0
            for a, b in zip(before, path):
                if a != b:
                    break
                shared += 1
            self._extend(path, score, count, shared)
            self.known[word] = count[-1]
            before = path
        return np.fromiter((self.known[w] for w in words), dtype=np.int64, count=len(words))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and tokens of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.token_counts import opened as counter

        for batch in slices(batches, "text"):
            parts = pc.ascii_split_whitespace(texts(batch.column("text")))
            bounds = np.asarray(parts.offsets, dtype=np.int64)
            bounds = bounds - bounds[0]
            index, words = coded(parts.flatten())
            spelled = words.to_pylist()
            each = counter(model).counts(spelled)
            real = np.fromiter((bool(w) for w in spelled), dtype=np.int64, count=len(spelled))
            sums = [np.concatenate([[0], np.cumsum((x * real)[index])]) for x in (np.ones_like(real), each)]
            columns = [pa.array((s[bounds[1:]] - s[bounds[:-1]]), type=pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
