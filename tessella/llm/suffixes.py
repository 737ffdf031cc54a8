"""Suffixes of byte strings sorted by mergesort; two of them are compared by hashes of their prefixes."""

from __future__ import annotations

from collections import Counter

import numpy as np

from tessella.llm.words import ragged

PRIME = np.uint64((1 << 61) - 1)
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_S30, _S31, _S61 = np.uint64(30), np.uint64(31), np.uint64(61)
#: Bases of the polynomials; another one is taken each time that two unlike strings were found to agree.
BASES = (0x0B7E151628AED2A6, 0x1E3779B97F4A7C15, 0x0243F6A8885A308D, 0x13198A2E03707344)
#: Bytes held against each other at once.
COMPARED = 1 << 21
_POWERS: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> _S61)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return reduced(((a1 * b1) << np.uint64(1)) + (middle >> _S30) + ((middle & _LOW30) << _S31) + a0 * b0)


def _series(step: int, size: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < size:
        factor = np.uint64(pow(step, len(out), int(PRIME)))
        out = np.concatenate([out, times(out, np.broadcast_to(factor, out.shape))])
    return out[:size]


def powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low bits of a base's powers, and the powers of its inverse."""
    if which not in _POWERS or len(_POWERS[which][2]) < size:
        base = BASES[which % len(BASES)] + which // len(BASES)
        up = _series(base, size)
        _POWERS[which] = (up >> _S31, up & _LOW31, _series(pow(base, -1, int(PRIME)), size))
    return _POWERS[which]


class PrefixHashes:
    """The hash, modulo 2**61 - 1, of any short string of some bytes in constant time, from sums over their prefixes.

    Sums may wrap around: the differences taken are those of strings under 2**24 bytes, which are exact.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        high, low, self.inverse = powers(which, 1 << max(16, len(data).bit_length()))
        x = data.astype(np.uint64) + np.uint64(1)
        self.high, self.low = (np.zeros(len(data) + 1, dtype=np.uint64) for _ in range(2))
        np.cumsum(x * high[: len(data)], out=self.high[1:])
        np.cumsum(x * low[: len(data)], out=self.low[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high = self.high[end] - self.high[start]
        x = reduced((high >> _S30) + ((high & _LOW30) << _S31) + (self.low[end] - self.low[start]))
        return times(x, self.inverse[start])


def common(hashes: PrefixHashes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """How many of their first ``length`` bytes the suffixes at x and y have in common, by binary search."""
    low, high = np.zeros(len(x), dtype=np.int64), np.full(len(x), length, dtype=np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        a, b = x[open_], y[open_]
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1
    return low


def _before(data: np.ndarray, hashes: PrefixHashes, whole: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as suffix x comes before, is equal to, or comes behind suffix y."""
    order = np.zeros(len(x), dtype=np.int8)
    unlike = np.flatnonzero(whole[x] != whole[y])
    a, b = at[x[unlike]], at[y[unlike]]
    k = common(hashes, a, b, length)
    k = np.minimum(k, length - 1)
    order[unlike] = np.where(data[a + k] < data[b + k], -1, 1)
    return order


def sort(data: np.ndarray, hashes: PrefixHashes, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at`` by group and first ``length`` bytes, and the hashes of those bytes.

    Groups are merged side by side: in each pass every suffix finds its rank in the neighbouring sorted run.
    """
    order = np.argsort(group, kind="stable")
    whole = hashes.of(at, at + length)
    first = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1]) if len(order) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.concatenate([first, [len(order)]]))
    begin = np.repeat(first, size)
    total = np.repeat(size, size)
    index = np.arange(len(order)) - begin
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(total > width)
        own = order[live]
        base, i, n = begin[live], index[live], total[live]
        right = (i // width) % 2 == 1
        low = np.where(right, i // width * width - width, i // width * width + width)
        high = np.minimum(low + width, n)
        low = np.minimum(low, n)
        start = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            side = _before(data, hashes, whole, at, order[base[open_] + middle], own[open_], length)
            # suffixes of the left run come first where they are equal
            ahead = (side < 0) | ((side == 0) & right[open_])
            low[open_[ahead]] = middle[ahead] + 1
            high[open_[~ahead]] = middle[~ahead]
        rank = low - start
        block = np.where(right, i // width * width - width, i // width * width)
        place = base + block + i % width + rank
        merged = order.copy()
        merged[place] = own
        order = merged
        width *= 2
    return order, whole


def repeated(
    data: np.ndarray, bounds: np.ndarray, anchor: np.ndarray, near: np.ndarray, far: np.ndarray, group: np.ndarray, length: int, which: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which strings of ``length`` bytes, begun ``near`` to ``far`` bytes before each row's anchor, stand in another row of its group.

    Row r holds data[bounds[r] : bounds[r + 1]], its anchor at ``anchor[r]`` of it. Equal strings have equal distances to
    their anchors, so the suffixes of a group and a distance are sorted, and neighbours that agree throughout are held against
    each other byte by byte. Returns each string's row, distance, hash and whether it is repeated.
    """
    counts = far - near + 1
    row = np.repeat(np.arange(len(anchor)), counts)
    back = ragged(near, counts)
    at = (bounds[:-1] + anchor)[row] - back
    _, dense = np.unique(group, return_inverse=True)
    key = dense[row] * np.int64(int(far.max(initial=0)) + 1) + back
    hashes = PrefixHashes(data, which)
    order, whole = sort(data, hashes, at, key, length)
    found = np.zeros(len(at), dtype=bool)
    if len(order) < 2:
        return row, back, whole, found
    x, y = order[:-1], order[1:]
    equal = (key[x] == key[y]) & (whole[x] == whole[y])
    x, y = x[equal], y[equal]
    # strings of one pair of rows overlap: their rows are compared once, over all that these strings cover
    pair = np.lexsort((back[x], row[y], row[x]))
    x, y = x[pair], y[pair]
    cut = np.flatnonzero(np.concatenate([[True], (row[x][1:] != row[x][:-1]) | (row[y][1:] != row[y][:-1])])) if len(x) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([cut[1:], [len(x)]])[: len(cut)] - 1
    sizes = back[x[last]] - back[x[cut]] + length
    unlike = np.zeros(len(cut), dtype=bool)
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(cut):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - sizes[begin] + COMPARED, side="right")))
        i, j = ragged(at[x[last[begin:end]]], sizes[begin:end]), ragged(at[y[last[begin:end]]], sizes[begin:end])
        unlike[begin:end] = np.add.reduceat(data[i] != data[j], total[begin:end] - sizes[begin:end] - (total[begin] - sizes[begin])) > 0
        begin = end
    found[x], found[y] = True, True
    for g in np.unique(dense[row[x[cut[unlike]]]]):
        # unlike strings with equal hashes, or other bytes between two strings of a pair: this group is told apart by its bytes
        some = np.flatnonzero(dense[row] == g)
        seen = Counter((int(back[k]), data[at[k] : at[k] + length].tobytes()) for k in some)
        found[some] = [seen[(int(back[k]), data[at[k] : at[k] + length].tobytes())] > 1 for k in some]
    return row, back, whole, found
