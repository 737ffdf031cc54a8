"""Sums over the places in rings around points, tile by tile in NumPy: a tile's points are kept with their sums, the places in reach pass by, and no pair is written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are worked at once, and parts of a tile's side whose points meet places together.
AT_ONCE, PARTS_TO_TILE = 1 << 17, 4
#: What a ring's row has besides its number: pairs, sums of weights, of weights times outcomes, and of products of two weights times the outcome's powers.
SUMS = ("n", "n1", "n0", "s1", "s0", *[f"{p}{k}" for p in ("t", "o", "b") for k in (2, 1, 0)])


class Tile:
    def __init__(self, rows: list[pa.RecordBatch], step: float, rings: int):
        table = pa.Table.from_batches(rows)
        x, y, v = (table.column(n).to_numpy() for n in ("x", "y", "v"))
        # rows of one id count together, as their outcomes do in a sum over an id's pairs
        code = pc.dictionary_encode(table.column("i").combine_chunks()).indices.to_numpy(zero_copy_only=False)
        _, first, own = np.unique(code, return_index=True, return_inverse=True)
        part = step / PARTS_TO_TILE
        cell = np.floor(x[first] / part) * (2 * PARTS_TO_TILE) + np.floor(y[first] / part)
        order = np.argsort(cell, kind="stable")
        self.x, self.y = x[first][order], y[first][order]
        self.m, self.v = np.bincount(own)[order].astype(float), np.bincount(own, weights=v)[order]
        self.edges = [0, *(np.flatnonzero(np.diff(cell[order])) + 1).tolist(), len(first)]
        self.rings = rings
        self.n, self.one, self.two = (np.zeros((len(first), rings + 1)) for _ in range(3))

    def add(self, ox: np.ndarray, oy: np.ndarray, treated: np.ndarray, w: np.ndarray, radius: float, width: float) -> None:
        for a, b in zip(self.edges, self.edges[1:]):
            x, y = self.x[a:b], self.y[a:b]
            far = np.hypot(np.maximum(0, np.maximum(x.min() - ox, ox - x.max())), np.maximum(0, np.maximum(y.min() - oy, oy - y.max())))
            near = far <= radius * (1 + 1e-9)
            for on, out in ((treated & near, self.one), (~treated & near, self.two)):
                at = np.flatnonzero(on)
                if not len(at):
                    continue
                px, py, pw = ox[at], oy[at], w[at]
                many = max(1, AT_ONCE // len(at))
                for c in range(a, b, many):
                    d = min(b, c + many)
                    d2 = (self.x[c:d, None] - px) ** 2 + (self.y[c:d, None] - py) ** 2
                    ring = np.where(d2 <= radius * radius, np.sqrt(d2) / width, self.rings).astype(np.int64)
                    ring += np.arange(d - c)[:, None] * (self.rings + 1)
                    ring, size = ring.ravel(), (d - c) * (self.rings + 1)
                    self.n[c:d] += np.bincount(ring, minlength=size).reshape(d - c, -1)
                    out[c:d] += np.bincount(ring, np.tile(pw, d - c), minlength=size).reshape(d - c, -1)

    def sums(self) -> pa.RecordBatch:
        m, v = self.m[:, None], self.v[:, None]
        one, two = self.one, self.two
        columns = [self.n * m, one * m, two * m, one * v, two * v]
        columns += [p * q for p in (one * one, two * two, one * two) for q in (v * v, v * m, m * m)]
        values = [c.sum(axis=0)[: self.rings] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(self.rings), pa.int32()), *map(pa.array, values)], ["bin", *SUMS])


def sums(batches: Iterator[pa.RecordBatch], step: float, radius: float, width: float) -> Iterator[pa.RecordBatch]:
    """A row for each ring of each tile. Rows come sorted by tile, its points first."""
    at, rows, tile = None, [], None
    rings = int(radius / width) + 1
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("ix", "iy", "block", "kind")])
        edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key, part = tuple(marks[:3, a].tolist()), batch.slice(a, b - a)
            if key != at:
                if tile is not None:
                    yield tile.sums()
                at, rows, tile = key, [], None
            if marks[3, a] == 0:
                rows.append(part)
            elif rows:
                tile = tile or Tile(rows, step, rings)
                x, y, treated, w = (part.column(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "treated", "v"))
                tile.add(x, y, treated.astype(bool), w, radius, width)
    if tile is not None:
        yield tile.sums()
