"""Rasters as long tables of cells: bounds, slopes, patches, tiles and a small convolutional network's predictions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import ship

c = F.col


def valid(row: Column, column: Column, height: int, width: int, value: Column, nodata: float) -> Column:
    """Whether a cell lies in the raster and holds a value."""
    return row.between(0, height - 1) & column.between(0, width - 1) & value.isNotNull() & (value != nodata)


def _shifted(cells: DataFrame, reach: int) -> DataFrame:
    """Every cell's value at its neighbours up to ``reach`` away, itself included, with its place di, dj as seen from there."""
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    spread = cells.withColumn("o", F.explode(steps))
    return spread.select((c("i") - c("o.di")).alias("i"), (c("j") - c("o.dj")).alias("j"), c("o.di").alias("di"), c("o.dj").alias("dj"), "z")


def slope(cells: DataFrame, dy: float, dx: float) -> DataFrame:
    """i, j and slope by central differences, one-sided at the edges; missing values count as 0 for their neighbours and have no slope."""
    filled = cells.select("i", "j", F.coalesce("z", F.lit(0.0)).alias("z"))
    near = _shifted(filled, 1).where("abs(di) + abs(dj) <= 1")
    at = lambda a, b: F.max(F.when((c("di") == a) & (c("dj") == b), c("z")))
    wide = near.groupBy("i", "j").agg(at(0, 0).alias("z0"), at(0, -1).alias("w"), at(0, 1).alias("e"), at(-1, 0).alias("n"), at(1, 0).alias("s"))

    def change(before: str, after: str) -> Column:
        low, high = F.coalesce(before, "z0"), F.coalesce(after, "z0")
        steps = c(before).isNotNull().cast("int") + c(after).isNotNull().cast("int")
        return F.try_divide(high - low, steps)

    wide = wide.join(cells.where("z is not null").select("i", "j"), ["i", "j"])
    return wide.select("i", "j", F.sqrt((change("w", "e") / dx) ** 2 + (change("n", "s") / dy) ** 2).alias("slope"))


def patches(cells: DataFrame, reach: int) -> DataFrame:
    """i, j, ``patch`` (the window around the cell, row by row, 0 where there is no cell) and how many cells it ``held``."""
    side = 2 * reach + 1
    near = _shifted(cells, reach).groupBy("i", "j").agg(
        F.map_from_entries(F.collect_list(F.struct(((c("di") + reach) * side + c("dj") + reach).alias("k"), c("z")))).alias("m"), F.count("z").alias("held")
    )
    patch = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return near.join(cells.select("i", "j"), ["i", "j"]).select("i", "j", patch.alias("patch"), "held")


def augmented(df: DataFrame, side: int) -> DataFrame:
    """Each patch turned counter-clockwise 0 to 3 times, and mirrored or not: columns ``turn`` and ``mirror``."""
    index = np.arange(side * side).reshape(side, side)
    forms = []
    for turn in range(4):
        for mirror in (False, True):
            order = np.rot90(index, turn)
            order = (order[:, ::-1] if mirror else order).ravel().tolist()
            forms.append(F.struct(F.lit(turn).alias("turn"), F.lit(mirror).alias("mirror"), F.array(*map(F.lit, order)).alias("order")))
    wide = df.withColumn("f", F.explode(F.array(*forms)))
    others = [n for n in df.columns if n != "patch"]
    return wide.select(*others, "f.turn", "f.mirror", F.transform("f.order", lambda k: F.get(F.col("patch"), k)).alias("patch"))


def mosaic(tiles: list[DataFrame], place: list[str], value: str) -> DataFrame:
    """One raster from tiles that overlap: each cell's value is the first that is there, in the tiles' order."""
    numbered = [t.select(*place, value).withColumn("_t", F.lit(i)) for i, t in enumerate(tiles)]
    return reduce(DataFrame.unionByName, numbered).where(F.col(value).isNotNull()).groupBy(*place).agg(F.min_by(value, "_t").alias(value))


def network(channels: int, seed: int) -> list[dict]:
    """Untrained weights of the net: convolutions of 5, 11 (dilated by 2), 5 and 11, widths 2, 4, 4 times ``channels`` and 1.

    All but the last are followed by a normalisation with a scale and a shift for each channel.
    """
    rng = np.random.default_rng(seed)
    widths, kernels, dilations = [channels, 2 * channels, 4 * channels, 4 * channels, 1], (5, 11, 5, 11), (1, 2, 1, 2)
    layers = []
    for n_in, n_out, k, d in zip(widths[:-1], widths[1:], kernels, dilations):
        bound = 1 / np.sqrt(n_in * k * k)
        layers.append({"weight": rng.uniform(-bound, bound, (n_out, n_in, k, k)), "bias": rng.uniform(-bound, bound, n_out), "dilation": d})
        if n_out > 1:
            layers[-1] |= {"scale": np.ones(n_out), "shift": np.zeros(n_out)}
    return layers


def convolved(x: np.ndarray, layer: dict) -> np.ndarray:
    """A convolution with the edge repeated outwards; x is (..., channels, height, width) and keeps its size."""
    weight, d = layer["weight"], layer["dilation"]
    k = weight.shape[2]
    pad = d * (k - 1) // 2
    batch = x.reshape(-1, *x.shape[-3:])
    wide = np.pad(batch, ((0, 0), (0, 0), (pad, pad), (pad, pad)), mode="edge")
    h, w = x.shape[-2:]
    out = np.zeros((weight.shape[0], len(batch), h, w))
    for a in range(k):
        for b in range(k):
            out += np.tensordot(weight[:, :, a, b], wide[:, :, a * d : a * d + h, b * d : b * d + w], axes=(1, 1))
    out = np.moveaxis(out, 0, 1) + layer["bias"][:, None, None]
    return out.reshape(*x.shape[:-3], *out.shape[1:])


def forward(x: np.ndarray, layers: list[dict]) -> np.ndarray:
    """A logit per cell: convolutions with each channel normalised over its image, scaled and shifted, and a leaky ramp between them.

    x is one image (channels, height, width) or a batch of them, each of which is normalised by itself.
    """
    for i, layer in enumerate(layers):
        x = convolved(x, layer)
        if i < len(layers) - 1:
            mean, var = x.mean(axis=(-2, -1), keepdims=True), x.var(axis=(-2, -1), keepdims=True)
            x = (x - mean) / np.sqrt(var + 1e-5)
            x = x * layer.get("scale", np.ones(x.shape[-3]))[:, None, None] + layer.get("shift", np.zeros(x.shape[-3]))[:, None, None]
            x = np.where(x > 0, x, 0.01 * x)
    return x[..., 0, :, :]


def banded(layer: dict, width: int) -> np.ndarray:
    """A convolution's matrix for each row of its kernel: from all channels and columns of an image's row of ``width`` to those of a new row, the edge repeated outwards."""
    weight, d = layer["weight"], layer["dilation"]
    n_out, n_in, k, _ = weight.shape
    out = np.zeros((k, n_in, width, n_out, width))
    for b in range(k):
        for v in range(width):
            out[:, :, min(max(v + b * d - d * (k - 1) // 2, 0), width - 1), :, v] += weight[:, :, :, b].transpose(2, 1, 0)
    return out.reshape(k, n_in * width, n_out * width)


def patch_logits(x: np.ndarray, layers: list[dict], matrices: list[np.ndarray]) -> np.ndarray:
    """What ``forward`` gives for a batch of small patches (patch, channels, height, width), with one product of matrices for each row of a kernel.

    Rows of all patches stand together, so the rows that a kernel's row meets are one block. ``matrices`` are ``banded`` for the patches' width.
    """
    n, _, h, w = x.shape
    x = np.ascontiguousarray(x.transpose(2, 0, 1, 3)).reshape(h, n, -1)
    for i, (layer, matrix) in enumerate(zip(layers, matrices)):
        k, d = len(matrix), layer["dilation"]
        pad = d * (k - 1) // 2
        wide = x[np.clip(np.arange(-pad, h + pad), 0, h - 1)]
        out, part = np.zeros((h * n, matrix.shape[2])), np.empty((h * n, matrix.shape[2]))
        for a in range(k):
            np.matmul(wide[a * d : a * d + h].reshape(h * n, -1), matrix[a], out=part)
            out += part
        y = out.reshape(h, n, -1, w)
        y += layer["bias"][:, None]
        if i < len(layers) - 1:
            mean, var = y.mean(axis=(0, 3), keepdims=True), y.var(axis=(0, 3), keepdims=True)
            factor = layer.get("scale", np.ones(y.shape[2]))[:, None] / np.sqrt(var + 1e-5)
            y -= mean
            y *= factor
            y += layer.get("shift", np.zeros(y.shape[2]))[:, None]
            np.maximum(y, 0.01 * y, out=y)
        x = y.reshape(h, n, -1)
    return x.reshape(h, n, w).transpose(1, 0, 2)


def tile_logits(image: np.ndarray, anchors: np.ndarray, layers: list[dict], window: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of logits and numbers of patches for each cell of an image (channels, height, width).

    A patch of ``window`` cells is anchored at each of ``anchors`` (row, col of its upper left corner); ``batch`` of them are worked at once.
    """
    sums, counts = np.zeros(image.shape[1:]), np.zeros(image.shape[1:], dtype=np.int64)
    matrices = [banded(layer, window) for layer in layers]
    views = np.lib.stride_tricks.sliding_window_view(image, (window, window), axis=(1, 2))
    for at in range(0, len(anchors), batch):
        some = anchors[at : at + batch]
        logits = patch_logits(views[:, some[:, 0], some[:, 1]].swapaxes(0, 1), layers, matrices)
        for (r, k), logit in zip(some.tolist(), logits):
            sums[r : r + window, k : k + window] += logit
            counts[r : r + window, k : k + window] += 1
    return sums, counts


def predict_patches(cells: DataFrame, by: str, features: list[str], layers: list[dict], window: int = 18, tile: int = 32, batch: int = 32) -> DataFrame:
    """by, row, col, logit and prob of every cell (row and col from 0): the mean over all patches that hold it, a patch around each cell.

    A cell's patch begins window // 2 above and left of it; where it holds no cell, and where a feature is null, it is 0. The raster is dealt to tiles of
    ``tile`` cells, each with a halo of the cells that its patches reach, so a task holds one tile, however large a city is; what a tile
    found for a cell is summed up with what others found.
    """
    ship(cells.sparkSession)
    sent = cells.sparkSession.sparkContext.broadcast(layers)  # some thousand numbers
    before, after = window - window // 2 - 1, window // 2
    kind = dict(cells.dtypes)[by]

    def around(name: str) -> Column:
        """The tiles whose patches hold the cell: those of the anchors from ``before`` cells before it to ``after`` behind it."""
        low, high = F.floor((c(name) - before) / tile), F.floor((c(name) + after) / tile)
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from tessella.operators.raster import tile_logits as work

        top, left = int(frame["tr"].iloc[0]) * tile - window // 2, int(frame["tc"].iloc[0]) * tile - window // 2
        rows, cols = frame["row"].to_numpy() - top, frame["col"].to_numpy() - left
        image = np.zeros((len(features), tile + window - 1, tile + window - 1))
        for k, name in enumerate(features):
            image[k, rows, cols] = frame[name].astype(float).fillna(0.0).to_numpy()
        own = (rows >= window // 2) & (rows < tile + window // 2) & (cols >= window // 2) & (cols < tile + window // 2)
        anchors = np.column_stack([rows[own], cols[own]]) - window // 2
        sums, counts = work(image, anchors, sent.value, window, batch)
        out = pd.DataFrame({by: frame[by], "row": frame["row"], "col": frame["col"], "s": sums[rows, cols], "n": counts[rows, cols]})
        return out[out["n"] > 0]

    dealt = cells.select(by, "row", "col", *features).withColumn("tr", around("row")).withColumn("tc", around("col"))
    parts = dealt.groupBy(by, "tr", "tc").applyInPandas(run, f"`{by}` {kind}, row int, col int, s double, n bigint")
    logit = F.sum("s") / F.sum("n")
    return parts.groupBy(by, "row", "col").agg(logit.alias("logit")).withColumn("prob", 1 / (1 + F.exp(-c("logit"))))


def resampling(side: int, angle: float, down: float, right: float) -> np.ndarray:
    """The weights by which a patch's cells, turned counter-clockwise by ``angle`` degrees about the middle and then moved, make up the new
    cells: bilinear between the four around a place, 0 outside."""
    turn, middle = np.radians(angle), (side - 1) / 2
    i, j = np.mgrid[0:side, 0:side].reshape(2, -1)
    y, x = i - down - middle, j - right - middle
    # where a new cell was before: rows count downwards
    at = np.cos(turn) * y + np.sin(turn) * x + middle, -np.sin(turn) * y + np.cos(turn) * x + middle
    low = [np.floor(v + 1e-9).astype(int) for v in at]
    out = np.zeros((side * side, side * side))
    for a in (0, 1):
        for b in (0, 1):
            share = np.abs(1 - a - (at[0] - low[0])) * np.abs(1 - b - (at[1] - low[1]))
            r, k = low[0] + a, low[1] + b
            held = (r >= 0) & (r < side) & (k >= 0) & (k < side) & (share > 1e-9)
            np.add.at(out, (np.flatnonzero(held), r[held] * side + k[held]), share[held])
    return out


def moved_patches(df: DataFrame, side: int, moves: list[tuple[float, float, float]]) -> DataFrame:
    """Each patch (column ``patch``, row by row) under each of ``moves`` (angle, down, right): columns ``angle``, ``down``, ``right``; see ``resampling``."""
    ship(df.sparkSession)
    others = [n for n in df.columns if n != "patch"]

    def run(batches):
        from tessella.operators.raster import resampling as weights

        tables = [weights(side, *m) for m in moves]
        for batch in batches:
            if len(batch):
                flat = np.stack(batch["patch"].to_list())
                for (angle, down, right), table in zip(moves, tables):
                    yield batch[others].assign(angle=angle, down=down, right=right, patch=list(flat @ table.T))

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "patch")
    return df.mapInPandas(run, f"{kinds}, angle double, down double, right double, patch array<double>")


def infer(cells: DataFrame, city: str, features: list[str], layers: list[dict]) -> DataFrame:
    """city, row, col, logit and prob from whole images, each of which is one task's work; large rasters are for ``predict_patches``."""
    ship(cells.sparkSession)
    spark = cells.sparkSession
    sent = spark.sparkContext.broadcast(layers)  # some thousand numbers

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from tessella.operators.raster import forward as net

        rows, cols = frame["row"].to_numpy(), frame["col"].to_numpy()
        image = np.zeros((len(features), rows.max() + 1, cols.max() + 1))
        for k, name in enumerate(features):
            image[k, rows, cols] = frame[name].fillna(0.0).to_numpy()
        logit = net(image, sent.value)[rows, cols]
        return pd.DataFrame({"city": frame["city"], "row": rows, "col": cols, "logit": logit, "prob": 1 / (1 + np.exp(-logit))})

    narrow = cells.select(F.col(city).alias("city"), "row", "col", *features)
    return narrow.groupBy("city").applyInPandas(run, "city int, row int, col int, logit double, prob double")
