"""Patch predictions against a plain loop over patches, moved patches against a plain resampler, weights there and back."""

import math

import numpy as np

from tessella.operators import raster
from tessella.sources import sinks


def plain(image, held, layers, window):
    """Every cell's mean logit, one patch after the other."""
    height, width = held.shape
    sums, counts = np.zeros(held.shape), np.zeros(held.shape)
    for r, k in np.argwhere(held).tolist():
        patch = np.zeros((len(image), window, window))
        for a in range(window):
            for b in range(window):
                i, j = r - window // 2 + a, k - window // 2 + b
                if 0 <= i < height and 0 <= j < width:
                    patch[:, a, b] = image[:, i, j]
        logits = raster.forward(patch, layers)
        for a in range(window):
            for b in range(window):
                i, j = r - window // 2 + a, k - window // 2 + b
                if 0 <= i < height and 0 <= j < width:
                    sums[i, j] += logits[a, b]
                    counts[i, j] += 1
    return sums / np.maximum(counts, 1)


def test_patches_are_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    layers = raster.network(2, seed=3)
    for layer in layers[:-1]:
        layer["scale"], layer["shift"] = rng.uniform(0.5, 2, len(layer["scale"])), rng.normal(size=len(layer["shift"]))
    rows, want = [], {}
    for city, (height, width) in enumerate([(13, 9), (3, 21)]):
        image, held = rng.normal(size=(2, height, width)), rng.random((height, width)) < 0.8
        image[:, ~held] = 0
        null = rng.random((height, width)) < 0.1
        image[1, null] = 0
        mean = plain(image, held, layers, 6)
        for i, j in np.argwhere(held).tolist():
            rows.append((f"c{city}", i, j, float(image[0, i, j]), None if null[i, j] else float(image[1, i, j])))
            want[(f"c{city}", i, j)] = mean[i, j]
    df = spark.createDataFrame(rows, "place string, row int, col int, u double, v double")
    for window_tile in ((6, 4), (6, 64)):
        got = raster.predict_patches(df, "place", ["u", "v"], layers, *window_tile, batch=5).collect()
        assert {(r["place"], r["row"], r["col"]) for r in got} == set(want) and len(got) == len(want)
        assert all(abs(r["logit"] - want[(r["place"], r["row"], r["col"])]) < 1e-9 and abs(r["prob"] - 1 / (1 + math.exp(-r["logit"]))) < 1e-12 for r in got)


def test_weights_with_scale_and_shift(spark, tmp_path):
    layers = raster.network(1, seed=2)
    layers[0]["scale"] = np.array([2.0, -1.0])
    sinks.save_weights(spark, layers, str(tmp_path / "w"), epoch=3)
    back, state = sinks.load_weights(spark, str(tmp_path / "w"))
    x = np.random.default_rng(4).normal(size=(1, 9, 9))
    assert state == {"epoch": 3} and np.array_equal(raster.forward(x, back), raster.forward(x, layers))


def test_moves_are_bilinear():
    rng = np.random.default_rng(6)
    side = 7
    patch = rng.normal(size=(side, side))
    for angle, down, right in ((0, 0, 0), (90, 0, 0), (37.0, 0, 0), (-12.5, 1.3, -0.4), (180, 0, 2), (0, 9, 0)):
        got = (raster.resampling(side, angle, down, right) @ patch.ravel()).reshape(side, side)
        t, m = math.radians(angle), (side - 1) / 2
        for i in range(side):
            for j in range(side):
                y, x = i - down - m, j - right - m
                r, k = math.cos(t) * y + math.sin(t) * x + m, -math.sin(t) * y + math.cos(t) * x + m
                want = 0.0
                for a in range(side):
                    for b in range(side):
                        want += patch[a, b] * max(0, 1 - abs(r - a)) * max(0, 1 - abs(k - b))
                assert abs(got[i, j] - want) < 1e-6
    turned = (raster.resampling(side, 90, 0, 0) @ patch.ravel()).reshape(side, side)
    assert np.allclose(turned, np.rot90(patch))


def test_patches_by_matrices_are_those_of_the_net():
    rng = np.random.default_rng(9)
    layers = raster.network(2, seed=3)
    layers[0] |= {"scale": rng.normal(size=4), "shift": rng.normal(size=4)}
    for side in (3, 18):
        x = rng.normal(size=(5, 2, side, side))
        x[0] = 0.0
        got = raster.patch_logits(x, layers, [raster.banded(layer, side) for layer in layers])
        assert got.shape == (5, side, side) and np.allclose(got, raster.forward(x, layers), rtol=0, atol=1e-10)
