"""Raster files there and back: tiles, strips, missing values, windows that leave strips out, other compressions and byte orders."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import rasters


def test_tiles_there_and_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(r, k, None if rng.random() < 0.2 else float(np.float32(rng.normal()))) for r in range(45) for k in range(70)]
    df = spark.createDataFrame(rows, "row int, col int, value double").repartition(6)
    made = {r["path"]: (r["top"], r["left"]) for r in rasters.write_tiles(df, str(tmp_path), (500.0, 900.0, 3.0, 2.0), tile=32).collect()}
    assert len(made) == 6 and sorted(made.values()) == [(a, b) for a in (0, 32) for b in (0, 32, 64)]
    back = rasters.read_tiff(spark, list(made))
    places = spark.createDataFrame([(p, t, k) for p, (t, k) in made.items()], "file string, top int, left int")
    got = {(r["row"], r["col"]): r["value"] for r in back.join(places, "file").select((F.col("row") + F.col("top")).alias("row"), (F.col("col") + F.col("left")).alias("col"), "value").collect()}
    assert got == {(r, k): v for r, k, v in rows}
    assert rasters.corner_of(str(tmp_path / "tile-32-64.tif")) == (500.0 + 64 * 3, 900.0 - 32 * 2, 3.0, 2.0)
    assert not list(tmp_path.glob("*.tmp*"))


def test_windows_leave_strips_out(spark, tmp_path):
    values = np.arange(100 * 8, dtype=float).reshape(100, 8)
    path = tmp_path / "a.tif"
    path.write_bytes(rasters.encoded(values, -1.0, (0.0, 0.0, 1.0, 1.0), strip=10))
    whole = rasters.read_tiff(spark, [str(path)])
    assert whole.count() == 800 and whole.rdd.getNumPartitions() == 10
    part = rasters.read_tiff(spark, [str(path)], row_from=25, row_to=34, col_to=3)
    assert part.rdd.getNumPartitions() == 2 and part.agg(F.sum("value")).first()[0] == values[25:35, :4].sum()
    some = whole.where("row >= 41 and row < 50 and col = 2 and value > 0")
    assert some.rdd.getNumPartitions() == 1 and [r["value"] for r in some.orderBy("row").collect()] == values[41:50, 2].tolist()
    reader = rasters.RasterReader({"path": str(path)})
    assert len(list(reader.pushFilters([rasters.GreaterThan(("row",), 89), rasters.EqualTo(("value",), 1.0)]))) == 2
    assert [p.block[0] for p in reader.partitions()] == [90]


def packed(codes):
    """Codes of 9 bits, most significant bit first."""
    bits = "".join(f"{c:09b}" for c in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_other_files(spark, tmp_path):
    assert rasters.lzw(packed([256, 1, 2, 258, 260, 257])) == bytes([1, 2, 1, 2, 1, 2, 1])
    # many different pairs, so codes grow wider: coded by the plain rule of the format
    data = bytes(np.random.default_rng(2).integers(0, 256, 3000, dtype=np.uint8))
    table, word, out, width = {bytes([i]): i for i in range(256)}, b"", [(256, 9)], 9
    size = 258
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        out.append((table[word], width))
        table[word + bytes([byte])] = size
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        word = bytes([byte])
    out += [(table[word], width)]
    width = 12 if size + 1 >= 2048 else 11 if size + 1 >= 1024 else 10 if size + 1 >= 512 else 9
    out += [(257, width)]
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    assert rasters.lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == data
    # tiles of 16 x 16 shorts, big-endian, the last ones reaching beyond a raster of 20 x 18
    values = np.arange(20 * 18, dtype=">i2").reshape(20, 18)
    wide = np.zeros((32, 32), dtype=">i2")
    wide[:20, :18] = values
    parts = [wide[r : r + 16, k : k + 16].tobytes() for r in (0, 16) for k in (0, 16)]
    begin = 8 + 2 + 12 * 9 + 4
    lists = begin + sum(map(len, parts))
    offsets = [begin + 512 * i for i in range(4)]
    fields = [(256, 3, 1, 18 << 16), (257, 3, 1, 20 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (322, 3, 1, 16 << 16), (323, 3, 1, 16 << 16), (324, 4, 4, lists), (325, 4, 4, lists + 16), (339, 3, 1, 2 << 16)]
    table = b"".join(struct.pack(">HHII", *f) for f in fields)
    path = tmp_path / "b.tif"
    path.write_bytes(struct.pack(">2sHIH", b"MM", 42, 8, 9) + table + struct.pack(">I", 0) + b"".join(parts) + struct.pack(">4I", *offsets) + struct.pack(">4I", *[512] * 4))
    got = {(r["row"], r["col"]): r["value"] for r in rasters.read_tiff(spark, [str(path)]).collect()}
    assert got == {(r, k): float(values[r, k]) for r in range(20) for k in range(18)}
    (tmp_path / "c.tif").write_bytes(b"no raster at all")
    with pytest.raises(ValueError):
        rasters.header(str(tmp_path / "c.tif"))
