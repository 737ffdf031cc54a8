"""Raster files (TIFF with one band) as a source: a table of row, col, value whose partitions are the files' strips or tiles.

A window on rows and columns, given as options or as filters that Spark pushes down, leaves out the strips that it doesn't meet. Files are
opened where tasks run, so their folder is one that all machines share. A value equal to the file's missing value is null.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)

from tessella.session import ship

# Tags of the format, the widths of its field types, and how samples are told apart.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, BANDS, STRIP_ROWS, SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT, PIXEL, PLACE, MISSING = 322, 323, 324, 325, 339, 33550, 33922, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
SAMPLES = {1: "u", 2: "i", 3: "f"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


def header(path: str) -> dict:
    """What a file says of itself: tags with their values, the byte order, and the kind of its samples."""
    with open(path, "rb") as f:
        start = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or struct.unpack(order + "H", start[2:4])[0] != 42:
            raise ValueError(f"{path} is no TIFF file of the plain kind")
        f.seek(struct.unpack(order + "I", start[4:])[0])
        fields = [f.read(12) for _ in range(struct.unpack(order + "H", f.read(2))[0])]
        tags: dict = {}
        for field in fields:
            tag, kind, n = struct.unpack(order + "HHI", field[:8])
            form = FIELDS.get(kind)
            if form is None:
                continue
            size = struct.calcsize(form) * n
            data = field[8 : 8 + size]
            if size > 4:
                f.seek(struct.unpack(order + "I", field[8:])[0])
                data = f.read(size)
            tags[tag] = data.rstrip(b"\0").decode() if form == "s" else struct.unpack(f"{order}{n}{form}", data)
    one = lambda tag, other: tags.get(tag, (other,))[0]
    if one(BANDS, 1) != 1 or one(PREDICTOR, 1) != 1 or one(COMPRESSION, PLAIN) not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"{path} has several bands, or a compression that isn't read")
    return {"tags": tags, "sample": f"{order}{SAMPLES[one(FORMAT, 1)]}{one(BITS, 8) // 8}", "compression": one(COMPRESSION, PLAIN), "height": one(HEIGHT, 0), "width": one(WIDTH, 0)}


def blocks(known: dict) -> list[tuple[int, int, int, int, int, int]]:
    """(row, col, height, width, offset, bytes) of a file's strips or tiles; the last ones of tiles may reach beyond the raster."""
    tags, height, width = known["tags"], known["height"], known["width"]
    if TILE_OFFSETS in tags:
        h, w = tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]
        places = [(r, k, h, w) for r in range(0, height, h) for k in range(0, width, w)]
        return [(*p, o, n) for p, o, n in zip(places, tags[TILE_OFFSETS], tags[TILE_SIZES])]
    rows = min(height, tags.get(STRIP_ROWS, (height,))[0])
    return [(r, 0, min(rows, height - r), width, o, n) for r, o, n in zip(range(0, height, rows), tags[OFFSETS], tags[SIZES])]


def lzw(data: bytes) -> bytes:
    """The bytes behind variable-width codes, most significant bit first, as the format has them: 256 clears the table, 257 ends."""
    table, out, width, at, before = [bytes([i]) for i in range(256)] + [b"", b""], [], 9, 0, b""
    bits = int.from_bytes(data, "big")
    total = 8 * len(data)
    while at + width <= total:
        code = (bits >> (total - at - width)) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before:
            table.append(before + word[:1])
        before = word
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


@dataclass
class Strip(InputPartition):
    path: str
    block: tuple


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.window = sorted(options["path"].split(",")), {"row": [-1, 1 << 62], "col": [-1, 1 << 62]}
        for name, bound in self.window.items():
            bound[0], bound[1] = int(options.get(f"{name}_from", bound[0])), int(options.get(f"{name}_to", bound[1]))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the window; Spark still looks at every row."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.window and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.window[name][0] = max(self.window[name][0], f.value + isinstance(f, GreaterThan))
            if name in self.window and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.window[name][1] = min(self.window[name][1], f.value - isinstance(f, LessThan))
            yield f

    def _meets(self, row: int, col: int, height: int, width: int) -> bool:
        (top, bottom), (left, right) = self.window["row"], self.window["col"]
        return row <= bottom and row + height > top and col <= right and col + width > left

    def partitions(self) -> list[Strip]:
        return [Strip(path, b) for path in self.paths for b in blocks(header(path)) if self._meets(*b[:4])]

    def read(self, partition: Strip) -> Iterator[pa.RecordBatch]:
        known = header(partition.path)
        row, col, height, width, offset, size = partition.block
        with open(partition.path, "rb") as f:
            f.seek(offset)
            data = f.read(size)
        data = {PLAIN: lambda d: d, LZW: lzw}.get(known["compression"], zlib.decompress)(data)
        values = np.frombuffer(data, dtype=known["sample"], count=height * width).astype(np.float64)
        rows, cols = row + np.repeat(np.arange(height), width), col + np.tile(np.arange(width), height)
        (top, bottom), (left, right) = self.window["row"], self.window["col"]
        inside = (rows < known["height"]) & (cols < known["width"]) & (rows >= top) & (rows <= bottom) & (cols >= left) & (cols <= right)
        none = np.isnan(values)
        if MISSING in known["tags"]:
            none |= values == float(np.dtype(known["sample"]).type(float(known["tags"][MISSING])))
        at = np.flatnonzero(inside)
        for some in np.array_split(at, max(1, len(at) // 100_000)):
            columns = [pa.array(rows[some], pa.int32()), pa.array(cols[some], pa.int32()), pa.array(values[some], pa.float64(), mask=none[some])]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(some), pa.string()), *columns], ["file", "row", "col", "value"])


class Raster(DataSource):
    """Options: path (files, joined by commas) and row_from, row_to, col_from, col_to, the last ones included."""

    @classmethod
    def name(cls) -> str:
        return "tessella_tiff"

    def schema(self) -> str:
        return "file string, row int, col int, value double"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)


def read_tiff(spark: SparkSession, paths: list[str], **window: int) -> DataFrame:
    """file, row, col and value of the pixels of some files, within ``window`` (row_from, row_to, col_from, col_to) of each."""
    ship(spark)
    spark.dataSource.register(Raster)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(Raster.name()).options(path=",".join(paths), **{k: str(v) for k, v in window.items()}).load()


def corner_of(path: str) -> tuple[float, float, float, float]:
    """left, top, and a pixel's width and height, as a file has them."""
    tags = header(path)["tags"]
    return tags[PLACE][3], tags[PLACE][4], tags[PIXEL][0], tags[PIXEL][1]


def encoded(values: np.ndarray, missing: float, corner: tuple[float, float, float, float], strip: int = 16) -> bytes:
    """A file of 32-bit values in compressed strips of some rows; nan is written as ``missing``."""
    height, width = values.shape
    filled = np.where(np.isnan(values), missing, values).astype("<f4")
    parts = [zlib.compress(filled[r : r + strip].tobytes()) for r in range(0, height, strip)]
    text = f"{missing:g}".encode() + b"\0"
    longs = {OFFSETS: [], SIZES: [len(p) for p in parts]}
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32]), (COMPRESSION, 3, [DEFLATE]), (262, 3, [1]), (OFFSETS, 4, [0] * len(parts)), (BANDS, 3, [1]),
        (STRIP_ROWS, 4, [strip]), (SIZES, 4, longs[SIZES]), (FORMAT, 3, [3]), (PIXEL, 12, [corner[2], corner[3], 0.0]),
        (PLACE, 12, [0.0, 0.0, 0.0, corner[0], corner[1], 0.0]), (MISSING, 2, text),
    ]
    pack = lambda kind, v: bytes(v) if kind == 2 else struct.pack(f"<{len(v)}{FIELDS[kind]}", *v)
    after = 8 + 2 + 12 * len(fields) + 4
    for _ in range(2):  # the second time offsets are known
        table, rest = b"", b""
        for tag, kind, v in fields:
            v = longs[OFFSETS] or v if tag == OFFSETS else v
            data = pack(kind, v)
            if len(data) > 4:
                place, rest = struct.pack("<I", after + len(rest)), rest + data + b"\0" * (len(data) % 2)
            else:
                place = data.ljust(4, b"\0")
            table += struct.pack("<HHI", tag, kind, len(v)) + place
        begin = after + len(rest)
        longs[OFFSETS] = [begin + sum(longs[SIZES][:k]) for k in range(len(parts))]
    return struct.pack("<2sHIH", b"II", 42, 8, len(fields)) + table + struct.pack("<I", 0) + rest + b"".join(parts)


def write_tiles(cells: DataFrame, folder: str, corner: tuple[float, float, float, float], tile: int = 512, missing: float = -9999.0) -> DataFrame:
    """A file for each tile of a raster (row, col, value) that has pixels, in a folder that all machines share: path, top, left.

    A task writes a tile beside its name and renames it, so a task that is repeated leaves one whole file. ``corner``: left, top and a pixel's size.
    """
    ship(cells.sparkSession)
    at = lambda name: F.floor(F.col(name) / tile).cast("int")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from tessella.sources.rasters import encoded as coded

        top, left = int(frame["tr"].iloc[0]) * tile, int(frame["tc"].iloc[0]) * tile
        rows, cols = frame["row"].to_numpy() - top, frame["col"].to_numpy() - left
        values = np.full((int(rows.max()) + 1, int(cols.max()) + 1), np.nan)
        values[rows, cols] = frame["value"].astype(float)
        own = (corner[0] + left * corner[2], corner[1] - top * corner[3], corner[2], corner[3])
        path = os.path.join(folder, f"tile-{top}-{left}.tif")
        with open(f"{path}.tmp{os.getpid()}", "wb") as f:
            f.write(coded(values, missing, own))
        os.replace(f.name, path)
        return pd.DataFrame({"path": [path], "top": [top], "left": [left]})

    dealt = cells.select("row", "col", "value", at("row").alias("tr"), at("col").alias("tc"))
    return dealt.groupBy("tr", "tc").applyInPandas(run, "path string, top int, left int")
