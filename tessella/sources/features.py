"""Geometry files, services with pages or chunks behind a client that the caller gives, and files fetched side by side.

No function here opens a connection by itself: ``fetch`` or ``client`` is a picklable function, so tests run on fixtures.
"""

from __future__ import annotations

import os
import struct
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import ship

_CORNERS = "array<struct<x:double,y:double>>"
# Numbers of well-known-binary kinds, and the names of kinds in feature files.
WKB_KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def read_geojson(spark: SparkSession, path: str, properties: dict[str, str], by_line: bool = False) -> DataFrame:
    """One row per feature: its ``properties`` (name and type), ``kind``, ``parts`` (see ``operators.shapes``; a line is a part of one
    ring, a point one of one corner) and ``corners``, those of the first part's first ring.

    A file is one collection, or, ``by_line``, holds a feature on each line and can be read by many tasks. Rings are closed in the file; the
    repeated last corner is left out. A feature without a geometry has nulls; a geometry collection or an unknown kind is an error.
    """
    fields = ",".join(f"`{n}`:{t}" for n, t in properties.items())
    one = f"struct<properties:struct<{fields}>,geometry:struct<type:string,coordinates:string>>"
    if by_line:
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", one).alias("f"))
    else:
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<features:array<{one}>>").alias("f"))
        rows = text.select(F.explode("f.features").alias("f"))
    rows = rows.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("_c"))
    deep = lambda n: F.from_json("_c", "array<" * n + "double" + ">" * n)
    open_ring = lambda ring: F.slice(ring, 1, F.greatest(F.lit(0), F.size(ring) - 1))
    closed = lambda part: F.transform(part, open_ring)
    known = {
        "Point": F.array(F.array(F.array(deep(1)))), "MultiPoint": F.transform(deep(2), lambda p: F.array(F.array(p))),
        "LineString": F.array(F.array(deep(2))), "MultiLineString": F.transform(deep(3), lambda line: F.array(line)),
        "Polygon": F.array(closed(deep(3))), "MultiPolygon": F.transform(deep(4), closed),
    }
    places = F.when(F.col("kind").isNull(), None)
    for kind, value in known.items():
        places = places.when(F.col("kind") == kind, value)
    unknown = F.raise_error(F.concat(F.lit("geometry of kind "), F.col("kind"))).cast("array<array<array<array<double>>>>")
    parts = F.transform(places.otherwise(unknown), lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))))
    return rows.withColumn("parts", parts).withColumn("corners", F.get(F.get("parts", 0), 0)).drop("_c")


def _wkb(data: bytes, at: int) -> tuple[str, list, int]:
    """Kind and parts of the geometry that starts at a byte, and where it ends. Heights and measures are left out."""
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5 + 4 * bool(code & 0x20000000)  # the number of a reference system
    more = bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[(code & 0xFFFF) // 1000 % 4]
    kind = WKB_KINDS.get((code & 0xFFFF) % 1000)
    if kind is None:
        raise ValueError(f"geometry of type {code}")
    width = 2 + more

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def corners(n: int) -> list[dict]:
        nonlocal at
        values = struct.unpack_from(f"{order}{width * n}d", data, at)
        at += 8 * width * n
        return [{"x": x, "y": y} for x, y in zip(values[::width], values[1::width])]

    if kind == "Point":
        return kind, [[corners(1)]], at
    if kind == "LineString":
        return kind, [[corners(number())]], at
    if kind == "Polygon":
        return kind, [[corners(number())[:-1] for _ in range(number())]], at
    parts = []
    for _ in range(number()):
        _, own, at = _wkb(data, at)
        parts += own
    return kind, parts, at


def shape_of(data: bytes) -> dict:
    """Kind and parts of a well-known-binary geometry; kinds that have no parts raise an error."""
    kind, parts, _ = _wkb(data, 0)
    return {"kind": kind, "parts": parts}


def corners_of(data: bytes) -> list[dict]:
    """Points of a well-known-binary point, line or polygon of one ring (without the repeated last corner); others raise an error."""
    kind, parts, _ = _wkb(data, 0)
    if len(parts) != 1 or len(parts[0]) != 1:
        raise ValueError(f"{kind} of {len(parts)} parts and {sum(map(len, parts))} rings: read it as a shape")
    return parts[0][0]


def binary_of_shape(shape: dict) -> bytes:
    """A shape in well-known binary: of the kind it has, or the one for several parts if it has several."""
    kind, parts = shape["kind"].removeprefix("Multi"), shape["parts"]
    code = {name: n for n, name in WKB_KINDS.items()}
    pairs = lambda points: b"".join(struct.pack("<dd", p["x"], p["y"]) for p in points)

    def one(part: list) -> bytes:
        head = struct.pack("<BI", 1, code[kind])
        if kind == "Point":
            return head + pairs(part[0])
        if kind == "LineString":
            return head + struct.pack("<I", len(part[0])) + pairs(part[0])
        return head + struct.pack("<I", len(part)) + b"".join(struct.pack("<I", len(ring) + 1) + pairs([*ring, ring[0]]) for ring in part)

    if len(parts) == 1 and not shape["kind"].startswith("Multi"):
        return one(parts[0])
    return struct.pack("<BII", 1, code["Multi" + kind], len(parts)) + b"".join(map(one, parts))


def binary_of(points: list[dict]) -> bytes:
    """A polygon of these corners in well-known binary."""
    return binary_of_shape({"kind": "Polygon", "parts": [[points]]})


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins and ends (from 0 on), and what they hold one after the other."""
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0], column.values.slice(at[0], at[-1] - at[0])


def _at(begin: np.ndarray, size: int) -> np.ndarray:
    """Places of ``size`` bytes from each of ``begin`` on."""
    return begin[:, None] + np.arange(size)


def _words(values: np.ndarray) -> np.ndarray:
    return values.astype("<u4")[:, None].view(np.uint8)


def _behind(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums of ``sizes``."""
    return np.concatenate([[0], np.cumsum(sizes)])


def _polygons_to_wkb(shapes: pa.Array) -> pa.Array | None:
    """Shapes without nulls in well-known binary, if all are polygons or several of them and all rings have corners."""
    kind, parts = shapes.flatten()
    kinds = set(kind.unique().to_pylist())
    if parts.null_count or not kinds <= {"Polygon", "MultiPolygon"}:
        return None
    part_at, rings = _lists(parts)
    if rings.null_count:
        return None
    ring_at, points_of = _lists(rings)
    if points_of.null_count:
        return None
    point_at, points = _lists(points_of)
    n_points = np.diff(point_at)
    x, y = (v for v in points.flatten())
    if points.null_count or x.null_count or y.null_count or (n_points == 0).any():
        return None
    n_parts = np.diff(part_at)
    multi = (n_parts != 1) | np.array([k == "MultiPolygon" for k in kind.to_pylist()], dtype=bool)
    # sizes and places from the rings up to the shapes
    part_size = 9 + np.diff(_behind(4 + 16 * (n_points + 1))[ring_at])
    row_end = np.cumsum(np.diff(_behind(part_size)[part_at]) + 9 * multi)
    if len(row_end) and row_end[-1] >= 2**31:
        return None
    part_row = np.repeat(np.arange(len(n_parts)), n_parts)
    part_begin = _behind(part_size)[:-1] + 9 * np.cumsum(multi)[part_row]
    ring_part = np.repeat(np.arange(len(part_size)), np.diff(ring_at))
    ring_begin = _behind(4 + 16 * (n_points + 1))[:-1] + 9 * (ring_part + 1) + 9 * np.cumsum(multi)[part_row][ring_part]
    out = np.zeros(row_end[-1] if len(row_end) else 0, dtype=np.uint8)
    row_begin = _behind(np.diff(_behind(part_size)[part_at]) + 9 * multi)[:-1]
    for begin, code, n in ((row_begin[multi], 6, n_parts[multi]), (part_begin, 3, np.diff(ring_at))):
        out[begin] = 1
        out[_at(begin + 1, 4)] = _words(np.full(len(begin), code))
        out[_at(begin + 5, 4)] = _words(n)
    out[_at(ring_begin, 4)] = _words(n_points + 1)
    places = np.stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)], axis=1).astype("<f8").view(np.uint8).reshape(-1, 16)
    ring = np.repeat(np.arange(len(n_points)), n_points)
    out[_at(ring_begin[ring] + 4 + 16 * (np.arange(len(ring)) - point_at[ring]), 16)] = places
    out[_at(ring_begin + 4 + 16 * n_points, 16)] = places[point_at[:-1]]
    offsets = np.concatenate([[0], row_end]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n_parts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _polygons_of_wkb(column: pa.Array) -> pa.Array | None:
    """Shapes of binaries without nulls, if all are polygons or several of them in the plain form (low bytes first, two dimensions, no reference system)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or (np.diff(offsets) < 9).any():
        return None
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    end = offsets[1:]
    number = lambda at: np.ascontiguousarray(data[_at(at, 4)]).view("<u4").ravel().astype(np.int64)
    code = number(offsets[:-1] + 1)
    if (data[offsets[:-1]] != 1).any() or not np.isin(code, (3, 6)).all():
        return None
    multi = code == 6
    at = offsets[:-1] + 9 * multi
    n_parts = np.where(multi, number(offsets[:-1] + 5), 1)
    n_rings, found = [], []
    for p in range(int(n_parts.max())):  # a step for each number of a part and of a ring, all shapes at once
        rows = np.flatnonzero(n_parts > p)
        if (at[rows] + 9 > end[rows]).any() or (data[at[rows]] != 1).any() or (number(at[rows] + 1) != 3).any():
            return None
        rings = number(at[rows] + 5)
        at[rows] += 9
        n_rings.append((rows, np.full(len(rows), p), rings))
        for r in range(int(rings.max(initial=0))):
            some = rows[rings > r]
            if (at[some] + 4 > end[some]).any():
                return None
            n = number(at[some])
            found.append((some, np.full(len(some), p), np.full(len(some), r), at[some] + 4, n))
            at[some] += 4 + 16 * n
            if (at[some] > end[some]).any():
                return None
    row, part, rings = (np.concatenate(v) for v in zip(*n_rings)) if n_rings else np.zeros((3, 0), np.int64)
    rings = rings[np.lexsort((part, row))]
    row, part, ring, begin, n = (np.concatenate(v) for v in zip(*found)) if found else np.zeros((5, 0), np.int64)
    order = np.lexsort((ring, part, row))
    begin, n = begin[order], np.maximum(n[order] - 1, 0)  # without the repeated last corner
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(which)) - _behind(n)[which]
    places = np.ascontiguousarray(data[_at(begin[which] + 16 * step, 16)]).view("<f8").reshape(-1, 2)
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(places[:, k])) for k in (0, 1)], ["x", "y"])
    nested = points
    for sizes in (n, rings, n_parts):
        nested = pa.ListArray.from_arrays(pa.array(_behind(sizes).astype(np.int32)), nested)
    kinds = pa.array(["Polygon", "MultiPolygon"]).take(pa.array(multi.astype(np.int32)))
    return pa.StructArray.from_arrays([kinds, nested.cast(_PARTS)], ["kind", "parts"])


#: What turns many values at once, where they are of the commonest forms.
_AT_ONCE = {"binary_of_shape": _polygons_to_wkb, "shape_of": _polygons_of_wkb}


def converted_column(column: pa.Array, arrow: pa.DataType, name: str) -> pa.Array:
    """Each value turned by the function of this name: all at once if that can be, else one by one; nulls stay."""
    valid = column.is_valid()
    if name in _AT_ONCE and (made := _AT_ONCE[name](column.filter(valid))) is not None:
        there = valid.to_numpy(zero_copy_only=False)
        return made.take(pa.array(np.cumsum(there) - 1, mask=~there)) if column.null_count else made
    convert = globals()[name]
    return pa.array([None if v is None else convert(v) for v in column.to_pylist()], arrow)


def _converted(df: DataFrame, column: str, result: str, kind: str, arrow: pa.DataType, name: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.sources import features as own

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, own.converted_column(batch.column(column), arrow, name)], [*batch.schema.names, result])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {result} {kind}")


_PLACE = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PARTS = pa.list_(pa.list_(pa.list_(_PLACE)))
_SHAPE = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"


def parse_wkb(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``corners`` of the binary geometries in ``column``, which have one part and one ring."""
    return _converted(df, column, "corners", _CORNERS, pa.list_(_PLACE), "corners_of")


def parse_wkb_shapes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``kind`` and ``parts`` of the binary geometries in ``column``, whatever parts and rings they have."""
    read = _converted(df, column, "_shape", _SHAPE, pa.struct([("kind", pa.string()), ("parts", _PARTS)]), "shape_of")
    return read.withColumns({"kind": F.col("_shape.kind"), "parts": F.col("_shape.parts")}).drop("_shape")


def to_wkb(df: DataFrame, column: str = "corners") -> DataFrame:
    """``df`` with ``wkb``, as parquet files with geometries hold them."""
    return _converted(df, column, "wkb", "binary", pa.binary(), "binary_of")


def shapes_to_wkb(df: DataFrame) -> DataFrame:
    """``df`` (with ``kind`` and ``parts``) with ``wkb``."""
    whole = F.when(F.col("parts").isNotNull(), F.struct("kind", F.col("parts").cast("array<array<array<struct<x:double,y:double>>>>").alias("parts")))
    return _converted(df.withColumn("_shape", whole), "_shape", "wkb", "binary", pa.binary(), "binary_of_shape").drop("_shape")


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written there first if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tried(call: Callable, tries: int, wait: float):
    """The call's result; on a ConnectionError it is repeated after wait, 2 * wait, 4 * wait ... seconds."""
    for k in range(tries):
        try:
            return call()
        except ConnectionError:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


def paged(spark: SparkSession, fetch: Callable[[int, int], tuple[list[dict], bool]], page: int, schema: str, block: int = 16, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """All features of a service: ``fetch(offset, page)`` gives rows and whether more follow. ``block`` pages are asked for side by side.

    Each block is written before the next one is asked for; the last block may ask for pages behind the end, which are empty.
    """
    from tessella.session import settle

    names = spark.createDataFrame([], schema).columns
    kind = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset in batch.column("id").to_pylist():
                rows, more = tried(lambda: fetch(offset * page, page), tries, wait)  # noqa: B023
                columns = [pa.array([r.get(n) for r in rows] + [None], t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([False] * len(rows) + [True]), pa.array([more] * (len(rows) + 1))], [*names, "_end", "_more"])

    out, start = None, 0
    while True:
        got = settle(spark.range(start, start + block, numPartitions=block).mapInArrow(run, schema + ", _end boolean, _more boolean"), "pages")
        rows = got.where("not _end").drop("_end", "_more")
        out = rows if out is None else out.unionByName(rows)
        if got.where("_end and not _more").limit(1).count():
            return out
        start += block


def geocoded(addresses: DataFrame, client: Callable[[list[dict]], list[dict]], schema: str, chunk: int = 500, tries: int = 3, wait: float = 1.0, failed: str | None = None) -> DataFrame:
    """What the client answers for each chunk of addresses.

    With ``failed``, the name of a new column, the addresses of a chunk that fails in all tries are rows of their own, true in that column,
    with those of the schema's columns that addresses have too; other rows are false there. Without it such a chunk raises an error.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = addresses.sparkSession.createDataFrame([], schema).schema
    types, names = [to_arrow_type(f.dataType) for f in kind.fields], kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk).to_pylist()
                lost = False
                try:
                    rows = tried(lambda: client(part), tries, wait)  # noqa: B023
                except ConnectionError:
                    if failed is None:
                        raise
                    rows, lost = part, True
                columns = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)]
                marks = [] if failed is None else [pa.array([lost] * len(rows), pa.bool_())]
                yield pa.RecordBatch.from_arrays([*columns, *marks], [*names, *([] if failed is None else [failed])])

    return addresses.mapInArrow(run, schema if failed is None else f"{schema}, `{failed}` boolean")


def download(spark: SparkSession, urls: list[tuple[str, int]], fetch: Callable[[str], bytes], folder: str, side_by_side: int = 4) -> DataFrame:
    """Files (url, expected size) fetched into a folder that all machines share: url, path, state (there, fetched or failed).

    A file of the expected size is left alone; others are written beside their name and renamed once their size is right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, size in zip(batch.column("url").to_pylist(), batch.column("size").to_pylist()):
                path = os.path.join(folder, os.path.basename(url))
                if os.path.exists(path) and os.path.getsize(path) == size:
                    out.append((url, path, "there"))
                    continue
                part = f"{path}.tmp{os.getpid()}"
                try:
                    data = tried(lambda: fetch(url), 3, 1.0)  # noqa: B023
                    with open(part, "wb") as f:
                        f.write(data)
                    if os.path.getsize(part) != size:
                        raise OSError("size")
                    os.replace(part, path)
                    out.append((url, path, "fetched"))
                except OSError:
                    if os.path.exists(part):
                        os.remove(part)
                    out.append((url, path, "failed"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["url", "path", "state"])

    wanted = spark.createDataFrame(urls, "url string, size bigint").repartition(side_by_side)
    return wanted.mapInArrow(run, "url string, path string, state string")


def coverage(spark: SparkSession, box: tuple[float, float, float, float], pixel: float, fetch: Callable[[float, float, int, int], list[list[float]]], tile: int = 256, nodata: float | None = None) -> DataFrame:
    """A raster service's values over a box as a long table (row, col, value): tiles are fetched side by side; ``fetch(x, y, height, width)``
    gives the rows of a tile from its upper left corner. Missing values are null."""
    minx, miny, maxx, maxy = box
    height, width = max(1, round((maxy - miny) / pixel)), max(1, round((maxx - minx) / pixel))
    tiles = [(r, c, min(tile, height - r), min(tile, width - c)) for r in range(0, height, tile) for c in range(0, width, tile)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                values = tried(lambda: fetch(minx + t["c"] * pixel, maxy - t["r"] * pixel, t["h"], t["w"]), 3, 1.0)  # noqa: B023
                cells = [(t["r"] + i, t["c"] + j, None if v == nodata else v) for i, line in enumerate(values) for j, v in enumerate(line)]
                kinds = (pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in cells], kind) for k, kind in enumerate(kinds)], ["row", "col", "value"])

    wanted = spark.createDataFrame(tiles, "r int, c int, h int, w int").repartition(min(len(tiles), 64))
    return wanted.mapInArrow(run, "row int, col int, value double")
