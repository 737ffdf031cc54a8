"""Sources and sinks on fixtures: geometry files, pages and chunks that fail now and then, downloads, versions and weights."""

import json
import os
import struct

import pytest

from tessella.operators import raster
from tessella.sources import features, sinks


def test_geometry_files(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 0.0]]
    kinds = [("Polygon", [ring]), ("LineString", ring[:2]), ("Point", [1.0, 2.0])]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": t, "n": i}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(kinds)]}, indent=1))
    rows = {r["name"]: r for r in features.read_geojson(spark, str(tmp_path / "a.geojson"), {"name": "string", "n": "int"}).collect()}
    assert [(p["x"], p["y"]) for p in rows["Polygon"]["corners"]] == [(0, 0), (4, 0), (4, 3)] and rows["Point"]["n"] == 2
    assert len(rows["LineString"]["corners"]) == 2 and [tuple(p) for p in rows["Point"]["corners"]] == [(1.0, 2.0)]
    line = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 0, 1, 2, 3)
    df = spark.createDataFrame([(1, bytearray(features.binary_of([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]))), (2, bytearray(line)), (3, None)], "id int, g binary")
    back = features.to_wkb(features.parse_wkb(df, "g").where("id = 1"), "corners").collect()[0]
    assert bytes(back["wkb"]) == bytes(back["g"])
    assert {r["id"]: r["corners"] and len(r["corners"]) for r in features.parse_wkb(df, "g").collect()} == {1: 3, 2: 2, 3: None}


def test_cached_tables_are_built_once(spark, tmp_path):
    built = []
    make = lambda: built.append(1) or spark.range(3)
    assert [features.cached(spark, str(tmp_path / "t"), make).count() for _ in range(2)] == [3, 3] and len(built) == 1


def test_pages_until_the_last(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(offset, page):
        mark = os.path.join(folder, f"tried-{offset}")
        if offset % 20 == 0 and not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("503")
        rows = [{"id": i, "name": None if i % 2 else f"n{i}"} for i in range(offset, min(offset + page, 57))]
        return rows, offset + page < 57

    got = features.paged(spark, fetch, 10, "id bigint, name string", block=4, wait=0.0)
    assert sorted((r["id"], r["name"]) for r in got.collect()) == sorted((i, None if i % 2 else f"n{i}") for i in range(57))


def test_geocoding_in_chunks(spark):
    def client(rows):
        if any(r["id"] == 13 for r in rows):
            raise ConnectionError
        assert len(rows) <= 4
        return [{"id": r["id"], "x": r["id"] / 2} for r in rows]

    df = spark.range(20).coalesce(1)
    got = features.geocoded(df, client, "id bigint, x double", chunk=4, wait=0.0, failed="lost").collect()
    assert sorted(r["id"] for r in got if not r["lost"]) == [i for i in range(20) if i // 4 != 3]
    assert sorted((r["id"], r["x"]) for r in got if r["lost"]) == [(i, None) for i in range(12, 16)]
    with pytest.raises(Exception, match="ConnectionError"):
        features.geocoded(df, client, "id bigint, x double", chunk=4, wait=0.0).collect()


def closed(part):
    return [[*ring, ring[0]] for ring in part]


def test_shapes_of_several_rings_and_parts(spark, tmp_path):
    outer, hole, other = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]], [[2.0, 2.0], [2.0, 4.0], [4.0, 4.0]], [[20.0, 0.0], [22.0, 0.0], [20.0, 3.0]]
    kinds = {
        "Point": [1.0, 2.0], "MultiPoint": [[1.0, 2.0], [3.0, 4.0]], "LineString": outer, "MultiLineString": [outer, hole],
        "Polygon": closed([outer, hole]), "MultiPolygon": [closed([outer, hole]), closed([other])],
    }
    want = {
        "Point": [[[[1.0, 2.0]]]], "MultiPoint": [[[[1.0, 2.0]]], [[[3.0, 4.0]]]], "LineString": [[outer]], "MultiLineString": [[outer], [hole]],
        "Polygon": [[outer, hole]], "MultiPolygon": [[outer, hole], [other]],
    }
    rows = [{"type": "Feature", "properties": {"n": i}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(kinds.items())] + [{"type": "Feature", "properties": {"n": 9}, "geometry": None}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": rows}, indent=1))
    (tmp_path / "b.geojsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    plain = lambda parts: parts and [[[[p["x"], p["y"]] for p in ring] for ring in part] for part in parts]
    for read in (features.read_geojson(spark, str(tmp_path / "a.geojson"), {"n": "int"}), features.read_geojson(spark, str(tmp_path / "b.geojsonl"), {"n": "int"}, by_line=True)):
        assert {r["kind"]: plain(r["parts"]) for r in read.collect()} == want | {None: None}
    back = features.parse_wkb_shapes(features.shapes_to_wkb(read).drop("parts", "kind"), "wkb").collect()
    assert {r["kind"]: plain(r["parts"]) for r in back} == want | {None: None}
    assert all(r["wkb"] is None or features.binary_of_shape(features.shape_of(bytes(r["wkb"]))) == bytes(r["wkb"]) for r in back)
    rows.append({"type": "Feature", "properties": {"n": 7}, "geometry": {"type": "GeometryCollection", "geometries": []}})
    (tmp_path / "c.geojson").write_text(json.dumps({"features": rows}))
    with pytest.raises(Exception, match="GeometryCollection"):
        features.read_geojson(spark, str(tmp_path / "c.geojson"), {"n": "int"}).collect()


def test_binary_geometries_of_other_makes():
    # big-endian, with heights; with the number of a reference system; collections and several rings raise
    high = struct.pack(">BII", 0, 1002, 2) + struct.pack(">6d", 1, 2, 9, 3, 4, 9)
    assert features.shape_of(high) == {"kind": "LineString", "parts": [[[{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}]]]}
    known = struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 5, 6)
    assert features.corners_of(known) == [{"x": 5.0, "y": 6.0}]
    measured = struct.pack("<BI4d", 1, 3001, 5, 6, 7, 8)
    assert features.corners_of(measured) == [{"x": 5.0, "y": 6.0}]
    with pytest.raises(ValueError):
        features.shape_of(struct.pack("<BII", 1, 7, 0))
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 2.0}]
    with pytest.raises(ValueError):
        features.corners_of(features.binary_of_shape({"kind": "Polygon", "parts": [[ring, ring]]}))


def test_downloads_and_coverage(spark, tmp_path):
    (tmp_path / "there.bin").write_bytes(b"12345")
    data = {"u/a.bin": b"abc", "u/b.bin": b"toolong", "u/there.bin": b"other"}
    got = features.download(spark, [("u/a.bin", 3), ("u/b.bin", 3), ("u/there.bin", 5)], data.__getitem__, str(tmp_path)).collect()
    assert {r["url"]: r["state"] for r in got} == {"u/a.bin": "fetched", "u/b.bin": "failed", "u/there.bin": "there"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "there.bin"]
    cells = features.coverage(spark, (0.0, 0.0, 5.0, 3.0), 1.0, lambda x, y, h, w: [[(y - i) * 10 + x + j for j in range(w)] for i in range(h)], tile=2, nodata=13.0).collect()
    assert {(r["row"], r["col"]): r["value"] for r in cells} == {(i, j): None if (3 - i) * 10 + j == 13 else (3 - i) * 10.0 + j for i in range(3) for j in range(5)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, float("nan"), "b"), (3, None, "a")], "id int, p double, city string")
    sinks.write_by(df, str(tmp_path / "by"), ["city"])
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.name.startswith("city")) == ["city=a", "city=b"]
    for _ in range(2):
        sinks.append_csv(df.select("id"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 6
    for stamp in ("1", "2", "3"):
        sinks.write_predictions(df, str(tmp_path / "out"), stamp, keep=2)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["predictions-2", "predictions-3"]
    assert sorted((r["id"], r["p"]) for r in spark.read.csv(str(tmp_path / "out/predictions-3"), header=True).collect()) == [("1", "0.500000"), ("2", None), ("3", None)]
    layers = raster.network(1, 3)
    sinks.save_weights(spark, layers, str(tmp_path / "net"), epoch=4, seed=3)
    back, state = sinks.load_weights(spark, str(tmp_path / "net"))
    assert state == {"epoch": 4, "seed": 3} and all((a["weight"] == b["weight"]).all() and a["dilation"] == b["dilation"] for a, b in zip(layers, back))


def test_tried_gives_up():
    with pytest.raises(ConnectionError):
        features.tried(lambda: (_ for _ in ()).throw(ConnectionError()), 2, 0.0)


def test_the_newest_of_several_files(spark, tmp_path):
    from tessella.sources import readers

    for n, stamp in (("b", 2000), ("c", 3000), ("a", 1000)):
        spark.createDataFrame([(n, 1)], "name string, v int").coalesce(1).write.parquet(str(tmp_path / n))
        for path in (tmp_path / n).glob("*.parquet"):
            os.utime(path, (stamp, stamp))
    assert [r["name"] for r in readers.newest(spark, str(tmp_path / "*")).collect()] == ["c"]


def test_shapes_at_once_are_those_one_by_one():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    ring = lambda: [{"x": float(x), "y": float(y)} for x, y in rng.normal(size=(rng.integers(1, 7), 2))]
    shapes = [None, {"kind": "MultiPolygon", "parts": []}, {"kind": "Polygon", "parts": [[]]}]
    shapes += [{"kind": "Polygon" if i % 3 else "MultiPolygon", "parts": [[ring() for _ in range(rng.integers(0, 4))] for _ in range(rng.integers(1, 4))]} for i in range(60)]
    shapes = [shapes[i] for i in rng.permutation(len(shapes))] + [None]
    kind = pa.struct([("kind", pa.string()), ("parts", features._PARTS)])
    for some in (shapes, shapes[:1], [None], []):
        column = pa.array([None, *some], kind).slice(1)
        told = features.converted_column(column, pa.binary(), "binary_of_shape")
        assert told.to_pylist() == [s and features.binary_of_shape(s) for s in some]
        back = features.converted_column(told, kind, "shape_of")
        assert back.type == kind and back.to_pylist() == [b and features.shape_of(b) for b in told.to_pylist()]
    made = features._polygons_to_wkb(pa.array([s for s in shapes if s], kind))
    assert made is not None and features._polygons_of_wkb(made) is not None
    point = features.binary_of_shape({"kind": "Point", "parts": [[[{"x": 1.0, "y": 2.0}]]]})
    high = bytes([0]) + struct.pack(">II", 3, 1) + struct.pack(">I", 2) + struct.pack(">4d", 0, 1, 0, 1)
    mixed = pa.array([point, made[0].as_py(), high], pa.binary())
    assert features.converted_column(mixed, kind, "shape_of").to_pylist() == [features.shape_of(b) for b in mixed.to_pylist()]
    with pytest.raises(struct.error):
        features.converted_column(pa.array([made[1].as_py()[:-3] if len(made[1].as_py()) > 12 else b"\x01\x06\x00\x00\x00\x01\x00\x00\x00"], pa.binary()), kind, "shape_of")
