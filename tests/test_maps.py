"""Map layers as GeoPackages and shapefiles, read back and opened by other readers of the formats."""

import json
import math
import sqlite3
import struct
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.sources import grids, maps, sinks

SCHEMA = f"id int, name string, score double, good boolean, day date, at timestamp, cost decimal(9,2), tags array<int>, geom string, rings {G.RINGS}"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(x, y, s):
    return ring((x, y), (x, y + s), (x + s, y + s), (x + s, y))


def layer(spark):
    rows = [
        (1, "São \"Pé\"", 0.1, True, date(2020, 2, 3), datetime(2021, 1, 1, 2, 3, 4), Decimal("12.50"), [1, 2], "a", [square(0, 0, 4), square(1, 1, 1)[::-1]]),
        (2, None, None, None, None, None, None, None, None, [square(0, 0, 4), square(10, 0, 6), square(11, 1, 2)[::-1], square(1, 1, 1)[::-1]]),
        (3, "", -1e300, False, None, None, None, [], "b", None),
        (-4, "x" * 300, float("nan"), False, None, None, None, None, "b", []),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "top.gpkg")
    maps.write_map(layer(spark), path, crs="EPSG:31982", layer="top windows", order=["id"])
    assert [p.name for p in tmp_path.iterdir()] == ["top.gpkg"]
    db = sqlite3.connect(path)
    assert db.execute("pragma application_id").fetchone() == (0x47504B47,) and db.execute("pragma integrity_check").fetchone() == ("ok",)
    assert db.execute("select table_name, min_x, max_x, max_y, srs_id from gpkg_contents").fetchall() == [("top windows", 0.0, 16.0, 6.0, 31982)]
    assert db.execute("select column_name, geometry_type_name from gpkg_geometry_columns").fetchall() == [("geom_", "MULTIPOLYGON")]
    assert 'PARAMETER["central_meridian",-51.0]' in db.execute("select definition from gpkg_spatial_ref_sys where srs_id = 31982").fetchone()[0]
    got = db.execute('select id, name, score, good, day, at, cost, tags, geom from "top windows" order by fid').fetchall()
    assert [r[0] for r in got] == [-4, 1, 2, 3]
    assert got[1] == (1, "São \"Pé\"", 0.1, 1, "2020-02-03", "2021-01-01T02:03:04.000Z", 12.5, "[1,2]", "a") and got[2][1:] == (None,) * 8
    assert got[3][1:3] == ("", -1e300) and got[0][1:3] == ("x" * 300, None)
    blob = db.execute('select geom_ from "top windows" where id = 1').fetchone()[0]
    assert blob[:2] == b"GP" and struct.unpack_from("<i4d", blob, 4) == (31982, 0, 4, 0, 4)
    back = maps.read_geopackage(spark, path).select("*", G.area(F.col("rings")).alias("a")).collect()
    assert sorted((json.loads(r.props)["id"], r.kind, r.a, len(r.rings)) for r in back) == [(1, "Polygon", 15.0, 2), (2, "Polygon", 15.0, 2), (2, "Polygon", 32.0, 2)]
    with pytest.raises(FileExistsError):
        maps.write_map(layer(spark), path)
    maps.write_map(layer(spark).limit(1), path, mode="overwrite")
    assert maps.read_geopackage(spark, path, "layer").count() == 1


def test_shapefile(spark, tmp_path):
    path = str(tmp_path / "top.shp")
    rows = layer(spark).withColumnsRenamed({"score": "a_long_name_1", "cost": "a_long_name_2"})
    with pytest.raises(Exception, match="fields end at 254"):
        maps.write_map(rows, path)
    assert not list(tmp_path.iterdir())
    sinks.write_layer(rows, path, "shp", crs="EPSG:4326", order=["id"], truncate=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["top.cpg", "top.dbf", "top.prj", "top.shp", "top.shx"]
    raw, index = (tmp_path / "top.shp").read_bytes(), (tmp_path / "top.shx").read_bytes()
    assert struct.unpack(">i", raw[24:28])[0] * 2 == len(raw) and struct.unpack(">i", index[24:28])[0] * 2 == len(index)
    for k in range(4):  # the index leads to the records
        at, words = struct.unpack(">ii", index[100 + 8 * k : 108 + 8 * k])
        assert struct.unpack(">ii", raw[2 * at : 2 * at + 8]) == (k + 1, words)
    back = {r.fid: r for r in grids.read_shapefile(spark, path).select("*", G.area(F.col("rings")).alias("a")).collect()}
    assert {k: (r.a, len(r.rings)) for k, r in back.items()} == {1: (15.0, 2), 2: (47.0, 4)}
    assert json.loads(back[1].props) == {"id": 1, "name": "São \"Pé\"", "a_long_nam": 0.1, "good": True, "day": "2020-02-03", "at": "2021-01-01T02:03:04.000Z", "a_long_n_1": 12.5, "tags": "[1,2]", "geom": "a"}
    records = maps.from_dbf((tmp_path / "top.dbf").read_bytes())
    assert records[0]["name"] == "x" * 254 and records[0]["a_long_nam"] is None and records[3]["a_long_nam"] == -1e300 and records[3]["name"] is None
    assert set(records[2].values()) == {2, None}


@pytest.mark.parametrize("kind", ["gpkg", "shp"])
def test_parts_hold_every_row(spark, tmp_path, kind):
    boxes = spark.range(0, 15000, numPartitions=3).selectExpr("id", "id % 100 as x0", "id % 100 + 1 as x1", "0 as y0", "id + 1 as y1")
    rows = boxes.select("id", G.box_rings("x0", "x1", "y0", "y1").alias("rings"))
    maps.write_map(rows, str(tmp_path / "all"), kind, part_rows=4608)
    assert len(list((tmp_path / "all").glob(f"*.{kind}"))) == 6 and not list((tmp_path / "all").glob("_*"))
    read = maps.read_geopackage if kind == "gpkg" else grids.read_shapefile
    got = read(spark, str(tmp_path / "all")).select(F.get_json_object("props", "$.id").cast("long").alias("id"), G.area(F.col("rings")).alias("a"))
    assert got.where("a = id + 1").select("id").distinct().count() == 15000 == got.count()
    maps.write_map(rows.limit(10), str(tmp_path / "all"), kind, mode="overwrite")
    maps.write_map(rows.limit(7), str(tmp_path / "all"), kind, mode="append")
    assert read(spark, str(tmp_path / "all")).count() == 17
    with pytest.raises(Exception, match="larger than one file"):
        maps.write_map(rows, str(tmp_path / f"one.{kind}"), part_rows=512)
    assert [p.name for p in tmp_path.iterdir()] == ["all"]


@pytest.mark.parametrize("kind", ["gpkg", "shp"])
def test_lines_and_points(spark, tmp_path, kind):
    read = maps.read_geopackage if kind == "gpkg" else grids.read_shapefile
    rows = spark.createDataFrame([(1, [ring((0, 0), (3, 4))]), (2, [ring((5, 5), (6, 6), (7, 5)), ring((0, 1), (1, 0))])], f"k int, rings {G.RINGS}")
    for geometry, want in (("line", [("LineString", 2), ("LineString", 2), ("LineString", 3)]), ("point", [("Point", 1)] * 7)):
        path = str(tmp_path / f"{geometry}.{kind}")
        maps.write_map(rows, path, geometry=geometry)
        assert sorted((r.kind, len(r.rings[0])) for r in read(spark, path).collect()) == want
    single = str(tmp_path / f"single.{kind}")
    maps.write_map(rows.select("k", F.array(F.array(F.col("rings")[0][0])).alias("rings")), single, geometry="point")
    assert sorted((r.rings[0][0].x, r.rings[0][0].y) for r in read(spark, single).collect()) == [(0, 0), (5, 5)]


def test_calls_that_are_refused(spark, tmp_path):
    some = layer(spark)
    for path, options in ((str(tmp_path / "a.shp"), {"kind": "gpkg"}), (str(tmp_path / "a"), {}), (str(tmp_path / "a.gpkg"), {"geometry": "solid"}), (str(tmp_path / "a.gpkg"), {"crs": "EPSG:1"}), (str(tmp_path / "a.gpkg"), {"mode": "append"})):
        with pytest.raises(ValueError):
            maps.write_map(some, path, **options)
    with pytest.raises(ValueError):
        maps.write_map(some.limit(0), str(tmp_path / "a.gpkg"))
    assert not list(Path(tmp_path).iterdir())


def test_binary_shapes_of_other_writers():
    """Heights, measures and the other byte order."""
    flat = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + b"".join(struct.pack(">2d", *p) for p in ((0, 0), (0, 1), (1, 1), (0, 0)))
    assert maps.from_wkb(flat)[0][0][1][0].tolist() == [[0, 0], [0, 1], [1, 1], [0, 0]]
    for code in (1001, 0x80000001):
        assert maps.from_wkb(struct.pack("<BI3d", 1, code, 1, 2, 9))[0][0][1][0].tolist() == [[1, 2]]
    many = struct.pack("<BII", 1, 3005, 1) + struct.pack("<BII", 1, 3002, 2) + struct.pack("<8d", 1, 2, 9, 9, 3, 4, 9, 9)
    assert maps.from_wkb(many)[0] == [("LineString", [pytest.approx(np.array([[1, 2], [3, 4]]))])] and maps.from_wkb(many)[1] == len(many)
    with pytest.raises(ValueError):
        maps.from_wkb(struct.pack("<BI", 1, 17))


def test_reference_systems_as_text():
    assert maps.crs_text("EPSG:4674").startswith('GEOGCS["EPSG:4674"') and math.isclose(float(maps.crs_text("EPSG:32633").split('"central_meridian",')[1].split("]")[0]), 15)
