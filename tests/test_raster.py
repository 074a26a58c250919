"""The raster source, and runs that start from their configuration alone."""

import json

import numpy as np
import pytest

from lodestone.__main__ import main
from lodestone.functions.geometry import Affine
from lodestone.sources import config, grids, raster

HEADER = """DatasetHeader Begin
  ByteOrder = {order}
  RasterInfo Begin
    CellType = IEEE4ByteReal
    NullCellValue = -99999
    CellInfo Begin
      Xdimension = 50
      Ydimension = 50
    CellInfo End
    NrOfLines = {h}
    NrOfCellsPerLine = {w}
    RegistrationCoord Begin
      Eastings = 600000
      Northings = 9300000
    RegistrationCoord End
    NrOfBands = {bands}
  RasterInfo End
DatasetHeader End
"""


def put(folder, name, bands, order="<"):
    bands = np.asarray(bands, dtype=np.float64)
    n, h, w = bands.shape
    (folder / name).write_bytes(np.moveaxis(bands, 0, 1).astype(f"{order}f4").tobytes())
    (folder / f"{name}.ers").write_text(HEADER.format(h=h, w=w, bands=n, order={"<": "LSBFirst", ">": "MSBFirst"}[order]))
    return str(folder / f"{name}.ers")


def values(df, *names):
    return {(r.r, r.c): tuple(r[n] for n in names or ("v",)) for r in df.collect()}


def test_rows_columns_and_bands(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(size=(2, 40, 30)), 3).astype(np.float32)
    a[0, 3, 4], a[1, 3, 5] = -99999, np.nan
    for order in "<>":
        path = put(tmp_path, f"two{ord(order)}", a, order)[:-4]
        options = {"width": 30, "height": 40, "bands": 2, "order": {"<": "little", ">": "big"}[order], "nodata": -99999}
        plain = lambda b, r, c: None if a[b, r, c] == -99999 or np.isnan(a[b, r, c]) else float(a[b, r, c])
        whole = raster.read_raster(spark, path, **options, part_bytes=1000)
        assert whole.rdd.getNumPartitions() > 5
        assert values(whole, "v1", "v2") == {(r, c): (plain(0, r, c), plain(1, r, c)) for r in range(40) for c in range(30)}
        for rows, cols in (((2, 6), (3, 9)), ((0, 40), (4, 5)), ((38, 99), (0, 30))):
            part = raster.read_raster(spark, path, **options, band=2, rows=f"{rows[0]}:{rows[1]}", cols=f"{cols[0]}:{cols[1]}")
            assert values(part) == {(r, c): (plain(1, r, c),) for r in range(rows[0], min(40, rows[1])) for c in range(*cols)}
        assert raster.read_raster(spark, path, **options, rows="7:7").count() == 0
    with pytest.raises(Exception, match="ends before"):
        raster.read_raster(spark, path, width=30, height=41, bands=2).count()
    with pytest.raises(Exception, match="width and height"):
        raster.read_raster(spark, path, width=30).count()


def test_a_crop_reads_fewer_bytes():
    read = lambda **o: sum(n for p in raster.RasterReader("x", raster.Layout.of({"width": 1000, "height": 1000} | o), 1 << 20).partitions() for _, n, *_ in raster.Layout.of({"width": 1000, "height": 1000} | o).ranges(*p.value))
    assert read() == 4_000_000 and read(rows="10:20") == 40_000 and read(rows="10:20", cols="5:15") == 400 and read(cols="0:900") == 4_000_000
    assert read(bands=3, band=2, cols="0:100") == 400_000


def test_headers_and_other_grids(spark, tmp_path):
    meta, options = raster.describe(HEADER.format(h=4, w=3, bands=1, order="LSBFirst"), "EPSG:32722")
    assert (meta.height, meta.width, meta.transform, meta.crs) == (4, 3, Affine(50, 0, 600000, 0, -50, 9300000), "EPSG:32722") and options["type"] == "IEEE4ByteReal"
    (tmp_path / "g.csv").write_text("a,b\n1,2\n3,x\n5,6\n")
    cells, meta = raster.load(spark, str(tmp_path / "g.csv"), rows=(1, 3), cols=(0, 2))
    assert values(cells) == {(0, 0): (3.0,), (0, 1): (None,), (1, 0): (5.0,), (1, 1): (6.0,)} and (meta.height, meta.width) == (2, 2) and meta.transform.f == 1


def test_a_run_from_its_configuration_alone(spark, tmp_path):
    rng = np.random.default_rng(3)
    places, (h, w) = [(4, 5), (14, 12), (20, 3)], (24, 30)
    a, b = rng.normal(size=(h, w)), rng.normal(size=(h, w))
    bump = np.outer([1, 3, 5, 2], [2, 6, 3, 1, 4])
    for x, y in places:
        a[y : y + 4, x : x + 5] += bump
        b[y : y + 4, x : x + 5] -= bump
    paths = {"A": put(tmp_path, "a", [a]), "B": put(tmp_path, "b", [b])}
    t = Affine(50, 0, 600000, 0, -50, 9300000)
    ring = lambda x, y: [list(t.to_map(r, c)) for r, c in ((y, x), (y + 4, x), (y + 4, x + 5), (y, x + 5), (y, x))]
    features = [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring(x, y)]}} for x, y in places]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    doc = {"name": "t", "grids": paths, "footprints": str(tmp_path / "f.geojson"), "window": [4, 5], "references": [1], "ks": [3], "top_k": 12, "analysis": "multivariate", "output": str(tmp_path / "out")}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert main([str(tmp_path / "c.json")]) == 0
    got = spark.read.option("header", True).csv(f"{tmp_path}/out/t/summary").first()
    assert int(got.n_hits) == 2
    put(tmp_path, "b", [b[:, :-1]])
    with pytest.raises(ValueError, match="doesn't match"):
        raster.load_all(spark, config.build(doc))
    assert grids.Meta(1, 1) != grids.Meta(1, 2)
