"""Geometry, sources, configuration, inference and streaming."""

import hashlib
import json
import struct
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions import names as N
from lodestone.operators import compare, inference, joins, linalg, ordering, overlay, windows
from lodestone.operators.graph import components
from lodestone.operators.joins import overlapping
from lodestone.operators.ranking import FUSIONS, block, fuse
from lodestone.operators.windows import circle_mask, resample, resize
from lodestone.sources import config, grids, sinks
from lodestone.streaming import score, window_counts

SQUARE = [[{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 4.0}, {"x": 4.0, "y": 4.0}, {"x": 4.0, "y": 0.0}], [{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 1.0}, {"x": 2.0, "y": 2.0}, {"x": 1.0, "y": 2.0}]]


def polygons(spark, rings=SQUARE):
    return spark.createDataFrame([(1, rings)], f"fid long, rings {G.RINGS}")


def test_area_with_hole(spark):
    p = polygons(spark)
    r = p.select(G.area(F.col("rings")).alias("a"), G.clip_area(F.col("rings"), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(2.0)).alias("c")).first()
    assert abs(r.a - 15) < 1e-12 and abs(r.c - 3) < 1e-12
    pts = G.ring_points(p, "fid")
    assert {x.ring: abs(x.signed_area) for x in G.shoelace_rows(pts, "fid").collect()} == {0: 16.0, 1: 1.0}


def test_points_in_polygon(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 1.0), (4, 3.5, 3.5)], "pid int, x double, y double")
    got = {r.pid: r.fid for r in G.first_containing(pts, polygons(spark), 2.0).collect()}
    assert got == {1: 1, 2: None, 3: None, 4: 1}


def test_projection(spark):
    g = G.Grid()
    lon, lat = np.array([-54.0, -51.0, -48.2]), np.array([-6.0, 0.0, -11.5])
    back = G.from_grid_arrays(g, *G.to_grid_arrays(g, lon, lat))
    assert np.allclose(back[0], lon, atol=1e-11) and np.allclose(back[1], lat, atol=1e-11)
    assert np.allclose(G.to_grid_arrays(g, np.array([-51.0]), np.array([0.0])), [[500000.0], [10000000.0]])
    there = G.from_geocentric(G.WGS84, *G.to_geocentric(G.WGS84, lon, lat))
    assert np.allclose(there[0], lon) and np.allclose(there[1], lat)


def test_resampling():
    g = np.add.outer(np.arange(20.0) * 3, np.arange(20.0))
    assert np.allclose(resample(g, 5, 6, 4, 4), g[5:9, 6:10])
    assert np.allclose(resample(resample(g, 0, 0, 20, 20, 180), 0, 0, 20, 20, 180), g)
    assert np.isnan(resample(g, 0, 0, 20, 20, 45)).any()
    assert np.allclose(resize(g, 20, 20), g) and resize(g, 10, 10).shape == (10, 10) and abs(resize(np.ones((9, 7)), 4, 3) - 1).max() < 1e-12
    assert circle_mask(7, 7, 3.0).sum() == 29


def test_numbers_and_groups(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 50, i) for i in range(200)], "g int, v int, id int")
    for groups in ([], ["g"]):
        seen = {}
        for r in ordering.number(df, groups, ["v", "id"], "n").collect():
            seen.setdefault(r.g if groups else 0, []).append((r.v, r.id, r.n))
        for rows in seen.values():
            assert [n for *_, n in sorted(rows)] == list(range(1, len(rows) + 1))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and len(got) == 44
    assert components(edges.limit(0)).count() == 0


def test_overlapping_boxes(spark):
    rng = np.random.default_rng(2)
    a = [(i, float(x), float(x + w), float(y), float(y + h)) for i, (x, y, w, h) in enumerate(rng.uniform(0.1, 9, (40, 4)))]
    df = spark.createDataFrame(a, "id int, x0 double, x1 double, y0 double, y1 double")
    got = sorted((r.a_id, r.b_id) for r in overlapping(df, df, 3.0).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in a if p[1] < q[2] and q[1] < p[2] and p[3] < q[4] and q[3] < p[4])


def test_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_text("a,b\n1,2\nnan,x\n")
    assert sorted((r.r, r.c, r.v) for r in grids.read_csv_grid(spark, str(tmp_path / "g.csv")).where("v is not null").collect()) == [(0, 0, 1.0), (0, 1, 2.0)]
    raw = np.arange(12, dtype="<f4").reshape(3, 4)
    raw[1, 1] = -99999
    (tmp_path / "g.bin").write_bytes(raw.tobytes())
    got = {(r.r, r.c): r.v for r in grids.read_float32_grid(spark, str(tmp_path / "g.bin"), 4, -99999, rows=(1, 3), cols=(1, 3)).collect()}
    assert got == {(1, 1): None, (1, 2): 6.0, (2, 1): 9.0, (2, 2): 10.0}
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"k": "é"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [0, 1], [1, 1]]], [[[5, 5], [5, 6], [6, 6]]]]}},
        {"type": "Feature", "properties": None, "geometry": None}, {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [0, 3]]}},
    ]}
    (tmp_path / "l.geojson").write_text(json.dumps(doc))
    layer = grids.read_geojson(spark, str(tmp_path / "l.geojson"))
    assert sorted((r.fid, r.kind) for r in layer.collect()) == [(0, "Polygon"), (0, "Polygon"), (2, "LineString")]
    assert grids.densify(layer.where("kind = 'LineString'"), 1.0).count() == 4
    assert grids.fix_rings(layer).count() == 2
    points = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 2, 2, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in points)
    (tmp_path / "p.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    shp = grids.read_shapefile(spark, str(tmp_path / "p.shp"))
    assert shp.select(G.area(F.col("rings")).alias("a")).first().a == 2.0
    assert grids.read_header('A = 1\n B = "x"\n')["b"] == "x"
    with pytest.raises(ValueError):
        grids.check_registered({"a": grids.Meta(2, 2), "b": grids.Meta(2, 3)})


def test_sinks(spark, tmp_path):
    layer = sinks.windows_layer(spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0)], "rank int, x0 double, x1 double, y0 double, y1 double"))
    sinks.write_layer(layer, str(tmp_path / "a"))
    text = spark.read.text(str(tmp_path / "a")).first().value
    assert json.loads(text)["properties"] == {"rank": 1} and json.loads(text)["geometry"]["coordinates"][0][2] == [1.0, 3.0]
    sinks.write_layer(layer, str(tmp_path / "b"), "parquet")
    assert spark.read.parquet(str(tmp_path / "b")).first().wkt.startswith("POLYGON ((0.0 2.0, 0.0 3.0")
    with pytest.raises(ValueError):
        sinks.write_layer(layer.limit(0), str(tmp_path / "c"))
    circle = sinks.circles_layer(spark.createDataFrame([(1, 5.0, 5.0)], "rank int, cx double, cy double"), 2.0)
    assert abs(circle.select(G.area(F.col("rings")).alias("a")).first().a - np.pi * 4) < 0.05
    sinks.write_tables({"t": layer.select("rank")}, str(tmp_path / "t"), "csv")
    assert spark.read.csv(str(tmp_path / "t" / "t"), header=True).count() == 1
    assert "spark" in sinks.provenance(spark)


def test_config(tmp_path):
    doc = {"name": "a", "grids": {"M": "m.bin"}, "footprints": "f.shp", "window": [4, 5], "ks": [2, 3]}
    run = config.build(doc)
    assert run.grid_path("m") == "m.bin" and run.cases() == [(1, 2), (1, 3)] and run.folder(1, 2).endswith("dep=1/method=components/k=2")
    for bad in ({"alpha": 2}, {"analysis": "multivariate"}, {"patch": "circle"}, {"window": [0, 1]}, {"strange": 1}):
        with pytest.raises(ValueError):
            config.build(doc | bad)
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.absolute_paths({"a": ["/x", {"b": "y"}], "c": "C:\\z"}) == ["a[0]", "c"]
    (tmp_path / "c.yaml").write_text("name: a\n")
    assert config.read(str(tmp_path / "c.yaml")) == {"name": "a"}


def test_names(spark):
    df = spark.createDataFrame([("a b--c(d)", "PC12", "dep=3/method=late_sum/k=2-8/alpha=0p5", " 1.5 ")], "t string, p string, f string, n string")
    r = df.select(N.file_token(F.col("t")).alias("t"), N.component_index(F.col("p")).alias("p"), N.parse_case(F.col("f")).alias("f"), N.safe_number(F.col("n")).alias("n"), N.label_with_unit(F.lit("tmi")).alias("u")).first()
    assert (r.t, r.p, r.n, r.u) == ("a_b_c_d", 11, 1.5, "tmi (nT)") and r.f.dep_id == 3 and r.f.ks == [2, 8] and r.f.alpha == 0.5
    assert N.decimal_token(0.503) == "0p503" and N.int_list_token([2, 8]) == "2-8"


def test_inference(spark):
    d = [3.0, 1.0, 2.0, -0.5]
    r = inference.sign_flips(spark.createDataFrame([(x,) for x in d], "d double")).first()
    flips = [abs(sum(x if b >> i & 1 else -x for i, x in enumerate(d))) for b in range(16)]
    assert r.n == 4 and abs(r.p - np.mean([f >= 5.5 - 1e-12 for f in flips])) < 1e-12
    pairs = [(i, j, float(i + 2 * j), float(3 * i + j)) for i in range(4) for j in range(4)]
    got = {r.target: (r.mean_a, r.mean_b) for r in inference.leave_one_out(spark.createDataFrame(pairs, "ref int, target int, a double, b double")).collect()}
    for t in range(4):
        rest = [(a, b) for i, j, a, b in pairs if i != j and j != t and i != t]
        assert np.allclose(got[t], np.mean(rest, axis=0))
    b = inference.bootstrap(spark.createDataFrame([(i % 5, float(i)) for i in range(50)], "g int, v double"), "g", "v", 200, 1).first()
    assert b.low <= b["mean"] <= b.high
    cover, weights = spark.createDataFrame([(0, 0), (0, 1), (1, 5)], "cell int, window_id long"), spark.createDataFrame([(0, 0.5), (1, 0.5)], "cell int, weight double")
    null = inference.random_recovery(cover, weights, spark.range(10).withColumnRenamed("id", "window_id"), 10, 400, 3)
    band = {r["rank"]: r for r in inference.band(null).collect()}
    assert abs(band[10]["mean"] - 1) < 1e-12 and abs(band[1]["mean"] - 0.15) < 0.04
    assert inference.permutation_p(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), 2.5).first().p == 0.5


def plain_key(seed, draw, item):
    return int(hashlib.md5(f"{seed}:{draw}:{item}".encode()).hexdigest()[:13], 16)


def test_draws_are_even_and_whole(spark):
    """Every item is drawn about as often, never twice in a draw, and a limit that is too low is lifted."""
    items = spark.range(3000).withColumnRenamed("id", "window_id")
    got = inference.drawn(items, 300, 200, 5)
    assert got.count() == 60_000 and got.select("draw", "window_id").distinct().count() == 60_000 and got.groupBy("draw").agg(F.max("rank").alias("m")).where("m = 300").count() == 200
    times = np.array([r["count"] for r in got.groupBy("window_id").count().collect()])
    assert len(times) > 2990 and 0.8 < times.var() / (200 * 0.1 * 0.9) < 1.25
    first = np.array([r.window_id for r in got.where("rank = 1").collect()])
    assert len(set(first.tolist())) > 180 and 1200 < first.mean() < 1800
    assert inference.drawn(items.limit(5), 9, 3, 1).count() == 15 and inference.drawn(items.limit(0), 9, 3, 1).count() == 0
    large = spark.createDataFrame([(2**40 + i,) for i in range(50)], "window_id long")
    assert {(r.draw, r.window_id): r["rank"] for r in inference.drawn(large, 50, 2, 3).collect()} == {(d, w): k for d in range(2) for k, w in enumerate(sorted((2**40 + i for i in range(50)), key=lambda w: (plain_key(3, d, w), w)), 1)}


def test_random_draws_against_plain_loops(spark):
    rows = [(i % 5, float(i * i % 17)) for i in range(50)]
    b = inference.bootstrap(spark.createDataFrame(rows, "g int, v double"), "g", "v", 60, 9).first()
    sums = np.array([sum(v for g, v in rows if g == k) for k in range(5)])
    means = [sums[[plain_key(9, d, j) % 5 for j in range(1, 6)]].sum() / 50 for d in range(60)]
    assert np.allclose([b["mean"], b.low, b.high], [sums.sum() / 50, np.quantile(means, 0.025), np.quantile(means, 0.975)])
    owners, share = [np.array([0, 1]), np.array([5]), np.array([2, 5, 7])], np.array([0.5, 0.2, 0.3])
    cover = spark.createDataFrame([(c, int(w)) for c, o in enumerate(owners) for w in o], "cell int, window_id long")
    weights = spark.createDataFrame([(c, float(v)) for c, v in enumerate(share)], "cell int, weight double")
    got = {(r.draw, r["rank"]): r.fraction for r in inference.random_recovery(cover, weights, spark.range(10).withColumnRenamed("id", "window_id"), 6, 60, 9).collect()}
    assert len(got) == 360
    for d in range(60):
        chosen = sorted(range(10), key=lambda w: (plain_key(9, d, w), w))[:6]
        for t in range(1, 7):
            assert np.isclose(got[d, t], sum(w for o, w in zip(owners, share) if set(o.tolist()) & set(chosen[:t])))


def test_compare(spark):
    rows = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (2, 9, 0.1)], "dep_id int, k int, auc double")
    assert sorted((r.dep_id, r.k) for r in compare.sweep_tables(rows)[2].collect()) == [(1, 2), (2, 9)]
    p = spark.createDataFrame([(0, i, float(i)) for i in range(5)], "g int, r int, y double")
    assert [r.smooth for r in compare.moving_average(p, ["g"], "r", "y", 3).orderBy("r").collect()] == [1 / 3, 1.0, 2.0, 3.0, 7 / 3]
    with pytest.raises(ValueError):
        compare.moving_average(p, ["g"], "r", "y", 2)


def test_overlay_edges(spark):
    cells = spark.createDataFrame([(r, c, False) for r in range(3) for c in range(3)], "r int, c int, v boolean")
    assert overlay.distance_to(cells).where("distance is not null").count() == 0
    assert {r.distance for r in overlay.distance_to(cells.withColumn("v", (F.col("r") == 0) & (F.col("c") == 0))).collect()} >= {0.0, 1.0, float(np.sqrt(8))}


def test_registry_and_stream(spark, sf, tmp_path):
    with pytest.raises(ValueError):
        fuse("nothing", None)
    assert set(FUSIONS) >= {"late_sum", "late_max", "concat_alpha", "concat_standardized", "two_stage", "joint"}
    kinds = ["view", "click", "error"]
    events = spark.read.parquet(f"{sf}/events.parquet")
    hourly = window_counts(events, kinds).cache()
    train = hourly.select(F.unix_timestamp("start").alias("window_id"), "x", F.lit(False).alias("is_ref"))
    ref = hourly.orderBy("start").limit(1).select(F.lit(-1).cast("long").alias("window_id"), "x", F.lit(True).alias("is_ref"))
    frozen = block(train.unionAll(ref), k=2)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = score(window_counts(stream, kinds), frozen).writeStream.format("memory").queryName("scored").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.start: r.dist for r in score(hourly, frozen).collect()}
    got = {r.start: r.dist for r in spark.table("scored").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def polygon(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]


def test_areas_of_islands_and_holes(spark):
    square = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y)]
    shapes = {
        "islands": (polygon(square(0, 0, 1), square(5, 0, 2)), 5.0), "islands and hole": (polygon(square(0, 0, 4), square(9, 0, 2), square(1, 1, 2)[::-1]), 16.0),
        "the other way": (polygon(square(0, 0, 4)[::-1], square(9, 0, 2)[::-1], square(1, 1, 2)), 16.0), "line": (polygon([(0, 0), (1, 1)]), 0.0),
    }
    df = spark.createDataFrame([(n, r) for n, (r, _) in shapes.items()], f"name string, rings {G.RINGS}")
    inside = G.clip_area(F.col("rings"), F.lit(0.5), F.lit(9.5), F.lit(0.25), F.lit(3.0))
    for r in df.select("name", "rings", G.area(F.col("rings")).alias("area"), inside.alias("inside")).collect():
        assert abs(r.area - shapes[r.name][1]) < 1e-12
        assert abs(r.inside - G.rings_in_box(r.rings, 0.5, 9.5, 0.25, 3.0)) < 1e-12


def test_clipping_of_random_polygons(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        n = int(rng.integers(3, 12))
        at = np.sort(rng.uniform(0, 2 * np.pi, n))
        size = rng.uniform(0.2, 4, n)
        ring = list(zip(size * np.cos(at), size * np.sin(at)))
        if i % 3 == 0:
            ring = [(round(x), round(y)) for x, y in ring]  # edges along the box's sides
        box = sorted(rng.integers(-3, 4, 2).tolist()), sorted(rng.integers(-3, 4, 2).tolist())
        rows.append((i, polygon(ring if i % 2 else ring[::-1]), *(float(v) for v in (box[0][0], box[0][1] + 1, box[1][0], box[1][1] + 1))))
    df = spark.createDataFrame(rows, f"i int, rings {G.RINGS}, x0 double, x1 double, y0 double, y1 double")
    for r in df.withColumn("inside", G.clip_area(F.col("rings"), *map(F.col, ("x0", "x1", "y0", "y1")))).collect():
        assert abs(r.inside - G.rings_in_box(r.rings, r.x0, r.x1, r.y0, r.y1)) < 1e-9


def test_files_with_several_outlines(spark, tmp_path):
    ring = lambda x, s: [[x, 0], [x, s], [x + s, s], [x + s, 0], [x, 0]]
    hole = [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]
    for k, coordinates in enumerate(([ring(0, 4), hole], [ring(0, 4)[::-1], hole], [ring(0, 4), hole[::-1]])):
        (tmp_path / f"{k}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": coordinates}}]}))
    assert [r.a for r in grids.read_geojson(spark, str(tmp_path)).select(G.area(F.col("rings")).alias("a")).collect()] == [15.0] * 3
    inner = [[0.2, 0.2], [0.8, 0.2], [0.8, 0.8], [0.2, 0.8], [0.2, 0.2]]
    parts = [inner, ring(0, 1), ring(5, 2)]  # a hole that comes first
    flat = [p for part in parts for p in part]
    body = struct.pack("<i4d", 5, 0, 0, 7, 2) + struct.pack("<ii3i", 3, len(flat), 0, 5, 10) + b"".join(struct.pack("<2d", *p) for p in flat)
    (tmp_path / "x.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    got = grids.read_shapefile(spark, str(tmp_path / "x.shp")).select(G.area(F.col("rings")).alias("a")).first()
    assert abs(got.a - (1 + 4 - 0.36)) < 1e-12


def test_published_coordinates():
    """Worked examples of published guidance and gazetteers."""
    airy = G.Ellipsoid(6377563.396, 299.3249646)
    plain = G.Grid(airy, -2.0, 0.9996012717, 400_000.0, 0.0)
    origin = G.to_grid_arrays(plain, np.array([-2.0]), np.array([49.0]))[1][0]
    grid = G.Grid(airy, -2.0, 0.9996012717, 400_000.0, -100_000.0 - origin)
    x, y = G.to_grid_arrays(grid, np.array([0.5]), np.array([50.5]))
    assert abs(x[0] - 577274.99) < 0.02 and abs(y[0] - 69740.50) < 0.02
    lon, lat = G.from_grid_arrays(grid, x, y)
    assert abs(lon[0] - 0.5) < 1e-9 and abs(lat[0] - 50.5) < 1e-9
    x, y = G.to_grid_arrays(G.crs_grid("EPSG:32617"), np.array([-79.387139]), np.array([43.642567]))
    assert abs(x[0] - 630084) < 2 and abs(y[0] - 4833438) < 2


def test_geocentric_round_trip():
    lon, lat = np.array([-51.0, 10.0, 179.0, 0.0]), np.array([-6.0, 89.9, -89.99, 0.0])
    back = G.from_geocentric(G.WGS84, *G.to_geocentric(G.WGS84, lon, lat))
    assert np.allclose(back[0], lon, atol=1e-10) and np.allclose(back[1], lat, atol=1e-10)


def test_lower_envelope():
    rng = np.random.default_rng(2)
    for n in (1, 2, 60):
        at, height, x = np.sort(rng.choice(200, n, replace=False)).astype(float), rng.integers(0, 900, n).astype(float), np.arange(200.0)
        assert np.allclose(overlay.envelope(at, height, x), ((x[:, None] - at) ** 2 + height).min(axis=1))
    for case in range(300):  # many ties, places between the cells, one cell
        n, m = rng.integers(1, 40, 2)
        at, height, x = np.sort(rng.choice(60, n, replace=False)) / 2, rng.integers(0, 4, n).astype(float) ** 2, np.sort(rng.choice(60, m, replace=False)).astype(float)
        assert (overlay.envelope(at, height, x) == ((x[:, None] - at) ** 2 + height).min(axis=1)).all()


def test_a_cut_between_equal_eigenvalues_warns(spark):
    """Four scores without correlation in a balanced design have equal eigenvalues, whatever k."""
    from itertools import product

    from lodestone.operators.ranking import cut_gap, fuse_two_stage

    rows = [(i, i == 15, [float(a), float(b)], [float(c), float(d)]) for i, (a, b, c, d) in enumerate(product((-1, 1), repeat=4))]
    frame = spark.createDataFrame(rows, "window_id long, is_ref boolean, a array<double>, b array<double>")
    with pytest.warns(RuntimeWarning, match="k = 2 parts two components"):
        fuse_two_stage(frame, ["a", "b"], [2, 2], 2)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        assert fuse_two_stage(frame, ["a", "b"], [2, 2]).count() == 15
    assert cut_gap(np.array([3.0, 2.0, 1.0]), 1) == 1 / 3 and cut_gap(np.array([3.0, 2.0]), 2) == float("inf") and cut_gap(np.zeros(3), 1) == 0


@pytest.mark.parametrize("most", [10**6, 7])
def test_interpolation_of_short_and_long_curves(spark, most):
    rng = np.random.default_rng(5)
    x, y, v = rng.permutation(40) * 1.5, rng.normal(size=40), rng.uniform(-10, 80, 300)
    curve = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double")
    values = spark.createDataFrame([(i, float(a)) for i, a in enumerate([*v, *x])] + [(-1, None), (-2, float("nan"))], "i int, at double")
    got = {r.i: r.v for r in joins.interpolate(values, curve, "at", "x", "y", "v", most).collect()}
    o = np.argsort(x)
    assert got[-1] is None and got[-2] is None and len(got) == 342
    assert np.allclose([got[i] for i in range(340)], np.interp([*v, *x], x[o], y[o]))
    assert {r.v for r in joins.interpolate(values, curve.limit(0), "at", "x", "y", "v").collect()} == {None}


def test_exact_quantiles(spark, monkeypatch):
    v = np.random.default_rng(6).normal(size=501)
    df = spark.createDataFrame([(float(a), None if i % 3 else float(a)) for i, a in enumerate(v)], "a double, b double").repartition(5)
    want = [np.quantile(v, 0.37), np.quantile(v[::3], 0.37)]
    assert np.allclose(ordering.quantiles(df, ["a", "b"], 0.37), want)
    monkeypatch.setattr(ordering, "FEW", 10)
    assert np.allclose(ordering.quantiles(df, ["a", "b"], 0.37), want)


@pytest.mark.parametrize("band, tile", [(64, None), (4, 6), (3, 100)])
def test_windows_in_tiles(spark, band, tile):
    rng = np.random.default_rng(7)
    grid = rng.normal(size=(20, 33))
    grid[4, 5] = grid[11, 20] = np.nan
    rows = [(r, c, None if np.isnan(grid[r, c]) else float(grid[r, c])) for r in range(20) for c in range(33)]
    rows += [(0, 0, -50.0), (19, 32, -50.0), (3, 3, None)]  # of repeated cells the largest value counts
    shape = windows.Shape(20, 33, 4, 6, 2, 3)
    got = {r.window_id: (r.r0, r.c0, r.v) for r in windows.windows(spark.createDataFrame(rows, "r int, c int, v double"), shape, ["v"], band=band, tile=tile).collect()}
    want = {}
    for i in range(shape.per_column):
        for k in range(shape.per_row):
            patch = grid[i * 2 : i * 2 + 4, k * 3 : k * 3 + 6]
            if patch.shape == (4, 6) and not np.isnan(patch).any():
                want[i * shape.per_row + k] = (i * 2, k * 3, patch.ravel().tolist())
    assert got == want


def test_no_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, other: other})()

    with pytest.raises(RuntimeError):
        ordering.ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("most, edges_a_salt", [(10**6, 10), (0, 10**6), (0, 5)])
def test_components_of_hubs_and_chains(spark, monkeypatch, most, edges_a_salt):
    from lodestone.operators import graph

    monkeypatch.setattr(graph, "BROADCAST_EDGES", most)
    monkeypatch.setattr(graph, "SALT_EDGES", edges_a_salt)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(300, 300), (400, 401), (401, 402), (402, 400), (401, 402)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(60)} | {i: 100 for i in range(100, 121)} | {400: 400, 401: 400, 402: 400}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_rules(tmp_path):
    assert linalg.variables_in(24, 12) == 2 and linalg.components_to_show(17, 100, 2) == 20 and linalg.components_to_show(8, 9) == 9
    with pytest.raises(ValueError):
        linalg.variables_in(25, 12)
    assert grids.resolve_crs(" epsg:4326 ") == "EPSG:4326" and grids.resolve_crs("EPSG:4326", "EPSG:32722") == "EPSG:32722"
    assert grids.resolve_crs("EPSG:29192") == "EPSG:29192"
    for wrong in ((None, None), ("EPSG:3857", None)):
        with pytest.raises(ValueError):
            grids.resolve_crs(*wrong)
    paths = {"variable_paths": {"tmi": "a.gxf"}, "tmi_file_path": "b", "rad_file_path": "c"}
    assert config.older_grids(paths, ["TMI", "eU"]) == {"TMI": "a.gxf", "eU": "c"} and config.older_grids({}, ["TMI"]) == {}


def test_artefacts_are_verified(spark, tmp_path):

    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.json").write_text("{}")
    found = sinks.digests(spark, str(tmp_path))
    right = hashlib.sha256(b"x\n1\n").hexdigest()
    assert sinks.verify(found, {"a.csv": right}) == [] and found.count() == 2
    assert sinks.verify(found, {"a.csv": right, "b.json": "0", "c": "1"}) == ["b.json: differs", "c: missing"]


def test_random_means_and_repaired_rings(spark):
    values = np.array([1.0, 4.0, np.nan, 2.0, np.nan])
    rows = spark.createDataFrame([(i, float(v) if i != 4 else None) for i, v in enumerate(values)], "window_id long, v double")
    got = {r.draw: r.v for r in inference.random_means(rows, 2, 40, 3).collect()}
    assert len(got) == 40
    for d, v in got.items():
        some = values[sorted(range(5), key=lambda w: plain_key(3, d, w))[:2]]
        assert v is None if np.isnan(some).all() else np.isclose(v, np.nanmean(some))
    ring = [(0, 0), (0, 0), (0, 2), (2, 2), (2, 2), (2, 0)]
    df = spark.createDataFrame([(1, polygon(ring, [(1, 1), (1, 1)])), (2, polygon([(0, 0), (1, 1), (2, 2)])), (3, polygon([(5, 5)]))], f"fid long, rings {G.RINGS}")
    fixed = grids.fix_rings(df).collect()
    assert [r.fid for r in fixed] == [1] and [(p.x, p.y) for p in fixed[0].rings[0]] == [(0, 0), (0, 2), (2, 2), (2, 0)] and len(fixed[0].rings) == 1


def test_systems_and_their_chains(spark):
    from lodestone.functions import geometry as G

    assert G.system("EPSG:31982").grid.central_meridian == -51 and G.system("epsg:31977").grid.central_meridian == -81 and G.system("EPSG:31985").grid.central_meridian == -33
    assert G.system("EPSG:31976").grid.northing == 0 and G.system("EPSG:29192").ellipsoid == G.GRS67 and G.system("EPSG:4674").grid is None
    for unknown in ("EPSG:31986", "EPSG:29196", "EPSG:3857", "x", ""):
        with pytest.raises(ValueError):
            G.system(unknown)
    ring = [{"x": -51.0, "y": 0.0}, {"x": -51.5, "y": -9.0}, {"x": -50.0, "y": -10.0}]
    layer = spark.createDataFrame([(1, [ring, ring[::-1]]), (2, []), (3, None), (4, [ring[:1]])], f"fid int, rings {G.RINGS}")
    there = G.reproject(layer, "EPSG:4674", "EPSG:31982")
    got = {r.fid: r.rings for r in there.collect()}
    assert set(got) == {1, 2, 4} and got[2] == [] and abs(got[1][0][0].x - 500_000) < 1e-6 and abs(got[1][0][0].y - 10_000_000) < 1e-6
    for path in (("EPSG:31982", "EPSG:4674"), ("EPSG:31982", "EPSG:29192", "EPSG:4618", "EPSG:4326", "EPSG:4674")):
        back = there
        for a, b in zip(path, path[1:]):
            back = G.reproject(back, a, b)
        for r in back.collect():
            want = {1: [ring, ring[::-1]], 2: [], 4: [ring[:1]]}[r.fid]
            assert np.allclose([[p.x, p.y] for q in r.rings for p in q], [[p["x"], p["y"]] for q in want for p in q], atol=1e-8) if want else r.rings == []
    # The published shift moves points of the older datum by some tens of metres.
    old, new = (next(r for r in G.reproject(layer, "EPSG:4618", t).collect() if r.fid == 4).rings[0][0] for t in ("EPSG:29192", "EPSG:31982"))
    assert 30 < np.hypot(old.x - new.x, old.y - new.y) < 100


def test_quantiles_in_passes(spark, monkeypatch):
    from lodestone.operators import ordering

    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=3000), "b": np.round(rng.exponential(size=3000) ** 4), "c": np.full(3000, 7.0)}
    rows = [(float(a), float(b) if i % 3 else None, float(c), None) for i, (a, b, c) in enumerate(zip(*data.values()))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    wants = {q: [np.quantile([r[k] for r in rows if r[k] is not None], q) for k in range(3)] for q in (0.0, 0.05, 0.5, 0.73, 1.0)}
    monkeypatch.setattr(ordering, "FEW", 10)
    monkeypatch.setattr(ordering, "CLOSE", 20)
    monkeypatch.setattr(ordering, "CLASSES", 8)
    for q, want in wants.items():
        got = ordering.quantiles(df, ["a", "b", "c", "d"], q)
        assert np.allclose(got[:3], want) and got[3] is None
