"""A configured run from cells to summaries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.functions.geometry import Affine
from lodestone.operators import linalg, runs
from lodestone.operators import recovery as V
from lodestone.operators.figures import score_pairs, two_stage_rebuild
from lodestone.operators.windows import windows, with_reference
from lodestone.sources import config

H, W = 24, 30
BOX = lambda x, y, w, h: [[[x, y], [x, y + h], [x + w, y + h], [x + w, y], [x, y]]]
PLACES = [(4, 5), (14, 12), (20, 3)]


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(H, W)), rng.normal(size=(H, W))
    bump = np.outer([1, 3, 5, 2], [2, 6, 3, 1, 4]) * 1.0
    for x, y in PLACES:
        a[y : y + 4, x : x + 5] += bump
        b[y : y + 4, x : x + 5] -= bump
    return spark.createDataFrame([(r, c, float(a[r, c]), float(b[r, c])) for r in range(H) for c in range(W)], "r int, c int, A double, B double").cache()


@pytest.fixture(scope="module")
def footprints(spark):
    rings = [[[{"x": float(x), "y": float(y)} for x, y in BOX(x, y, 5, 4)[0]]] for x, y in PLACES]
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(rings)], "dep_id int, rings array<array<struct<x:double,y:double>>>")


def settings(**more):
    return config.build({"name": "t", "grids": {"A": "a", "B": "b"}, "footprints": "f", "window": [4, 5], "references": [1], "ks": [3], "top_k": 12, "variable": "A"} | more)


@pytest.mark.parametrize("more", [{}, {"weight_mode": "abs", "whiten": True}, {"analysis": "multivariate", "fusion": "concat_alpha"}, {"analysis": "multivariate", "fusion": "late_sum", "alpha": 0.3}, {"analysis": "multivariate", "fusion": "two_stage"}, {"patch": "circle", "radius": 2.0}])
def test_planted_places_are_found(cells, footprints, more):
    t = runs.case(settings(**more), cells, footprints, Affine(e=1.0), H, W, 1, 3)
    first = t["ranked"].orderBy("rank").first()
    assert (first.r0, first.c0) == (PLACES[0][1], PLACES[0][0])
    s = t["summary"].first()
    assert s.n_hits == 2 and 0 < s.auc <= 1
    curve = [r.mean_fraction for r in t["curve"].orderBy("rank").collect()]
    assert curve == sorted(curve) and curve[-1] <= 1 + 1e-9


def test_equal_area_beats_chance(cells, footprints):
    run = settings()
    t = runs.case(run, cells, footprints, Affine(e=1.0), H, W, 1, 3)
    last = runs.against_random(run, t, cells).orderBy("rank").collect()[-1]
    assert last.ratio > 1.5


def test_rotated_reference_and_swap(cells, footprints):
    t = runs.case(settings(rotation=10.0), cells, footprints, Affine(e=1.0), H, W, 2, 3)
    assert t["ranked"].count() == 12
    s = runs.swap_references(settings(), cells, footprints, Affine(e=1.0), H, W, [1, 2], 3)
    assert {r.dep_ref for r in s.collect()} == {1, 2}


def test_finished_cases_are_read(cells, footprints, tmp_path, monkeypatch):
    run = settings(output=str(tmp_path), ks=[2, 3])
    args = (footprints, Affine(e=1.0), H, W)
    first = {r.ks: r.auc for r in runs.run_all(run, cells, *args)["summary"].collect()}
    finished = list(tmp_path.glob("*/run=*/dep=*/method=*/k=*/finished/part-*"))
    assert set(first) == {"2", "3"} and len(finished) == 2 and json.loads(finished[0].read_text())["window"] == list(run.window)
    done, asked = runs.case, []
    monkeypatch.setattr(runs, "case", lambda *a, **b: asked.append(a) or done(*a, **b))
    assert {r.ks: r.auc for r in runs.run_all(run, cells, *args)["summary"].collect()} == first and not asked
    # Other settings, other data and a case that broke off are computed.
    runs.run_all(settings(output=str(tmp_path), ks=[2], whiten=True), cells, *args)
    assert len(asked) == 1
    runs.run_all(settings(output=str(tmp_path), ks=[2]), cells.where("r > 0 or c > 0"), *args)
    assert len(asked) == 2
    for part in finished[0].parent.iterdir():
        part.unlink()
    finished[0].parent.rmdir()
    runs.run_all(run, cells, *args)
    assert len(asked) == 3


def test_stored_results_side_by_side(spark, cells, footprints, tmp_path):
    for whiten in (False, True):
        runs.run_all(settings(output=str(tmp_path), ks=[2, 3], whiten=whiten), cells, footprints, Affine(e=1.0), H, W)
    name = settings().name
    got = runs.compared(spark, [str(tmp_path / name)])
    assert got["summary"].count() == 4 and got["best"].count() == 1 and got["bands"].count() > 0


def test_parts_of_a_footprint_count_together(spark, cells, footprints):
    whole = footprints.where("dep_id = 1").select("rings").first().rings
    (x0, x1), (y0, y1) = ([f(p[c] for p in whole[0]) for f in (min, max)] for c in ("x", "y"))
    middle = (x0 + x1) / 2
    box = lambda a, b: [[{"x": a, "y": y0}, {"x": a, "y": y1}, {"x": b, "y": y1}, {"x": b, "y": y0}]]
    parts = spark.createDataFrame([(1, box(x0, middle)), (1, box(middle, x1))], footprints.schema)
    one, two = (V.polygon_cells(f.where("dep_id = 1"), Affine(e=1.0)) for f in (footprints, parts))
    key = lambda df: sorted((r.r, r.c, round(r.area, 9)) for r in df.collect())
    assert key(one) == key(two)
    t = Affine(e=1.0)
    assert np.array_equal(runs.reference_patch(cells, "A", footprints.where("dep_id = 1"), t, 4, 5), runs.reference_patch(cells, "A", parts, t, 4, 5))


def test_turned_templates_and_other_footprints(spark, cells, footprints):
    run = settings(ks=[2], references=[1])
    args = (cells, footprints, Affine(e=1.0), H, W)
    got = runs.swept(run, *args, [0.0], [1.0, 0.9]).collect()
    assert len(got) == 2 and {r.scale for r in got} == {1.0, 0.9}
    tables = runs.case(run, *args, 1, 2)
    again = runs.rescored(run, tables["ranked"], footprints.where("dep_id <> 1"), Affine(e=1.0))
    assert again["curve"].orderBy("rank").collect() == tables["curve"].select(*again["curve"].columns).orderBy("rank").collect()
    pool = tables["windows"].where("r0 > 2").select("window_id")
    fewer = runs.rescored(run, tables["ranked"], footprints.where("dep_id <> 1"), Affine(e=1.0), pool)["ranked"].orderBy("rank").collect()
    assert [r["rank"] for r in fewer] == list(range(1, len(fewer) + 1)) and all(r.r0 > 2 for r in fewer)


def test_command_line(cells, tmp_path):
    cells.write.parquet(str(tmp_path / "cells"))
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": BOX(x, y, 5, 4)}} for x, y in PLACES]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    (tmp_path / "c.json").write_text(json.dumps({"name": "t", "grids": {"A": "a"}, "footprints": "f", "window": [4, 5], "references": [1], "ks": [2], "top_k": 6, "variable": "A", "output": str(tmp_path / "out")}))
    args = [str(tmp_path / "c.json"), "--cells", str(tmp_path / "cells"), "--footprints", str(tmp_path / "f.geojson"), "--height", str(H), "--width", str(W), "--transform", "1", "0", "0", "0", "1", "0"]
    assert main([*args, "--check"]) == 0 and main(args) == 0
    assert list((tmp_path / "out" / "t" / "summary").glob("*.csv"))


def test_pairs_and_two_stage_rebuild(spark, cells):
    shape = runs.Shape(H, W, 2, 2)
    frame = with_reference(windows(cells, shape, ["A", "B"]), 10).cache()
    m = linalg.fit(frame, "A")
    p = score_pairs(frame, m, [(1, 2), (2, 3)], spark.createDataFrame([(3,)], "window_id long"), "A")
    assert p.count() == 2 * frame.count() and p.where("is_top").count() == 2
    ms = [linalg.fit(frame, c) for c in "AB"]
    x = [np.array(frame.where("is_ref").first()[c]) for c in "AB"]
    from lodestone.operators.ranking import scores_side_by_side

    both = scores_side_by_side(frame, ["A", "B"], [4, 4])
    second = linalg.fit(both)
    z = second.scores(np.array(both.where("is_ref").first()["x"]))
    assert all(np.allclose(a, b) for a, b in zip(two_stage_rebuild(ms, [4, 4], second, z, 8), x))


def test_footprints_are_reprojected(spark, cells, footprints):
    from lodestone.functions import geometry as G

    # The grid in metres of UTM zone 22 south; the same footprints in degrees must give the same tables.
    t = Affine(100.0, 0.0, 480_000.0, 0.0, -100.0, 9_000_000.0)
    x, y = (lambda p: t.a * p["x"] + t.c), (lambda p: t.e * p["y"] + t.f)
    metres = footprints.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(x(p).alias("x"), y(p).alias("y"))))).cache()
    degrees = G.reproject(metres, "EPSG:32722", "EPSG:4326")
    p = degrees.where("dep_id = 1").first().rings[0][0]
    assert -52 < p.x < -51 and -10 < p.y < -9
    run = settings(crs_policy="reproject", footprint_crs="EPSG:4326", grid_crs="epsg:32722")
    want, got = ({(r.dep_id, r.r, r.c): r.area for r in runs.case(a, cells, b, t, H, W, 1, 3)["tested"].collect() if r.area > 1e-3} for a, b in ((settings(), metres), (run, degrees)))
    assert want.keys() == got.keys() and want and all(abs(want[k] - got[k]) <= 1e-5 * want[k] for k in want)


@pytest.mark.parametrize("crs", [{}, {"footprint_crs": "EPSG:4326"}, {"footprint_crs": "EPSG:4326", "grid_crs": "EPSG:3857"}])
def test_reproject_needs_known_crs(crs):
    with pytest.raises(ValueError, match="crs_policy"):
        settings(crs_policy="reproject", **crs)
    assert settings(crs_policy="reproject", footprint_crs="EPSG:4326", grid_crs="EPSG:29192").grid_crs == "EPSG:29192"


def test_best_k_by_reference_and_variable(cells, footprints, tmp_path):
    (tmp_path / "b.csv").write_text("deposit_1based,k_pcs\n1,5\n2,3\n1,9\n")
    run = settings(analysis="multivariate", references=[1, 2], best_k={"a": {"1": 2, "2": 4}, "B": str(tmp_path / "b.csv")}, output=str(tmp_path))
    assert run.cases() == [(1, (2, 5)), (2, (4, 3))] and run.cases(k=7) == [(1, 7), (2, 7)]
    assert settings(best_k={"A": {1: 2}}).cases() == [(1, 2)]
    got = runs.run_all(run, cells, footprints, Affine(e=1.0), H, W, write=False)["summary"].collect()
    assert {(r.dep_ref, r.ks) for r in got} == {(1, "2-5"), (2, "4-3")}
    with pytest.raises(ValueError, match="best_k"):
        settings(analysis="multivariate", best_k={"A": {1: 2}})


def test_reference_vectors_fall_back(spark, cells, footprints):
    multi = runs.case(settings(analysis="multivariate"), cells, footprints, Affine(e=1.0), H, W, 1, 3)["reference"].first()
    assert len(multi.joint) == 40 and multi["shape"] == [4, 5]
    rows = [
        (1, "raw", "univariate", "A", None, None, None, [1, 1], None), (1, "raw", "univariate", "B", None, [2.0], [3.0], None, [1, 1]),
        (1, "raw", "univariate", "B", None, [9.0], None, [1, 1], None), (2, "components", "univariate", "A", None, [4.0], None, [1, 1], None),
        (3, "late_sum", "multivariate", None, [5.0], [6.0], [7.0], [1, 1], None),
    ]
    table = spark.createDataFrame(rows, runs.REFERENCES).withColumn("place", F.monotonically_increasing_id())
    take = lambda *a: {(r.dep_ref, r.x[0], r.source) for r in runs.reference_vectors(table, *a).collect()}
    assert take("raw", "univariate", "B") == {(1, 3.0, "preferred")}
    assert take("raw", "univariate", "A") == {(1, 3.0, "method and analysis")}
    assert take("other", "univariate") == {(1, 3.0, "analysis"), (2, 4.0, "analysis")}
    assert take("raw", "none") == {(1, 3.0, "method")}
    assert take("other", "none") == {(1, 3.0, "all"), (2, 4.0, "all"), (3, 5.0, "all")}
    with pytest.raises(ValueError, match="no case"):
        runs.reference_vectors(table.limit(0))


def test_many_references_in_one_scan(spark, cells, footprints, monkeypatch):
    """Swaps, sweeps and runs of many cases cut the windows once, and give what single cases give."""
    run, args = settings(ks=[2, 3], references=[1, 2], whiten=True), (cells, footprints, Affine(e=1.0), H, W)
    alone = {(r, k): runs.case(run, *args, r, k) for r, k in run.cases()}
    made, plain = [], runs.windows
    monkeypatch.setattr(runs, "windows", lambda *a, **b: made.append(1) or plain(*a, **b))
    common = runs.shared(run, *args, [(1, 0.0, 1.0), (2, 0.0, 1.0)], [2, 3])
    for (r, k), one in alone.items():
        both = [t["ranked"].select("rank", "window_id", F.round("dist", 9)).orderBy("rank").collect() for t in (one, runs.case(run, *args, r, k, common=common))]
        assert both[0] == both[1]
    key = lambda df: sorted((r.dep_ref, r.ks, round(r.auc, 9), r.n_hits) for r in df.collect())
    assert len(made) == 1
    assert key(runs.run_all(run, *args, write=False)["summary"]) == sorted(x for t in alone.values() for x in key(t["summary"])) and len(made) == 2
    assert key(runs.swap_references(run, *args, [1, 2], 3)) == sorted(x for (_, k), t in alone.items() if k == 3 for x in key(t["summary"])) and len(made) == 3



def test_windows_from_the_footprints(spark, cells, footprints):
    """Without a window the reference's bounds give it, within the grid; circles lie about the bounds' centre."""
    t = Affine(e=1.0)
    run = config.build({"name": "t", "grids": {"A": "a", "B": "b"}, "footprints": "f", "references": [1], "ks": [3], "top_k": 12, "variable": "A"})
    fixed, free = (runs.case(r, cells, footprints, t, H, W, 1, 3) for r in (settings(), run))
    assert free["reference"].first()["shape"] == [4, 5] and free["ranked"].orderBy("rank").collect() == fixed["ranked"].orderBy("rank").collect()
    assert runs.against_random(run, free, cells).count() == 12
    ring = [{"x": x, "y": y} for x, y in ((26.5, 21.5), (26.5, 26.0), (33.0, 26.0), (33.0, 21.5))]
    edge = spark.createDataFrame([(9, [ring]), (8, [[{"x": p["x"] + 50, "y": p["y"]} for p in ring]])], footprints.schema)
    assert runs.footprint_box(edge.where("dep_id = 9"), t, H, W) == (21, 24, 26, 30)
    with pytest.raises(ValueError, match="outside"):
        runs.footprint_box(edge.where("dep_id = 8"), t, H, W)
    round_run = config.build(run.resolved() | {"patch": "circle"})
    got = runs.case(round_run, cells, footprints, t, H, W, 1, 3)
    x, y = PLACES[0]
    grid = np.full((H, W), np.nan)
    for r in cells.collect():
        grid[r.r, r.c] = r.A
    row, col = int(np.round(y + 2 - 0.5)), int(np.round(x + 2.5 - 0.5))
    inside = [(r, c) for r in range(row - 3, row + 4) for c in range(col - 3, col + 4) if (r + 0.5 - y - 2) ** 2 + (c + 0.5 - x - 2.5) ** 2 <= 2.5**2]
    assert np.allclose(got["reference"].first().vector, [grid[p] for p in inside]) and got["reference"].first()["shape"] == [7, 7]
    assert (lambda f: (f.r0, f.c0))(got["ranked"].orderBy("rank").first()) == (row - 3, col - 3)


def test_moments_with_one_more_row(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 6))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    more = linalg.moments(rows.repartition(9)).with_row(np.arange(6.0))
    whole = np.vstack([x, np.arange(6.0)])
    assert more.n == 51 and np.allclose(more.mean, whole.mean(axis=0)) and np.allclose(more.gram, (whole - whole.mean(axis=0)).T @ (whole - whole.mean(axis=0)))
