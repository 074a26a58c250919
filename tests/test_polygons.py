"""Overlay, repair, dissolving, buffers and touched cells, on shapes with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry as G
from lodestone.functions.geometry import Affine
from lodestone.operators import overlay as O
from lodestone.operators import polygons as P


def layer(spark, rows):
    points = [(i, None if rings is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in rows]
    return spark.createDataFrame(points, f"fid long, rings {G.RINGS}")


def square(x, y, s):
    return [(x, y), (x, y + s), (x + s, y + s), (x + s, y)]


def areas(df):
    """Area and number of rings by key."""
    return {r.fid: (pytest.approx(r.a, abs=1e-5), len(r.rings)) for r in df.select("*", G.area(F.col("rings")).alias("a")).collect()}


def shoelace(r):
    return abs(sum(x * v - u * y for (x, y), (u, v) in zip(r, r[1:] + r[:1]))) / 2


def test_overlay_of_squares(spark):
    a = layer(spark, [(1, [square(0, 0, 2)]), (2, [square(0, 0, 2)]), (3, [square(0, 0, 2)]), (4, [square(0, 0, 3)]), (5, [square(0, 0, 1)]), (6, None), (7, [])])
    b = layer(spark, [(1, [square(1, 1, 2)]), (2, [square(2, 2, 2)]), (3, [square(2, 0, 2)]), (4, [square(1, 1, 1)]), (6, [square(0, 0, 1)])])
    assert areas(P.overlay(a, b, "union")) == {1: (7, 1), 2: (8, 2), 3: (8, 1), 4: (9, 1), 5: (1, 1), 6: (1, 1), 7: (0, 0)}
    assert areas(P.overlay(a, b, "difference")) == {1: (3, 1), 2: (4, 1), 3: (4, 1), 4: (8, 2), 5: (1, 1), 6: (0, 0), 7: (0, 0)}


def test_areas_of_random_polygons_agree(spark):
    rng = random.Random(3)

    def star(cx, cy, n):
        far = [rng.uniform(1, 5) for _ in range(n)]
        return [(cx + d * math.cos(2 * math.pi * i / n), cy + d * math.sin(2 * math.pi * i / n)) for i, d in enumerate(far)]

    left, right = [(i, [star(0, 0, 9)]) for i in range(30)], [(i, [star(1.5, 1, 12)]) for i in range(30)]
    a, b = layer(spark, left), layer(spark, right)
    got = {w: {r.fid: r.a for r in P.overlay(a, b, w).select("fid", G.area(F.col("rings")).alias("a")).collect()} for w in ("union", "intersection")}
    for i in range(30):
        one, two = shoelace(left[i][1][0]), shoelace(right[i][1][0])
        assert got["union"][i] + got["intersection"][i] == pytest.approx(one + two, abs=1e-4)
        assert max(one, two) - 1e-5 <= got["union"][i] and got["intersection"][i] <= min(one, two) + 1e-5


def test_repair(spark):
    rows = [(1, [[(0, 0), (2, 2), (2, 0), (0, 2)]]), (2, [square(0, 0, 4), square(1, 1, 1)[::-1]]), (3, [square(0, 0, 2), square(2, 2, 1)]), (4, [[(0, 0), (1, 1)]])]
    assert areas(P.repair(layer(spark, rows))) == {1: (2, 2), 2: (15, 2), 3: (5, 2), 4: (0, 0)}


def test_dissolve_and_boundaries(spark):
    cells = [(i, j) for i in range(4) for j in range(3) if (i, j) != (1, 1)]
    ring = layer(spark, [(1, [square(i, j, 1)]) for i, j in cells])
    assert areas(P.dissolve(ring, "fid")) == areas(P.dissolve(ring, "fid", matched=True)) == {1: (11, 2)}
    halves = layer(spark, [(i // 2, [square(i, j, 1)]) for i, j in cells])
    lines = P.boundary_lines(halves, "fid")
    length = {(r.a, r.b): r.n for r in lines.groupBy("a", "b").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("n")).collect()}
    assert length == {(0, 1): pytest.approx(2), (0, None): pytest.approx(10), (1, None): pytest.approx(8)}
    # An outline with a notch where a neighbour's corner lies on the middle of its edge.
    mixed = layer(spark, [(1, [square(0, 0, 2)]), (1, [square(2, 0.5, 1)]), (1, [square(0.5, 0.5, 1)])])
    assert areas(P.dissolve(mixed, "fid")) == {1: (5, 1)}


def test_buffer(spark):
    circle = [(3 * math.cos(2 * math.pi * i / 400), 3 * math.sin(2 * math.pi * i / 400)) for i in range(400)]
    shapes = layer(spark, [(1, [square(0, 0, 2)]), (2, [square(0, 0, 6), square(2, 2, 2)[::-1]]), (3, [circle]), (4, [square(0, 0, 0.5)]), (5, [])])
    sector = 4 * 8 * 0.5 * math.sin(math.pi / 16)
    grown, shrunk = areas(P.buffer(shapes, 1.0)), areas(P.buffer(shapes, -0.5))
    assert grown.pop(3)[0].expected == pytest.approx(16 * math.pi, rel=2e-4) and shrunk.pop(3)[0].expected == pytest.approx(6.25 * math.pi, rel=2e-4)
    assert grown == {1: (4 + 8 + sector, 1), 2: (36 + 24 + sector, 1), 4: (0.25 + 2 + sector, 1), 5: (0, 0)}
    assert shrunk == {1: (1, 1), 2: (25 - (4 + 4 + sector / 4), 2), 4: (0, 0), 5: (0, 0)}


def test_closing(spark):
    two = layer(spark, [(1, [square(0, 0, 4)]), (1, [square(5, 0, 4)]), (2, [square(0, 0, 4)]), (2, [square(9, 0, 4)])])
    got = {r.fid: (r.a, len(r.rings)) for r in P.closed_outline(two, 1.0, quadrant=32).select("*", G.area(F.col("rings")).alias("a")).collect()}
    cap = math.asin(0.5) - 0.5 * math.sqrt(0.75)  # a disc of radius 1 that rests on both corners of the gap
    assert got[1][0] == pytest.approx(36 - 2 * cap, abs=5e-3) and got[1][1] == 1
    assert got[2][0] == pytest.approx(32, abs=5e-3) and got[2][1] == 2


def line(spark, *rows):
    return spark.createDataFrame([(kind, [[{"x": float(x), "y": float(y)} for x, y in points]]) for kind, points in rows], f"kind string, rings {G.RINGS}")


def test_touched_cells(spark):
    t = Affine(e=1.0)
    cells = lambda *rows: {(r.r, r.c) for r in O.burn_lines(line(spark, *rows), t).collect()}
    assert cells(("LineString", [(0.05, 0.9), (1.9, 1.05)])) == {(0, 0), (0, 1), (1, 1)}
    assert cells(("LineString", [(0.5, 0.5), (3.5, 0.5), (3.5, 2.5)])) == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3)}
    assert cells(("Point", [(2.5, 1.5)])) == {(1, 2)}
    assert cells(("LineString", [(0.0, 0.0), (3.0, 3.0)])) == {(0, 0), (1, 1), (2, 2)}
    assert cells(("LineString", [(1.0, 0.2), (1.0, 1.8)])) == {(0, 1), (1, 1)}
    assert cells(("LineString", [(0.5, 0.5), (0.5, 0.5)])) == {(0, 0)} and cells(("LineString", [])) == set()
    assert cells(("Polygon", [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5)])) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    rng = random.Random(5)
    for _ in range(4):
        points = [(rng.uniform(-3, 9), rng.uniform(-3, 9)) for _ in range(6)]
        fine = {(math.floor(p[1] + (q[1] - p[1]) * k / 20000), math.floor(p[0] + (q[0] - p[0]) * k / 20000)) for p, q in zip(points, points[1:]) for k in range(20001)}
        got = cells(("LineString", points))
        assert fine <= got and len(got - fine) <= 1  # the fine points may miss a corner's sliver


def test_all_touched(spark):
    inner = layer(spark, [(1, [square(1.25, 1.25, 0.5)]), (2, [square(3.5, 3.5, 3)])])
    got = {(r.r, r.c) for r in O.burn_all_touched(inner, Affine(e=1.0), 6, 6).collect()}
    assert got == {(1, 1)} | {(r, c) for r in range(3, 6) for c in range(3, 6)}


def test_cells_of_polygons(spark):
    """Each cell as a plain clip gives it; part sums, holes, turned axes."""
    from lodestone.operators.recovery import polygon_cells

    rng = random.Random(11)
    rows = []
    for i in range(40):
        far = [rng.uniform(1, 30 if i == 0 else 5) for _ in range(rng.randint(3, 9))]
        at = sorted(rng.uniform(0, 2 * math.pi) for _ in far)
        ring = [(rng.uniform(-3, 3) + d * math.cos(a), d * math.sin(a)) for d, a in zip(far, at)]
        rows.append((i // 2, [ring if i % 3 else ring[::-1]]))
    rows += [(90, [square(0, 0, 4), square(1, 1, 2)[::-1]]), (91, [square(0.5, 0.5, 2), square(4, 0, 1.5)]), (92, [[(0, 0), (1, 1)]]), (93, None), (94, [])]
    for t in (Affine(e=1.0), Affine(a=0.5, c=-20.0, e=-0.25, f=40.0)):
        want = {}
        for key, rings in rows:
            rings = [[{"x": x, "y": y} for x, y in r] for r in rings or []]
            if not rings:
                continue
            corners = [t.to_cell(p["x"], p["y"]) for r in rings for p in r]
            for r in range(math.floor(min(v for v, _ in corners)), math.ceil(max(v for v, _ in corners))):
                for c in range(math.floor(min(u for _, u in corners)), math.ceil(max(u for _, u in corners))):
                    (xa, ya), (xb, yb) = t.to_map(r, c), t.to_map(r + 1, c + 1)
                    want[key, r, c] = want.get((key, r, c), 0.0) + G.rings_in_box(rings, min(xa, xb), max(xa, xb), min(ya, yb), max(ya, yb))
        got = {(r.dep_id, r.r, r.c): r.area for r in polygon_cells(layer(spark, rows).withColumnRenamed("fid", "dep_id"), t).collect()}
        assert {k for k, v in want.items() if v > 1e-9} <= got.keys()
        assert all(v == pytest.approx(want.get(k, 0.0), abs=1e-9) for k, v in got.items())


def test_clipping_reads_each_number_once(spark):
    """The plan of a clip stays small: formulas written out again and again made it, and its work, many times larger."""
    a = G.clip_area(F.col("rings"), *[F.col(c) for c in ("x0", "x1", "y0", "y1")])
    df = spark.createDataFrame([([[{"x": 0.0, "y": 0.0}]], 0.0, 1.0, 0.0, 1.0)], f"rings {G.RINGS}, x0 double, x1 double, y0 double, y1 double")
    assert len(df.select(a)._jdf.queryExecution().analyzed().toString()) < 12_000


def test_many_overlapping_polygons(spark, monkeypatch):
    """More polygons than a batch: the union of discs and squares, and no arrangement of more than a batch's edges."""
    sizes, real = [], P.split
    monkeypatch.setattr(P, "split", lambda e: sizes.append(e.groupBy("gid").count().agg(F.max("count")).first()[0]) or real(e))
    rng = random.Random(7)
    disc = lambda x, y: [(x + 2 * math.cos(math.pi * i / 6), y + 2 * math.sin(math.pi * i / 6)) for i in range(12)]
    heap = [(1, [disc(rng.uniform(0, 1), rng.uniform(0, 1))]) for _ in range(40)]
    row = [(2, [square(i, i % 2, 1.5)]) for i in range(40)] + [(2, [square(3, 1, 1.5)])] * 30
    ring = [(3, [square(i, 0, 1)]) for i in range(20)] + [(3, [square(i, 5, 1)]) for i in range(20)] + [(3, [square(i, j, 1)]) for i in (0, 19) for j in range(1, 5)]
    # A bow tie's lobes run both ways; the one that runs backwards doesn't take the square away.
    tie = [(4, [[(0, 0), (2, 2), (2, 0), (0, 2)]]), (4, [square(0, 0.5, 1)])]
    got = areas(P.dissolve(layer(spark, heap + row + ring + tie), "fid"))
    assert max(sizes) < 40 * 12
    one = P.combined(layer(spark, heap).select(F.col("fid").alias("gid"), F.lit(0).alias("side"), "rings"), "first")
    assert got[1][0].expected == pytest.approx(areas(one.withColumnRenamed("gid", "fid"))[1][0].expected, abs=1e-5)
    overlap = 39 * 0.5 * 0.5
    assert got[2] == (pytest.approx(40 * 2.25 - overlap, abs=1e-5), 1) and got[3] == (pytest.approx(48, abs=1e-5), 2)
    assert got[4][0].expected == pytest.approx(2.25, abs=1e-5)


def test_odd_polygons_in_a_union(spark):
    got = areas(P.dissolve(layer(spark, [(1, None), (1, []), (2, [square(0, 0, 1)]), (2, None), (3, [square(0, 0, 2), square(0.5, 0.5, 1)[::-1]]), (4, [[(0, 0), (1, 1)]]), (5, [[(0, 0), (2, 0), (2, 0), (2, 2), (0, 2), (0, 0)]])]), "fid"))
    assert got == {1: (0, 0), 2: (1, 1), 3: (3, 2), 4: (0, 0), 5: (4, 1)}


def test_convex_buffers_need_no_arrangement(spark, monkeypatch):
    """Lone convex polygons, whichever way they run, never come to the arrangement; others do, with the same result."""
    sent, real = [], P.split
    monkeypatch.setattr(P, "split", lambda e: sent.append({r.gid for r in e.select("gid").distinct().collect()}) or real(e))
    hexagon = [(3 * math.cos(math.pi * i / 3), 3 * math.sin(math.pi * i / 3)) for i in range(6)]
    plain = [(1, [square(0, 0, 2)]), (2, [square(0, 0, 2)[::-1]]), (3, [hexagon + hexagon[:1]])]
    corner = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]
    sector = 4 * 8 * 0.5 * math.sin(math.pi / 16)
    arcs = 6 * 6 * 0.5 * math.sin(math.pi / 18)
    want = {1: (4 + 8 + sector, 1), 2: (4 + 8 + sector, 1), 3: (pytest.approx(13.5 * math.sqrt(3) + 18 + arcs, abs=1e-5), 1)}
    got = P.buffer(layer(spark, plain), 1.0)
    assert areas(got) == want and not sent
    assert all(signed(r.rings[0]) < 0 for r in got.collect())  # outlines run clockwise
    more = areas(P.buffer(layer(spark, [(4, [corner]), (1, [square(0, 0, 2)])]), 1.0))
    assert more[1] == want[1] and more[4] == (pytest.approx(5 + 11 + 5 * 8 * 0.5 * math.sin(math.pi / 16), abs=1e-5), 1)
    assert sent and 1 not in set().union(*sent)


def signed(ring):
    return sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1])) / 2
