"""Queries that answer for whole tables, on fixtures that a subset would fail."""

from lodestone import plans


def test_all_polygons(spark, sf):
    got = plans.queries()["point_in_polygon"](spark, sf).collect()
    p = plans.geometry.polygons(spark, sf).collect()
    points = plans.geometry.spots(spark, sf).collect()
    assert len(p) == spark.read.parquet(f"{sf}/supplier.parquet").count()

    def holds(rings, x, y):
        inside = False
        for ring in rings:
            for a, b in zip(ring, [*ring[1:], ring[0]]):
                if (a.y > y) != (b.y > y) and x < a.x + (y - a.y) * (b.x - a.x) / (b.y - a.y):
                    inside = not inside
        return inside

    want = {}
    for q in points:
        mine = [r.id for r in p if holds(r.rings, q.x, q.y)]
        want[q.pid] = (min(mine, default=-1), len(mine))
    assert {r.pid: (r.fid, r.n) for r in got} == want


def test_windows_of_all_purchases(spark, tmp_path):
    # Windows 37, 38 (which overlap) and 900; only the first is of a user whose id is a multiple of 16.
    rows = [(1, 0, "purchase"), (174, 3, "purchase"), (500, 5, "purchase"), (3, 0, "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = plans.queries()["window_components"](spark, str(tmp_path)).collect()
    assert {r.window_id: r.group for r in got} == {37: 37, 38: 37, 900: 900}
