"""The 10 x 10 example grid: published ranking, and values computed apart with plain arrays."""

import numpy as np
import pytest

from lodestone.functions.geometry import Affine
from lodestone.operators import linalg, ranking, recovery
from lodestone.operators.ordering import top
from lodestone.operators.windows import Shape, windows, windows_sql, with_reference

SHAPE = Shape(10, 10, 2, 2)


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(4)
    return rng.normal(size=(10, 10)).round(6)


@pytest.fixture(scope="module")
def cells(spark, grid):
    return spark.createDataFrame([(r, c, float(grid[r, c])) for r in range(10) for c in range(10)], "r int, c int, x double")


@pytest.fixture(scope="module")
def frame(cells):
    return with_reference(windows(cells, SHAPE, ["x"]), 40).cache()


@pytest.fixture(scope="module")
def matrix(grid):
    x = np.array([grid[r : r + 2, c : c + 2].ravel() for r in range(9) for c in range(9)])
    return np.vstack([x, x[40]])


def order(df, by="dist", k=8):
    return [r.window_id for r in top(df, k, [by, "window_id"]).orderBy("rank").collect()]


def model(x, ddof=1):
    z = (x - x.mean(0)) / x.std(0, ddof=ddof)
    u, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    return z @ vt.T, s**2 / (len(x) - ddof)


def test_shape_of_the_matrix(frame, matrix):
    assert frame.count() == 82 and len(frame.first()["x"]) == 4
    got = {r.window_id: r.x for r in frame.collect()}
    assert all(np.allclose(got[i], matrix[i]) for i in range(81)) and np.allclose(got[-1], matrix[40])


def test_both_window_forms_agree(cells):
    a = {(r.window_id, r.r0, r.c0): r.x for r in windows(cells, SHAPE, ["x"], band=3).collect()}
    b = {(r.window_id, r.r0, r.c0): r.x for r in windows_sql(cells, SHAPE, "x").collect()}
    assert a == b


@pytest.mark.parametrize("k", [1, 2, 4])
@pytest.mark.parametrize("mode", ["square", "abs", "uniform"])
@pytest.mark.parametrize("whiten", [False, True])
def test_weighted_distance(frame, matrix, k, mode, whiten):
    z, lam = model(matrix)
    w = {"square": z[-1] ** 2, "abs": abs(z[-1]), "uniform": np.ones(4)}[mode][:k]
    w = w / w.sum() if mode != "uniform" else w
    s = np.sqrt(lam[:k]) if whiten else 1
    want = np.sqrt((w * ((z[:, :k] - z[-1, :k]) / s) ** 2).sum(1))[:-1]
    got = {r.window_id: r.dist for r in ranking.rank_components(frame, k=k, mode=mode, whiten=whiten).collect()}
    assert np.allclose([got[i] for i in range(81)], want, atol=1e-9)


def test_rotation_identity_and_ddof(frame):
    full = {r.window_id: r.dist for r in ranking.rank_components(frame, mode="uniform").collect()}
    raw = {r.window_id: r.dist for r in ranking.rank_raw(frame).collect()}
    pop = {r.window_id: r.dist for r in ranking.rank_components(frame, mode="uniform", ddof=0).collect()}
    assert all(abs(full[i] - raw[i]) < 1e-9 for i in raw)
    assert all(abs(pop[i] - raw[i] * np.sqrt(82 / 81)) < 1e-9 for i in raw)


def test_all_and_selected_weights_give_one_order(frame):
    assert order(ranking.rank_components(frame, k=2, over="all")) == order(ranking.rank_components(frame, k=2))


def test_sweep_of_k_equals_single_runs(frame):
    sweep = ranking.sweep_k(frame, [1, 2, 3, 4]).cache()
    for k in (1, 2, 3, 4):
        one = {r.window_id: r.dist for r in ranking.rank_components(frame, k=k).collect()}
        many = {r.window_id: r.dist for r in sweep.where(f"k = {k}").collect()}
        assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 for i in one)


def test_missing_cells_drop_windows(spark, cells):
    holed = cells.where("not (r = 4 and c = 4)")
    ids = {r.window_id for r in windows(holed, SHAPE, ["x"]).collect()}
    assert set(range(81)) - ids == {3 * 9 + 3, 3 * 9 + 4, 4 * 9 + 3, 4 * 9 + 4}
    assert windows(cells.limit(0), SHAPE, ["x"]).count() == 0


def test_recovery_and_null(spark):
    """Windows 40, 67, 12, ... of the example recover footprints 12, 48 and 51 as a plain loop says."""
    ids = [40, 12, 52, 31, 48, 70, 21, 61]
    ranked = spark.createDataFrame([(i + 1, w // 9, w % 9) for i, w in enumerate(ids)], "rank long, r0 int, c0 int")
    boxes = spark.createDataFrame([(w, w % 9.0, w % 9 + 2.0, w // 9 + 0.0, w // 9 + 2.0) for w in (12, 48, 51)], "dep_id int, x0 double, x1 double, y0 double, y1 double")
    cells = recovery.box_cells(boxes, Affine(e=1.0))
    g, a = recovery.gains(ranked, cells, 2, 2), recovery.areas(cells)
    curve = [r.total_fraction for r in recovery.curve(g, a, 8).orderBy("rank").collect()]
    assert np.allclose(curve, np.array([1, 5, 7, 7, 10, 10, 10, 10]) / 12)
    hits = {r.dep_id: r.first_hit for r in recovery.first_hits(recovery.coverage(g, a), 0.5).collect()}
    assert hits == {12: 2, 51: 3, 48: 5}
    events = {(r["rank"], r.dep_id) for r in recovery.events(ranked, cells, recovery.coverage(g, a), 2, 2, 0.5).collect()}
    assert events == {(1, 48), (2, 12), (3, 51), (5, 48), (7, 12), (8, 51)}
    every = spark.createDataFrame([(w // 9, w % 9) for w in range(81)], "r0 int, c0 int")
    null = {r["rank"]: r.expected for r in recovery.null_curve(recovery.cover_counts(cells, every, 2, 2, 1, 1), 81, 8).collect()}
    assert abs(null[1] - 0.04938272) < 1e-7 and abs(null[8] - 0.34579321) < 1e-7
    grid = spark.createDataFrame([(r, c) for r in range(10) for c in range(10)], "r int, c int")
    union = {r["rank"]: r.expected_area for r in recovery.null_union(recovery.cover_counts(grid, every, 2, 2, 1, 1), 81, 8).collect()}
    assert abs(union[1] - 4) < 1e-9 and abs(union[8] - 28.57027180) < 1e-7


def test_partitions_do_not_matter(frame):
    a = order(ranking.rank_components(frame.repartition(1), k=3), k=20)
    assert a == order(ranking.rank_components(frame.repartition(8), k=3), k=20)


def test_constant_column_and_missing_values(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], i == 3) for i in range(5)], "window_id long, x array<double>, is_ref boolean")
    assert linalg.moments(df).sd().tolist()[0] == 1.0
    bad = spark.createDataFrame([(1, [1.0, float("nan")], True)], "window_id long, x array<double>, is_ref boolean")
    with pytest.raises(Exception, match="missing"):
        linalg.moments(bad)
    with pytest.raises(ValueError, match="reference"):
        ranking.rank_raw(df.where("not is_ref"))
