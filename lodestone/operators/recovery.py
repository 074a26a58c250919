"""How well top-ranked windows recover known footprints, and what a random selection would recover.

Windows are made of whole cells, so unions need no polygon arithmetic: a footprint is cut into cells with the area it has
in each, a window names the cells it covers, and a cell is recovered at the smallest rank that covers it. All of it is
grouping and running sums, independent of order and partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Affine, area, held_mean, signed_area


def window_cells(windows: DataFrame, h: int, w: int, *keep: str) -> DataFrame:
    """(r, c, kept columns) for every cell of every window."""
    rows = windows.withColumn("r", F.explode(F.sequence(F.col("r0"), F.col("r0") + h - 1)))
    return rows.withColumn("c", F.explode(F.sequence(F.col("c0"), F.col("c0") + w - 1))).select("r", "c", *keep)


def box_cells(boxes: DataFrame, t: Affine = Affine(), key: str = "dep_id") -> DataFrame:
    """(key, r, c, area) of footprints that are map boxes x0, x1, y0, y1; only DataFrame functions."""
    row_a, col_a = t.to_cell(F.col("x0"), F.col("y0"))
    row_b, col_b = t.to_cell(F.col("x1"), F.col("y1"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b)), F.ceil(F.greatest(a, b)) - 1))
    cells = boxes.withColumn("r", span(row_a, row_b)).withColumn("c", span(col_a, col_b))
    xa, ya = t.to_map(F.col("r"), F.col("c"))
    xb, yb = t.to_map(F.col("r") + 1, F.col("c") + 1)
    side = lambda lo, hi, a, b: F.least(F.col(hi), F.greatest(a, b)) - F.greatest(F.col(lo), F.least(a, b))
    cells = cells.withColumn("area", side("x0", "x1", xa, xb) * side("y0", "y1", ya, yb))
    return cells.where("area > 0").select(key, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "area")


#: Rows of cells of a polygon that one task takes at least.
BAND = 16


def polygon_cells(polygons: DataFrame, t: Affine = Affine(), key: str = "dep_id") -> DataFrame:
    """(key, r, c, area) of polygons (column rings), added over the parts of one key.

    Each edge is cut to the rows that it crosses, and gives every cell from the polygon's first column up to its own place
    the area that lies on its left there, with the sign of its way; a cell's sum is the part inside. So work follows rows that
    edges cross, and cells, and no cell looks at edges of other rows. Edges are dealt by bands of rows.
    """
    inner = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(*[v.alias(n) for v, n in zip(t.to_cell(p["x"], p["y"]), "yx")])))
    placed = polygons.select(key, F.xxhash64("rings").alias("part"), inner.alias("rings"))
    sign = F.signum(signed_area(F.get("rings", F.lit(0))))
    rings = placed.select(key, "part", sign.alias("sign"), F.floor(F.array_min(F.transform(F.flatten("rings"), lambda p: p["x"]))).alias("c0"), F.explode("rings").alias("ring")).where((F.size("ring") > 2) & (F.col("sign") != 0))
    edges = rings.select(key, "part", "sign", "c0", "ring", F.posexplode("ring").alias("i", "p"))
    edges = edges.withColumn("q", F.element_at("ring", (F.col("i") + 1) % F.size("ring") + 1)).where("p.y != q.y")
    up = F.col("p.y") < F.col("q.y")
    pick = lambda a, b, c: F.when(up, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))
    edges = edges.select(key, "part", "c0", F.when(up, F.col("sign")).otherwise(-F.col("sign")).alias("sign"), *[pick(*w, c).alias(f"{c}{k}") for k, w in enumerate(("pq", "qp"), 1) for c in "xy"])
    first, last = F.floor("y1"), F.ceil("y2") - 1
    bands = edges.withColumn("band", F.explode(F.sequence(F.floor(first / BAND), F.floor(last / BAND)))).repartition(key, "band")
    rows = bands.withColumn("r", F.explode(F.sequence(F.greatest(first, F.col("band") * BAND), F.least(last, F.col("band") * BAND + (BAND - 1)))))
    rows = rows.withColumns({"low": F.greatest("y1", "r"), "high": F.least("y2", F.col("r") + 1)})
    at = lambda y: F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rows = rows.select(key, "part", "band", "r", "c0", (F.col("sign") * (F.col("high") - F.col("low"))).alias("rise"), at("low").alias("a"), at("high").alias("b"))
    rows = rows.select(key, "part", "band", "r", "c0", "rise", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cells = rows.withColumn("c", F.explode(F.sequence("c0", F.greatest(F.col("c0"), F.ceil("b") - 1))))
    part = F.col("rise") * held_mean(F.col("a") - F.col("c"), F.col("b") - F.col("c"), F.lit(1.0))
    # A part's own sums come first: what its rings enclose the wrong way takes nothing from other parts.
    found = cells.groupBy(key, "part", "band", "r", "c").agg((F.sum(part) * float(abs(t.a * t.e - t.b * t.d))).alias("area")).where("area > 0")
    found = found.groupBy(key, "band", "r", "c").agg(F.sum("area").alias("area"))
    return found.select(key, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "area")


def areas(cells: DataFrame, key: str = "dep_id") -> DataFrame:
    return cells.groupBy(key).agg(F.sum("area").alias("dep_area"))


def gains(ranked: DataFrame, cells: DataFrame, h: int, w: int, key: str = "dep_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, rank, gain): the area of each footprint that is first covered at a rank. ranked has rank, r0, c0, and in
    by the columns that tell several rankings apart."""
    covered = window_cells(ranked, h, w, "rank", *by).join(cells, ["r", "c"]).groupBy(*by, key, "r", "c").agg(F.min("rank").alias("rank"), F.max("area").alias("area"))
    return covered.groupBy(*by, key, "rank").agg(F.sum("area").alias("gain"))


def coverage(gained: DataFrame, dep_areas: DataFrame, key: str = "dep_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, rank, covered, fraction) at each rank that adds to a footprint."""
    run = Window.partitionBy(*by, key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return gained.withColumn("covered", F.sum("gain").over(run)).join(dep_areas, key).select(*by, key, "rank", "covered", (F.col("covered") / F.col("dep_area")).alias("fraction"))


def first_hits(covered: DataFrame, min_cover: float, key: str = "dep_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, first_hit): the smallest rank with min_cover of the footprint covered."""
    return covered.where(F.col("fraction") >= min_cover - 1e-9).groupBy(*by, key).agg(F.min("rank").alias("first_hit"))


def curve(gained: DataFrame, dep_areas: DataFrame, t_max: int, key: str = "dep_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rank, recovered_area, total_fraction, mean_fraction) for ranks 1 to t_max; with by, of each ranking that gains."""
    total = dep_areas.agg(F.sum("dep_area").alias("all_area"), F.count(F.lit(1)).alias("deps"))
    per_rank = gained.join(dep_areas, key).groupBy(*by, "rank").agg(F.sum("gain").alias("gain"), F.sum(F.col("gain") / F.col("dep_area")).alias("share"))
    one = gained.select(*by).distinct() if by else gained.sparkSession.range(1)
    ranks = one.select(*by, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(t_max).cast("long"))).alias("rank"))
    rows = ranks.join(per_rank, [*by, "rank"], "left").na.fill(0.0, ["gain", "share"]).join(F.broadcast(total))  # one row
    run = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # t_max rows
    area_, share = F.sum("gain").over(run), F.sum("share").over(run)
    return rows.select(*by, "rank", area_.alias("recovered_area"), (area_ / F.col("all_area")).alias("total_fraction"), (share / F.col("deps")).alias("mean_fraction"))


def hit_table(covered: DataFrame, min_cover: float, key: str = "dep_id") -> DataFrame:
    """(rank, hits, cumulative_hits, deps): ranks at which footprints are hit, with their ids in order."""
    hits = first_hits(covered, min_cover, key).groupBy(F.col("first_hit").alias("rank")).agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ",").alias("deps"))
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most one row a footprint
    return hits.select("rank", "hits", F.sum("hits").over(run).alias("cumulative_hits"), "deps")


def events(ranked: DataFrame, cells: DataFrame, covered: DataFrame, h: int, w: int, min_cover: float, key: str = "dep_id") -> DataFrame:
    """(rank, key, kind): kind is "hit" where the rank hits the footprint first, else "overlap"."""
    touch = window_cells(ranked, h, w, "rank").join(cells, ["r", "c"]).select("rank", key).distinct()
    hits = first_hits(covered, min_cover, key).select(key, F.col("first_hit").alias("rank"), F.lit("hit").alias("kind"))
    return touch.join(hits, [key, "rank"], "left").select("rank", key, F.coalesce("kind", F.lit("overlap")).alias("kind"))


def auc_unit(x: str, y: str) -> Column:
    """For an aggregation: trapezoid of y over x scaled to 0..1, from a curve's ranks."""
    points = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y"))))
    return trapezoid(points) / F.greatest(F.max(x) - F.min(x), F.lit(1))


def auc_ranks(x: str, y: str) -> Column:
    """For an aggregation: trapezoid of y over ranks."""
    return trapezoid(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")))))


def trapezoid(points: Column) -> Column:
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.size(points)), lambda p, q: (q["x"] - p["x"]) * (p["y"] + q["y"]) / 2)
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)


def aucs(curves: DataFrame, group: list[str] | None = None, budget: int = 250) -> DataFrame:
    """The three areas: of the total fraction over unit x, of it over ranks, and the sum of mean fractions scaled to a
    budget of ranks. Curves have as many points as ranks, so a group's points fit one row."""
    g = curves.groupBy(*(group or []))
    return g.agg(auc_unit("rank", "total_fraction").alias("auc_unit"), auc_ranks("rank", "total_fraction").alias("auc_ranks"), (F.sum("mean_fraction") * F.lit(float(budget)) / F.count(F.lit(1))).alias("auc_sum"))


def summary(curves: DataFrame, hits: DataFrame, group: list[str], budgets: tuple[int, ...] = (25, 50, 100, 250), key: str = "dep_id") -> DataFrame:
    """One row a group: areas, end of the curve, hits (footprints and ranks), first and mean hit rank, sum of 1 / rank,
    mean fraction at each budget."""
    ends = curves.groupBy(*group).agg(
        auc_unit("rank", "total_fraction").alias("auc"), F.max_by("mean_fraction", "rank").alias("end_fraction"),
        *[F.max(F.when(F.col("rank") <= b, F.col("mean_fraction"))).alias(f"recovery_at_{b}") for b in budgets],
    )
    found = hits.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_distinct("first_hit").alias("n_hit_ranks"), F.min("first_hit").alias("first_hit"),
        F.avg("first_hit").alias("mean_hit"), F.sum(1 / F.col("first_hit")).alias("sum_inverse_rank"),
    )
    return ends.join(found, group, "left").na.fill(0, ["n_hits", "n_hit_ranks"])


def by_k(ranked: DataFrame, cells: DataFrame, h: int, w: int, t_max: int, min_cover: float) -> DataFrame:
    """summary of every k of a sweep at once; ranked has k, rank, r0, c0, cells are those of the footprints."""
    from .ordering import cut

    gained, dep_areas = cut(gains(ranked, cells, h, w, by=("k",))), areas(cells)
    covered = coverage(gained, dep_areas, by=("k",))
    return summary(curve(gained, dep_areas, t_max, by=("k",)), first_hits(covered, min_cover, by=("k",)), ["k"], tuple(b for b in (25, 50, 100, 250) if b <= t_max))


def union_area(ranked: DataFrame, h: int, w: int, t_max: int, cell_area: float = 1.0) -> DataFrame:
    """(rank, union_area): area covered by the first windows together."""
    fresh = window_cells(ranked, h, w, "rank").groupBy("r", "c").agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    ranks = ranked.sparkSession.range(1, t_max + 1).select(F.col("id").alias("rank"))
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # t_max rows
    return ranks.join(fresh, "rank", "left").select("rank", (F.sum(F.coalesce("n", F.lit(0))).over(run) * float(cell_area)).alias("union_area"))


# The exact expectation of a random selection.


def cover_counts(cells: DataFrame, windows: DataFrame, h: int, w: int, sy: int, sx: int) -> DataFrame:
    """cells with m, the number of windows that cover each. A cell asks for the h / sy * w / sx starts that could."""
    low = lambda at, size, step: F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / step)).cast("int")
    high = lambda at, step: F.floor(F.col(at) / step).cast("int")
    keys = [c for c in cells.columns if c != "area"]
    asks = cells.select(*keys).distinct()
    asks = asks.withColumn("r0", F.explode(F.transform(F.sequence(low("r", h, sy), high("r", sy)), lambda i: i * sy)))
    asks = asks.withColumn("c0", F.explode(F.transform(F.sequence(low("c", w, sx), high("c", sx)), lambda i: i * sx)))
    counts = asks.join(windows.select("r0", "c0").distinct(), ["r0", "c0"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    return cells.join(counts, keys, "left").na.fill(0, ["m"])


def uncovered(weights: DataFrame, n: int, t_max: int) -> DataFrame:
    """(rank, m, q) for each m in weights: chance that none of `rank` windows, drawn of n without repetition, is among m.

    q is the running product of (n - m - j) / (n - j); as a sum of logarithms, and 0 once no other window is left.
    """
    t_max = min(t_max, n)
    steps = weights.select("m").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(t_max - 1))))
    left = n - F.col("m") - F.col("j")
    run = Window.partitionBy("m").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    log = F.sum(F.when(left > 0, F.log(left / (n - F.col("j")))).otherwise(0.0)).over(run)
    return steps.select((F.col("j") + 1).cast("long").alias("rank"), "m", F.when(F.min(left).over(run) <= 0, 0.0).otherwise(F.exp(log)).alias("q"))


def null_curve(counted: DataFrame, n: int, t_max: int, key: str = "dep_id") -> DataFrame:
    """(rank, expected): expected mean fraction recovered by random windows. counted has key, area and m of cells."""
    per = counted.groupBy(key, "m").agg(F.sum("area").alias("area"))
    total = counted.groupBy(key).agg(F.sum("area").alias("dep_area"))
    deps = total.count()
    weights = per.join(total, key).groupBy("m").agg((F.sum(F.col("area") / F.col("dep_area")) / deps).alias("weight"))
    return uncovered(weights, n, t_max).join(weights, "m").groupBy("rank").agg(F.sum((1 - F.col("q")) * F.col("weight")).alias("expected"))


def null_union(counted: DataFrame, n: int, t_max: int, cell_area: float = 1.0) -> DataFrame:
    """(rank, expected_area): expected area of the union of random windows. counted has m of the grid's cells."""
    weights = counted.groupBy("m").agg((F.count(F.lit(1)) * float(cell_area)).alias("weight"))
    return uncovered(weights, n, t_max).join(weights, "m").groupBy("rank").agg(F.sum((1 - F.col("q")) * F.col("weight")).alias("expected_area"))


def equal_area(curves: DataFrame, unions: DataFrame, null: DataFrame, null_area: DataFrame) -> DataFrame:
    """(rank, mean_fraction, union_area, matched_t, expected_at_area, ratio): recovery over that of a random selection with
    the same union, linear between ranks."""
    from .joins import interpolate

    both = curves.join(unions, "rank").select("rank", "mean_fraction", "union_area")
    at = interpolate(both, null_area, "union_area", "expected_area", "rank", "matched_t")
    out = interpolate(at, null, "matched_t", "rank", "expected", "expected_at_area")
    return out.withColumn("ratio", F.when(F.col("expected_at_area") > 0, F.col("mean_fraction") / F.col("expected_at_area")))


def polygon_areas(polygons: DataFrame, key: str = "dep_id") -> DataFrame:
    return polygons.select(key, area(F.col("rings")).alias("dep_area"))


def reranked(ranked: DataFrame, pool: DataFrame, t_max: int) -> DataFrame:
    """The first t_max of a ranking's windows that are in pool (window_id), numbered anew."""
    from .ordering import top

    return top(ranked.withColumnRenamed("rank", "old rank").join(pool.select("window_id"), "window_id", "left_semi"), t_max, ["old rank"]).drop("old rank")


def breakpoints(windows: DataFrame, h: int, w: int) -> DataFrame:
    """(axis, at): the distinct rows and columns at which any window begins or ends."""
    ends = F.array(*[F.struct(F.lit(a).alias("axis"), (F.col(c) + d).cast("int").alias("at")) for a, c, d in (("r", "r0", 0), ("r", "r0", h), ("c", "c0", 0), ("c", "c0", w))])
    return windows.select(F.explode(ends).alias("e")).select("e.axis", "e.at").distinct()


def up_to(curve: DataFrame, k: int) -> DataFrame:
    """A curve's first k ranks."""
    return curve.where(F.col("rank") <= k)
