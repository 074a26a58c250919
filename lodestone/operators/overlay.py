"""Masks and thematic maps under windows: coverage, distance, enrichment, agreement, groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Affine, bounds, contains
from .graph import components
from .ordering import quantiles
from .recovery import window_cells


def burn(polygons: DataFrame, t: Affine, height: int, width: int, value: str | None = None) -> DataFrame:
    """(r, c[, value]) of cells whose centres lie in a polygon; of several the one of largest fid has its value kept."""
    b = polygons.select("*", bounds(F.col("rings")).alias("b"))
    row_a, col_a = t.to_cell(F.col("b.x0"), F.col("b.y0"))
    row_b, col_b = t.to_cell(F.col("b.x1"), F.col("b.y1"))

    def span(a, z, most):
        lo, hi = F.greatest(F.floor(F.least(a, z)).cast("int"), F.lit(0)), F.least(F.ceil(F.greatest(a, z)).cast("int"), F.lit(most - 1))
        return F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")))

    cells = b.withColumn("r", span(row_a, row_b, height)).withColumn("c", span(col_a, col_b, width))
    x, y = t.to_map(F.col("r") + 0.5, F.col("c") + 0.5)
    cells = cells.withColumn("x", x).withColumn("y", y).where(contains(F.col("rings"), F.col("x"), F.col("y")))
    return cells.groupBy("r", "c").agg(F.max_by(value, "fid").alias(value)) if value else cells.select("r", "c").distinct()


def burn_touched(points: DataFrame, t: Affine) -> DataFrame:
    """(r, c) of cells that hold a point (x, y), as of densified lines."""
    row, col = t.to_cell(F.col("x"), F.col("y"))
    return points.select(F.floor(row).cast("int").alias("r"), F.floor(col).cast("int").alias("c")).distinct()


def crossed_cells(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Cells (r, c) that a straight way passes through; x counts columns and y rows. A way along a border belongs to the
    cells on its right or below, a way of no length to the cell of its point.

    The way is cut where it meets a line between cells; the middle of each piece lies in one cell, whatever the slope.
    """
    zero, one = F.lit(0.0), F.lit(1.0)

    def meetings(a: Column, b: Column) -> Column:
        low, high = F.ceil(F.least(a, b)).cast("long"), F.floor(F.greatest(a, b)).cast("long")
        return F.when((a == b) | (low > high), F.array().cast("array<double>")).otherwise(F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (k - a) / F.when(a != b, b - a)))

    at = F.array_sort(F.array_distinct(F.concat(F.array(zero, one), F.filter(F.concat(meetings(x1, x2), meetings(y1, y2)), lambda t: (t > 0) & (t < 1)))))
    middle = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: (a + b) / 2)
    cell = lambda t: F.struct(F.floor(y1 + t * (y2 - y1)).cast("int").alias("r"), F.floor(x1 + t * (x2 - x1)).cast("int").alias("c"))
    return F.array_distinct(F.transform(middle, cell))


def burn_lines(layer: DataFrame, t: Affine, height: int | None = None, width: int | None = None) -> DataFrame:
    """(r, c) of all cells that lines, outlines or points of a layer (kind, rings) pass through, each once.

    Polygons' rings are closed, lines are not; a ring of one point is a point. Nothing of a line is lost between points, as
    each segment finds its own cells. With height and width cells outside the grid are left out.
    """
    rings = layer.select(F.col("kind"), F.explode("rings").alias("ring")).where(F.size("ring") > 0)
    n = F.size("ring")
    last = F.when(F.col("kind") == "Polygon", n).otherwise(F.greatest(n - 1, F.lit(1)))
    pair = lambda i: F.struct(F.get("ring", i).alias("p"), F.get("ring", F.when(n == 1, 0).otherwise((i + 1) % n)).alias("q"))
    seg = rings.select(F.explode(F.transform(F.sequence(F.lit(0), last - 1), pair)).alias("s"))
    row1, col1 = t.to_cell(F.col("s.p.x"), F.col("s.p.y"))
    row2, col2 = t.to_cell(F.col("s.q.x"), F.col("s.q.y"))
    cells = seg.select(F.explode(crossed_cells(col1, row1, col2, row2)).alias("k")).select("k.r", "k.c")
    if height is not None and width is not None:
        cells = cells.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))
    return cells.distinct()


def burn_all_touched(polygons: DataFrame, t: Affine, height: int, width: int) -> DataFrame:
    """(r, c) of cells of which a polygon (fid, rings) holds any part: those its outline passes, and those inside."""
    outline = burn_lines(polygons.select(F.lit("Polygon").alias("kind"), "rings"), t, height, width)
    return outline.union(burn(polygons, t, height, width)).distinct()


def integral(mask: DataFrame, value: str = "v") -> DataFrame:
    """(r, c, s): sums over all cells above and to the left, the cell included. mask has a row for every cell."""
    down = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy("r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    return mask.withColumn("s", F.sum(F.col(value).cast("double")).over(down)).select("r", "c", F.sum("s").over(right).alias("s"))


def coverage_integral(windows: DataFrame, mask: DataFrame, h: int, w: int, value: str = "v") -> DataFrame:
    """(window_id, cover): share of a window's cells in the mask, from four look-ups in the sums."""
    sums = integral(mask, value)
    corner = windows.select("window_id", F.explode(F.array(*[
        F.struct((F.col("r0") + dr).alias("r"), (F.col("c0") + dc).alias("c"), F.lit(sign).alias("sign"))
        for dr, dc, sign in ((h - 1, w - 1, 1.0), (-1, w - 1, -1.0), (h - 1, -1, -1.0), (-1, -1, 1.0))
    ])).alias("k")).select("window_id", "k.*")
    return corner.join(sums, ["r", "c"], "left").groupBy("window_id").agg((F.sum(F.col("sign") * F.coalesce("s", F.lit(0.0))) / (h * w)).alias("cover"))


def coverage_join(windows: DataFrame, mask: DataFrame, h: int, w: int, value: str = "v") -> DataFrame:
    """The same by joining every cell of every window: for few windows on a large grid."""
    return window_cells(windows, h, w, "window_id").join(mask.select("r", "c", F.col(value).cast("double").alias("v")), ["r", "c"], "left").groupBy("window_id").agg((F.sum(F.coalesce("v", F.lit(0.0))) / (h * w)).alias("cover"))


def enrichment(cover: DataFrame, baseline: float) -> DataFrame:
    """One row: mean cover, its ratio to the baseline, share of windows that touch."""
    return cover.agg(F.count(F.lit(1)).alias("n"), F.avg("cover").alias("mean_cover"), (F.avg("cover") / F.lit(baseline if baseline else None).cast("double")).alias("ratio"), F.avg((F.col("cover") > 0).cast("double")).alias("touching"))


def envelope(at: np.ndarray, height: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lowest value at each x of the parabolas (x - at) ** 2 + height; at and x rise.

    The lowest parabola's place never falls as x grows. So the x in the middle are settled first, and those between two
    settled ones look only at the parabolas between theirs: a round for each halving, each an array operation over about as
    many values as there are parabolas and x.
    """
    n = len(x)
    best = np.zeros(n + 2, dtype=np.int64)  # of x numbered from 1, with an end on either side
    best[n + 1] = len(at) - 1
    out = np.empty(n)
    step = 1 << n.bit_length()
    while step > 1:
        half = step // 2
        i = np.arange(half, n + 1, step)
        low, high = best[i - half], best[np.minimum(i + half, n + 1)]
        sizes = high - low + 1
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(i)), sizes)
        tried = np.arange(sizes.sum()) - starts[owner] + low[owner]
        values = (x[i - 1][owner] - at[tried]) ** 2 + height[tried]
        least = np.minimum.reduceat(values, starts)
        hits = np.flatnonzero(values == least[owner])[::-1]
        best[i[owner[hits]]] = tried[hits]  # the first of equal ones is written last
        out[i - 1] = least
        step = half
    return out


def distance_to(cells: DataFrame, mask: str = "v", cell: float = 1.0) -> DataFrame:
    """(r, c, distance) of every cell to the nearest cell where mask is true; null where there is none.

    Exact, in two passes: distances along each column by looking up and down, then along each row the lower envelope.
    """
    order = Window.partitionBy("c").orderBy("r")
    hit = F.when(F.col(mask), F.col("r"))
    up = F.last(hit, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(hit, True).over(order.rowsBetween(0, Window.unboundedFollowing))
    columns = cells.select("r", "c", F.least(F.col("r") - up, down - F.col("r")).cast("double").alias("g"))

    def along(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c", ignore_index=True)
        c, g = f["c"].to_numpy(np.float64), f["g"].to_numpy(np.float64) ** 2
        known = ~np.isnan(g)
        out = envelope(c[known], g[known], c) if known.any() else np.full(len(f), np.nan)
        return pd.DataFrame({"r": f["r"], "c": f["c"], "distance": np.sqrt(out) * cell})

    got = columns.groupBy("r").applyInPandas(along, "r int, c int, distance double")
    return got.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def sample_at_center(windows: DataFrame, grid: DataFrame, h: int, w: int, height: int, width: int, *columns: str) -> DataFrame:
    """windows with the grid's columns at their centre cells, held within the grid."""
    at = windows.withColumn("r", F.least(F.col("r0") + h // 2, F.lit(height - 1))).withColumn("c", F.least(F.col("c0") + w // 2, F.lit(width - 1)))
    return at.join(grid.select("r", "c", *columns), ["r", "c"], "left").drop("r", "c")


def distance_summary(df: DataFrame, limits: list[float], value: str = "distance", group: list[str] | None = None) -> DataFrame:
    """n, dropped (null), median, mean, and the share within each limit."""
    shares = [F.avg((F.col(value) <= t).cast("double")).alias(f"within_{t:g}") for t in limits]
    median = F.median(value) if group else F.lit(quantiles(df, [value])[0]).cast("double")
    return df.groupBy(*(group or [])).agg(F.count(value).alias("n"), F.sum(F.col(value).isNull().cast("long")).alias("dropped"), median.alias("median"), F.avg(value).alias("mean"), *shares)


def contacts(classes: DataFrame, value: str = "k") -> DataFrame:
    """(r, c, contact): whether a cell's right, left, upper or lower neighbour has another class."""
    rows, cols = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")

    def differs(w, axis, step):
        other, place = F.lag(value, step).over(w), F.lag(axis, step).over(w)
        return F.coalesce((F.col(axis) - place == step) & (other != F.col(value)), F.lit(False))

    return classes.select("r", "c", (differs(rows, "c", 1) | differs(rows, "c", -1) | differs(cols, "r", 1) | differs(cols, "r", -1)).alias("contact"))


def confusion(a: DataFrame, b: DataFrame, x: str = "k") -> DataFrame:
    """(a, b, n): how often cells of one map's class have a class in the other."""
    return a.select("r", "c", F.col(x).alias("a")).join(b.select("r", "c", F.col(x).alias("b")), ["r", "c"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def top_confusions(pairs: DataFrame, k: int = 2) -> DataFrame:
    """For each class of the first map its k most frequent partners and their shares."""
    total = F.sum("n").over(Window.partitionBy("a"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    return pairs.withColumn("share", F.col("n") / total).withColumn("place", place.cast("long")).where(F.col("place") <= k)


def agreement(a: DataFrame, b: DataFrame, x: str = "v") -> DataFrame:
    """One row for two masks: intersection over union, and how much of each the other captures; null over zero."""
    both = a.select("r", "c", F.col(x).alias("a")).join(b.select("r", "c", F.col(x).alias("b")), ["r", "c"])
    one = lambda k: F.sum(k.cast("long"))
    s = both.agg(one(F.col("a") & F.col("b")).alias("both"), one(F.col("a") | F.col("b")).alias("either"), one(F.col("a")).alias("na"), one(F.col("b")).alias("nb"))
    ratio = lambda n: F.when(F.col(n) > 0, F.col("both") / F.col(n))
    return s.select("both", "either", ratio("either").alias("iou"), ratio("na").alias("a_captured"), ratio("nb").alias("b_captured"))


def tally(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mode, its share and the whole tally ("class:n;..." by falling count) of each group."""
    n = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    total, place = F.sum("n").over(Window.partitionBy(*group)), F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))
    placed = n.withColumn("total", total).withColumn("place", place)
    parts = F.sort_array(F.collect_list(F.struct("place", F.concat_ws(":", F.col(value).cast("string"), F.col("n").cast("string")).alias("t"))))
    return placed.groupBy(*group).agg(F.max(F.when(F.col("place") == 1, F.col(value))).alias("mode"), F.max(F.when(F.col("place") == 1, F.col("n") / F.col("total"))).alias("share"), F.array_join(F.transform(parts, lambda p: p["t"]), ";").alias("tally"))


def class_shares(df: DataFrame, unit: str, era: str, value: str) -> DataFrame:
    """Sums by unit within era, by era, and in all (nulls in the names), with shares of the whole."""
    rolled = df.rollup(era, unit).agg(F.sum(value).alias("total"), F.grouping_id().alias("level"))
    whole = df.agg(F.sum(value).alias("w")).first()["w"]
    return rolled.select(era, unit, "level", "total", (F.col("total") / F.lit(whole)).alias("share"))


def window_groups(windows: DataFrame, h: int, w: int) -> DataFrame:
    """(window_id, group): windows that overlap, directly or over others; a group is named by its smallest id.

    Windows are dealt to tiles of h x w cells; two that overlap start in the same or neighbouring tiles.
    """
    t = windows.select("window_id", "r0", "c0", F.floor(F.col("r0") / h).alias("tr"), F.floor(F.col("c0") / w).alias("tc"))
    near = t.withColumn("tr", F.explode(F.array(*[F.col("tr") + d for d in (-1, 0, 1)]))).withColumn("tc", F.explode(F.array(*[F.col("tc") + d for d in (-1, 0, 1)])))
    a, b = t.alias("a"), near.alias("b")
    close = (F.col("a.tr") == F.col("b.tr")) & (F.col("a.tc") == F.col("b.tc")) & (F.col("a.window_id") > F.col("b.window_id")) & (F.abs(F.col("a.r0") - F.col("b.r0")) < h) & (F.abs(F.col("a.c0") - F.col("b.c0")) < w)
    edges = a.join(b, close).select(F.col("a.window_id").alias("a"), F.col("b.window_id").alias("b"))
    return windows.select("window_id").join(components(edges).withColumnRenamed("node", "window_id"), "window_id", "left").select("window_id", F.coalesce("component", "window_id").alias("group"))


def cell_groups(mask: DataFrame, width: int, diagonal: bool = True) -> DataFrame:
    """(r, c, group) of the mask's cells, joined to all eight (or four) neighbours; named by the smallest cell number."""
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * diagonal
    cells = mask.select("r", "c", (F.col("r").cast("long") * width + F.col("c")).alias("cell"))
    moved = cells.select("cell", F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps])).alias("k")).select(F.col("cell").alias("a"), "k.r", "k.c")
    edges = moved.join(cells.withColumnRenamed("cell", "b"), ["r", "c"]).select("a", "b")
    return cells.join(components(edges).withColumnRenamed("node", "cell"), "cell", "left").select("r", "c", F.coalesce("component", "cell").alias("group"))


def group_attributes(groups: DataFrame, classes: DataFrame, cell_area: float = 1.0, step: int = 1, hosts: list | None = None) -> DataFrame:
    """Area, centroid, dominant class and its share of each group of cells; classes read at every step-th cell. With hosts,
    host tells whether the dominant class is one of them."""
    size = groups.groupBy("group").agg((F.count(F.lit(1)) * float(cell_area)).alias("area"), F.avg("r").alias("row"), F.avg("c").alias("col"))
    read = groups.where((F.col("r") % step == 0) & (F.col("c") % step == 0)).join(classes, ["r", "c"])
    out = size.join(tally(read, ["group"], "k"), "group", "left")
    return out if hosts is None else out.withColumn("host", F.coalesce(F.col("mode").isin(hosts), F.lit(False)))


def union_masks(masks: DataFrame, group: str) -> DataFrame:
    """(r, c, group, v): masks of one group as one, true where any of them is."""
    return masks.groupBy("r", "c", group).agg(F.bool_or("v").alias("v"))


def clear_of(ranked: DataFrame, footprints: DataFrame, h: int, w: int) -> DataFrame:
    """Ranked windows that touch no footprint cell (r, c)."""
    return ranked.join(window_cells(ranked, h, w, "rank").join(footprints.select("r", "c").distinct(), ["r", "c"], "left_semi").select("rank").distinct(), "rank", "left_anti")


def closed(mask: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """(r, c) of a mask grown by reach cells (square) and shrunk again: gaps up to twice the reach close."""

    def grown(df: DataFrame) -> DataFrame:
        rows = df.withColumn("r", F.explode(F.sequence(F.greatest(F.col("r") - reach, F.lit(0)), F.least(F.col("r") + reach, F.lit(height - 1)))))
        rows = rows.distinct().withColumn("c", F.explode(F.sequence(F.greatest(F.col("c") - reach, F.lit(0)), F.least(F.col("c") + reach, F.lit(width - 1)))))
        return rows.distinct()

    every = mask.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("r"), (F.col("id") % width).cast("int").alias("c"))
    outside = every.join(grown(mask.select("r", "c")), ["r", "c"], "left_anti")
    return every.join(grown(outside), ["r", "c"], "left_anti")


def overlapping_reference(ranked: DataFrame, r0: int, c0: int, h: int, w: int) -> DataFrame:
    """Ranks whose windows overlap the reference's."""
    return ranked.where((F.abs(F.col("r0") - r0) < h) & (F.abs(F.col("c0") - c0) < w)).select("rank")


def restricted(windows: DataFrame, classes: DataFrame, h: int, w: int, height: int, width: int, keep: list, value: str = "k") -> DataFrame:
    """Windows whose centre cell has one of the classes."""
    return sample_at_center(windows, classes, h, w, height, width, value).where(F.col(value).isin(keep))
