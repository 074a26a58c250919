"""Sliding windows over grids of cells, and the reference templates they are compared with.

Cells come as (r, c, one column a variable). Windows are cut in tiles: every cell goes to the tiles whose windows need it
(one, but for the h - 1 rows and w - 1 columns of overlap), and a tile is cut with array views, so a cell is shuffled about
once instead of once for each window that covers it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Grid size, window size and stride; ids count along rows of the grid padded so that the stride tiles it."""

    height: int
    width: int
    h: int
    w: int
    sy: int = 1
    sx: int = 1

    def __post_init__(self):
        if min(self.height, self.width, self.h, self.w, self.sy, self.sx) < 1:
            raise ValueError("sizes and strides must be 1 at least")

    @property
    def per_row(self) -> int:
        return max(0, -(-(self.width - self.w) // self.sx)) + 1

    @property
    def per_column(self) -> int:
        return max(0, -(-(self.height - self.h) // self.sy)) + 1

    def window_id(self, r0, c0):
        """Id of the window that starts at a cell; of numbers, arrays or columns."""
        return (r0 / self.sy).cast("long") * self.per_row + (c0 / self.sx).cast("long") if hasattr(r0, "cast") else r0 // self.sy * self.per_row + c0 // self.sx

    def start(self, window_id):
        """Row and column of the window with an id (numbers)."""
        return window_id // self.per_row * self.sy, window_id % self.per_row * self.sx


def window_ids(spark, shape: Shape) -> DataFrame:
    """(window_id, r0, c0) of all windows, also those that reach over the edge."""
    n = spark.range(shape.per_row * shape.per_column).withColumnRenamed("id", "window_id")
    return n.select("window_id", (F.floor(F.col("window_id") / shape.per_row) * shape.sy).cast("int").alias("r0"), (F.col("window_id") % shape.per_row * shape.sx).cast("int").alias("c0"))


def no_nan(cells: DataFrame, columns: list[str], nodata: float | None = None) -> DataFrame:
    """Missing values as nulls: NaN, and nodata where given."""
    for c in columns:
        bad = F.isnan(c) | ((F.col(c) == F.lit(nodata)) if nodata is not None else F.lit(False))
        cells = cells.withColumn(c, F.when(F.col(c).isNotNull() & ~bad, F.col(c).cast("double")))
    return cells


#: Numbers that the windows of one tile hold at most, about.
TILE_VALUES = 8_000_000


def windows(cells: DataFrame, shape: Shape, columns: list[str], mask: np.ndarray | None = None, band: int = 64, tile: int | None = None) -> DataFrame:
    """(window_id, r0, c0, one array a variable) of all windows whose cells (those in mask) are present in all variables.

    Null and NaN are missing. Windows over the grid's edge are missing cells; with a mask they may still be whole. Vectors
    run along rows. No rows give no windows; a cell given more than once counts once, with the largest of its values.

    A task holds a tile: the windows that start in band rows and tile columns, by default as many columns as keep a tile's
    windows to a few million numbers, whatever the grid's width. Cells beside a tile go to both.
    """
    names = [f"v{k}" for k in range(len(columns))]
    per_band = max(1, band // shape.sy) * shape.sy
    fit = TILE_VALUES // (shape.h * shape.w * len(columns) * (per_band // shape.sy))
    per_tile = (max(1, tile // shape.sx) if tile else max(1, fit, -(-shape.w // shape.sx))) * shape.sx
    bands, tiles = (shape.per_column * shape.sy - 1) // per_band, (shape.per_row * shape.sx - 1) // per_tile
    keep = np.ones(shape.h * shape.w, dtype=bool) if mask is None else np.asarray(mask, dtype=bool).ravel()

    def parts(at: str, size: int, step: int, last: int):
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1 - (step - 1)) / step)).cast("int")
        high = F.least(F.lit(last), F.floor(F.col(at) / step)).cast("int")
        return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")))

    clean = no_nan(cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)]), names)
    dealt = clean.where((F.col("r") >= 0) & (F.col("c") >= 0)).withColumn("band", parts("r", shape.h, per_band, bands)).withColumn("tile", parts("c", shape.w, per_tile, tiles))

    def cut_tile(key, f):
        top, left = int(key[0]) * per_band, int(key[1]) * per_tile
        rows, cols = min(per_band, shape.per_column * shape.sy - top), min(per_tile, shape.per_row * shape.sx - left)
        grid = np.full((len(names), rows + shape.h - 1, cols + shape.w - 1), np.nan)
        r, c = f["r"].to_numpy() - top, f["c"].to_numpy() - left
        inside = (r >= 0) & (r < grid.shape[1]) & (c >= 0) & (c < grid.shape[2])
        for k, n in enumerate(names):
            np.fmax.at(grid[k], (r[inside], c[inside]), f[n].to_numpy(np.float64)[inside])
        views = np.lib.stride_tricks.sliding_window_view(grid, (shape.h, shape.w), axis=(1, 2))[:, :: shape.sy, :: shape.sx]
        out = []
        for i in range(views.shape[1]):
            flat = views[:, i].reshape(len(names), views.shape[2], -1)[:, :, keep]
            whole = np.flatnonzero(~np.isnan(flat).any(axis=(0, 2)))
            if len(whole):
                r0, c0 = top + i * shape.sy, left + whole * shape.sx
                out.append(pd.DataFrame({"window_id": shape.window_id(r0, c0), "r0": r0, "c0": c0} | {c: list(flat[k, whole]) for k, c in enumerate(columns)}))
        if out:
            return pd.concat(out)
        return pd.DataFrame({"window_id": np.zeros(0, np.int64), "r0": np.zeros(0, np.int32), "c0": np.zeros(0, np.int32)} | {c: pd.Series([], dtype=object) for c in columns})

    schema = "window_id long, r0 int, c0 int" + "".join(f", `{c}` array<double>" for c in columns)
    return dealt.groupBy("band", "tile").applyInPandas(cut_tile, schema)


def windows_sql(cells: DataFrame, shape: Shape, column: str) -> DataFrame:
    """The same for one variable with DataFrame functions alone: each cell names the windows that cover it. Shuffles a
    cell h * w / (sy * sx) times, so it suits small windows; each cell must be given once."""

    def starts(at: str, size: int, step: int, count: int):
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / step)).cast("int")
        high = F.least(F.lit(count - 1), F.floor(F.col(at) / step)).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    named = no_nan(cells.select("r", "c", F.col(column).alias("v")), ["v"]).where("v is not null")
    long = named.withColumn("i", F.explode(starts("r", shape.h, shape.sy, shape.per_column))).withColumn("k", F.explode(starts("c", shape.w, shape.sx, shape.per_row)))
    long = long.withColumn("j", ((F.col("r") - F.col("i") * shape.sy) * shape.w + F.col("c") - F.col("k") * shape.sx).cast("int"))
    groups = long.groupBy("i", "k").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("s")).where(F.size("s") == shape.h * shape.w)
    return groups.select((F.col("i") * shape.per_row + F.col("k")).cast("long").alias("window_id"), (F.col("i") * shape.sy).cast("int").alias("r0"), (F.col("k") * shape.sx).cast("int").alias("c0"), F.col("s.v").alias(column))


def circle_mask(size_h: int, size_w: int, radius: float, center: tuple[float, float] | None = None) -> np.ndarray:
    """Cells whose centres lie within radius (in cells) of the centre, by squared distance."""
    cy, cx = center if center is not None else (size_h / 2, size_w / 2)
    r, c = np.mgrid[:size_h, :size_w]
    return (r + 0.5 - cy) ** 2 + (c + 0.5 - cx) ** 2 <= radius * radius + 1e-12


def with_reference(frame: DataFrame, window_id: int | None = None, vectors: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Append the reference row: a copy of a window, or given vectors. Its id is -1 and is_ref is true."""
    rows = frame.withColumn("is_ref", F.lit(False))
    if window_id is not None:
        ref = frame.where(F.col("window_id") == window_id).limit(1).withColumn("window_id", F.lit(-1).cast("long")).withColumn("is_ref", F.lit(True))
    else:
        arrays = [F.array(*[F.lit(float(v)) for v in vectors[c]]).alias(c) if c in vectors else F.lit(None).cast(t).alias(c) for c, t in frame.dtypes if c != "window_id"]
        ref = frame.sparkSession.range(1).select(F.lit(-1).cast("long").alias("window_id"), *arrays, F.lit(True).alias("is_ref"))
    return rows.unionByName(ref)


# Templates: small patches, so plain arrays on the driver.


def template(cells: DataFrame, column: str, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
    """Patch of rows r0..r1-1 and columns c0..c1-1; missing cells are NaN."""
    out = np.full((r1 - r0, c1 - c0), np.nan)
    for row in cells.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)).select("r", "c", F.col(column).cast("double").alias("v")).collect():
        if row.v is not None:
            out[row.r - r0, row.c - c0] = row.v
    return out


def circle_template(cells: DataFrame, column: str, t, cx: float, cy: float, radius: float) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Patch about a point of the map, the mask of cells whose centres lie within radius of it, and the patch's first cell.

    The patch has as many cells on each side of the centre's cell as the radius needs; cells beyond the grid are NaN.
    Raises where a cell of the mask is missing.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    row, col = t.to_cell(cx, cy)
    row, col = int(np.round(row - 0.5)), int(np.round(col - 0.5))
    dr, dc = int(np.ceil(radius / abs(t.e))), int(np.ceil(radius / abs(t.a)))
    patch = template(cells, column, row - dr, row + dr + 1, col - dc, col + dc + 1)
    r, c = np.mgrid[row - dr : row + dr + 1, col - dc : col + dc + 1]
    x, y = t.to_map(r + 0.5, c + 0.5)
    mask = (x - cx) ** 2 + (y - cy) ** 2 <= radius * radius + 1e-12
    if np.isnan(patch[mask]).any():
        raise ValueError(f"the circle lacks {int(np.isnan(patch[mask]).sum())} cells of {column}")
    return patch, mask, (row - dr, col - dc)


def bilinear(patch: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values between cell centres; NaN where a needed cell is missing or outside."""
    r, c = np.floor(rows).astype(int), np.floor(cols).astype(int)
    fr, fc = rows - r, cols - c
    out = np.zeros(rows.shape)
    for dr, wr in ((0, 1 - fr), (1, fr)):
        for dc, wc in ((0, 1 - fc), (1, fc)):
            weight = wr * wc
            rr, cc = r + dr, c + dc
            ok = (rr >= 0) & (rr < patch.shape[0]) & (cc >= 0) & (cc < patch.shape[1])
            value = np.where(ok, patch[np.clip(rr, 0, patch.shape[0] - 1), np.clip(cc, 0, patch.shape[1] - 1)], np.nan)
            out += np.where(weight > 1e-12, value * weight, 0)
    return out


def resample(grid: np.ndarray, r0: int, c0: int, h: int, w: int, angle: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """The h x w patch at (r0, c0) turned by angle degrees (anticlockwise on the map) and enlarged about its centre."""
    cy, cx = r0 + (h - 1) / 2, c0 + (w - 1) / 2
    i, j = np.mgrid[:h, :w]
    dy, dx = (i - (h - 1) / 2) / scale, (j - (w - 1) / 2) / scale
    t = np.deg2rad(angle)
    return bilinear(grid, cy + dy * np.cos(t) + dx * np.sin(t), cx - dy * np.sin(t) + dx * np.cos(t))


def resize(patch: np.ndarray, h: int, w: int) -> np.ndarray:
    """Patch in another size: smoothed with a Gaussian where it shrinks, then read between centres (edges repeat)."""
    out = patch.astype(np.float64)
    for axis, size in ((0, h), (1, w)):
        ratio = out.shape[axis] / size
        if ratio > 1:
            sigma = (ratio - 1) / 2
            reach = max(1, int(np.ceil(3 * sigma)))
            kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
            padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(2)], mode="edge")
            out = np.apply_along_axis(lambda v, k=kernel / kernel.sum(): np.convolve(v, k, mode="valid"), axis, padded)
        at = np.clip((np.arange(size) + 0.5) * ratio - 0.5, 0, out.shape[axis] - 1)
        low = np.minimum(np.floor(at).astype(int), max(out.shape[axis] - 2, 0))
        part = at - low
        high = np.minimum(low + 1, out.shape[axis] - 1)
        shape = (-1, 1) if axis == 0 else (1, -1)
        out = np.take(out, low, axis) * (1 - part).reshape(shape) + np.take(out, high, axis) * part.reshape(shape)
    return out
