"""Affine, polygon and projection functions. Columns where the formula allows, small array kernels elsewhere.

A polygon is an array of rings, a ring an array of structs (x, y). The first ring is an outline; of the others those that
run the same way are outlines too (a polygon of several islands), those that run the other way are holes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

RINGS = "array<array<struct<x:double,y:double>>>"


@dataclass(frozen=True)
class Affine:
    """x = a * col + b * row + c, y = d * col + e * row + f, of cell corners."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0

    def to_map(self, row, col):
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def to_cell(self, x, y):
        """Row and column, with fractions, of a point on the map."""
        det = self.a * self.e - self.b * self.d
        return (self.a * (y - self.f) - self.d * (x - self.c)) / det, (self.e * (x - self.c) - self.b * (y - self.f)) / det


def cell_of(t: Affine, x: str, y: str, how: str = "floor") -> tuple[Column, Column]:
    """Row and column indices of a point, rounded down or up."""
    row, col = t.to_cell(F.col(x), F.col(y))
    to = F.floor if how == "floor" else F.ceil
    return to(row).cast("int"), to(col).cast("int")


def clamp(value: Column, most: int) -> Column:
    """An index held within 0 and most."""
    return F.greatest(F.lit(0), F.least(value, F.lit(most)))


def center_of(t: Affine, row: str, col: str) -> tuple[Column, Column]:
    """Map position of a cell's centre."""
    return t.to_map(F.col(row) + 0.5, F.col(col) + 0.5)


def with_box(df: DataFrame, t: Affine, h: int, w: int, row: str = "r0", col: str = "c0") -> DataFrame:
    """df with the map box x0, x1, y0, y1 of h x w cells from (row, col) on; for transforms without rotation."""
    xa, ya = t.to_map(F.col(row), F.col(col))
    xb, yb = t.to_map(F.col(row) + h, F.col(col) + w)
    return df.select("*", F.least(xa, xb).alias("x0"), F.greatest(xa, xb).alias("x1"), F.least(ya, yb).alias("y0"), F.greatest(ya, yb).alias("y1"))


def box_rings(x0, x1, y0, y1) -> Column:
    """A box as a polygon of one closed ring."""
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return F.array(F.array(p(x0, y0), p(x0, y1), p(x1, y1), p(x1, y0), p(x0, y0)))


def signed_area(ring: Column) -> Column:
    """Shoelace formula over a ring; it may be closed or not. Positive where the ring runs anticlockwise."""
    n = F.size(ring)
    term = lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"]
    return F.when(n < 3, F.lit(0.0)).otherwise(F.aggregate(F.transform(ring, term), F.lit(0.0), lambda a, v: a + v) / 2)


def signed_sum(rings: Column, of) -> Column:
    """of(ring) added over rings, with the sign that makes the first ring's own area positive; 0 at least."""
    parts = F.transform(rings, of)
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    return F.greatest(F.lit(0.0), F.signum(signed_area(F.get(rings, F.lit(0)))) * total)


def area(rings: Column) -> Column:
    """Area of a polygon. Rings that run like the first are outlines (islands) and add up, others are holes."""
    return signed_sum(rings, signed_area)


def outline_size(rings: Column) -> Column:
    return F.sqrt(area(rings))


def bounds(rings: Column) -> Column:
    """Struct (x0, x1, y0, y1)."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def circle_of(rings: Column) -> Column:
    """Struct (cx, cy, radius): centre of the bounds and half the larger extent."""
    b = bounds(rings)
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("cx"), ((b["y0"] + b["y1"]) / 2).alias("cy"), (F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]) / 2).alias("radius"))


def axis_azimuth(points: DataFrame, group: list[str]) -> DataFrame:
    """Azimuth (0 to 180 degrees from north, clockwise) of the longest spread of points (x, y) in each group."""
    g = points.groupBy(*group).agg(F.covar_pop("x", "y").alias("cxy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return g.select(*group, F.pmod(F.degrees(0.5 * F.atan2(2 * F.col("cxy"), F.col("vy") - F.col("vx"))) + 180, F.lit(180.0)).alias("azimuth"))


def dipole_azimuth(cells: DataFrame, group: list[str], share: float = 0.1) -> DataFrame:
    """Azimuth (0 to 360) from the centroid of the lowest values' cells to that of the highest; x right, rows down."""
    limits = cells.groupBy(*group).agg(F.percentile("v", F.lit(share)).alias("lo"), F.percentile("v", F.lit(1 - share)).alias("hi"))
    j = cells.join(limits, group)
    low, high = F.col("v") <= F.col("lo"), F.col("v") >= F.col("hi")
    m = j.groupBy(*group).agg(*[F.avg(F.when(k, F.col(c))).alias(n) for k, c, n in ((low, "r", "rl"), (low, "c", "cl"), (high, "r", "rh"), (high, "c", "ch"))])
    return m.select(*group, F.pmod(F.degrees(F.atan2(F.col("ch") - F.col("cl"), F.col("rl") - F.col("rh"))), F.lit(360.0)).alias("azimuth"))


def signed_difference(angle: Column, ref: Column | float, period: float = 360.0) -> Column:
    """Smallest difference of two angles, from -period / 2 up to below period / 2."""
    return F.pmod(angle - ref + period / 2, F.lit(period)) - period / 2


def nice_length(x: Column) -> Column:
    """The smallest of 1, 2, 5 and 10 times a power of ten that isn't below x; 1000 for 0 and less."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    lead = x / power
    return F.when(x <= 0, 1000.0).otherwise(F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10) * power)


def clip_ring(x: np.ndarray, y: np.ndarray, x0: float, x1: float, y0: float, y1: float) -> tuple[np.ndarray, np.ndarray]:
    """A ring cut to a box, one half plane after the other."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(x):
            break
        d = sign * ((x, y)[axis] - limit)
        e, xn, yn = np.roll(d, -1), np.roll(x, -1), np.roll(y, -1)
        inside, crossing = d >= 0, (d >= 0) != (e >= 0)
        t = np.divide(d, d - e, out=np.zeros_like(d), where=crossing)
        at = np.arange(len(x))
        order = np.argsort(np.concatenate([at[inside] * 2, at[crossing] * 2 + 1]), kind="stable")
        x = np.concatenate([x[inside], (x + t * (xn - x))[crossing]])[order]
        y = np.concatenate([y[inside], (y + t * (yn - y))[crossing]])[order]
    return x, y


def ring_arrays(ring) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p["x"] for p in ring], dtype=float), np.array([p["y"] for p in ring], dtype=float)


def shoelace(x: np.ndarray, y: np.ndarray) -> float:
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 if len(x) > 2 else 0.0


def rings_in_box(rings, x0: float, x1: float, y0: float, y1: float) -> float:
    """clip_area of one polygon by cutting its rings; a plain form for small work and for tests."""
    if not len(rings):
        return 0.0
    way = np.sign(shoelace(*ring_arrays(rings[0])))
    return max(0.0, float(way * sum(shoelace(*clip_ring(*ring_arrays(r), x0, x1, y0, y1)) for r in rings)))


def bound(value: Column, of) -> Column:
    """of(value), where value is found once however often of reads it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def named(**values: Column) -> Column:
    """A struct whose names hold before its values are resolved, as a bound lambda needs."""
    return F.named_struct(*[c for n, v in values.items() for c in (F.lit(n), v)])


def held_mean(lo: Column, hi: Column, wide: Column) -> Column:
    """Mean of a number that runs evenly from lo to hi, lo <= hi, held within 0 and wide."""
    held = lambda v: F.least(F.greatest(v, F.lit(0.0)), wide)
    above = lambda v: F.greatest(v - wide, F.lit(0.0))
    return F.when(lo == hi, held(lo)).otherwise(((held(hi) - held(lo)) * (held(lo) + held(hi)) / 2 + wide * (above(hi) - above(lo))) / F.when(lo != hi, hi - lo))


def clip_area(rings: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Area of a polygon, less its holes, inside a box.

    On a line of constant y, the length inside is the sum over the edges it meets of their x, held within the box, with
    the sign of their way up or down. So each edge gives the integral of its x held within the box, over its y within the
    box; on a straight edge this has a closed form. Only DataFrame functions; what a formula reads more than once is bound.
    """
    zero = F.lit(0.0)

    def along(box: Column, ring: Column) -> Column:
        n = F.size(ring)
        held = lambda v: F.least(F.greatest(v, box["y0"]), box["y1"])

        def part(e: Column) -> Column:
            """e: an edge from (x, y) on, its slope and its ends' y held within the box."""
            at = lambda v: e["x"] + (v - e["y"]) * e["slope"]
            mean = bound(named(a=at(e["low"]), b=at(e["high"])), lambda k: held_mean(F.least(k["a"], k["b"]), F.greatest(k["a"], k["b"]), box["wide"]))
            return F.when(e["low"] == e["high"], zero).otherwise((e["high"] - e["low"]) * mean)

        def edge(p: Column, i: Column) -> Column:
            q = F.element_at(ring, (i + 1) % n + 1)
            return bound(q, lambda q: F.when(q["y"] == p["y"], zero).otherwise(bound(named(x=p["x"] - box["x0"], y=p["y"], slope=(q["x"] - p["x"]) / (q["y"] - p["y"]), low=held(p["y"]), high=held(q["y"])), part)))

        return F.when(n < 3, zero).otherwise(F.aggregate(F.transform(ring, edge), zero, lambda a, v: a + v))

    return bound(named(x0=x0, wide=x1 - x0, y0=y0, y1=y1), lambda k: signed_sum(rings, lambda ring: along(k, ring)))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon, by the even-odd rule; only DataFrame functions."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def over(p, i):
            q = F.element_at(ring, (i + 1) % n + 1)
            at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"])
            return F.when(((p["y"] > y) != (q["y"] > y)) & (x < at), 1).otherwise(0)

        return F.aggregate(F.transform(ring, over), F.lit(0), lambda a, v: a + v)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, v: a + v) % 2 == 1


def containing(points: DataFrame, polygons: DataFrame, tile: float, point_id: str = "pid", fid: str = "fid") -> DataFrame:
    """(pid, fid) of all polygons that hold a point; candidates by tiles of the bounds, so no pair far apart is made."""
    box = polygons.select(fid, "rings", bounds(F.col("rings")).alias("b"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile))
    tiles = box.withColumn("tx", F.explode(span("b.x0", "b.x1"))).withColumn("ty", F.explode(span("b.y0", "b.y1")))
    placed = points.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile))
    found = placed.join(tiles, ["tx", "ty"]).where((F.col("x") >= F.col("b.x0")) & (F.col("x") <= F.col("b.x1")) & (F.col("y") >= F.col("b.y0")) & (F.col("y") <= F.col("b.y1")))
    return found.where(contains(F.col("rings"), F.col("x"), F.col("y"))).select(point_id, fid)


def first_containing(points: DataFrame, polygons: DataFrame, tile: float, point_id: str = "pid", fid: str = "fid") -> DataFrame:
    """points with the first polygon (by fid) that holds them, null where none does."""
    found = containing(points, polygons, tile, point_id, fid).groupBy(point_id).agg(F.min(fid).alias(fid))
    return points.join(found, point_id, "left")


def outside(points: DataFrame, polygons: DataFrame, tile: float, point_id: str = "pid", fid: str = "fid") -> DataFrame:
    """points that no polygon holds."""
    return points.join(containing(points, polygons, tile, point_id, fid).select(point_id).distinct(), point_id, "left_anti")


# Transverse Mercator by the sixth-order series in the third flattening, and datum shifts between such grids.


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_flattening
        return f * (2 - f)


#: Fixed values of the public ellipsoids.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
GRS67 = Ellipsoid(6378160.0, 298.25)
GRS80 = Ellipsoid(6378137.0, 298.257222101)
#: Series coefficients of published tables: for each order the factors of n, n**2, ... (fixed values).
FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)


@dataclass(frozen=True)
class Grid:
    """A transverse Mercator grid; by default a southern UTM zone."""

    ellipsoid: Ellipsoid = WGS84
    central_meridian: float = -51.0
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 10_000_000.0

    @property
    def radius(self) -> float:
        n = self.ellipsoid.n
        return self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) * self.scale

    def series(self, table) -> list[float]:
        n = self.ellipsoid.n
        return [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in table]


def to_grid_arrays(g: Grid, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing of degrees."""
    e = math.sqrt(g.ellipsoid.e2)
    phi, lam = np.radians(lat), np.radians(lon - g.central_meridian)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    x, y = eta.copy(), xi.copy()
    for k, c in enumerate(g.series(FORWARD), 1):
        x += c * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
        y += c * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
    return g.easting + g.radius * x, g.northing + g.radius * y


def from_grid_arrays(g: Grid, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees; Newton steps lead from the conformal latitude to the geodetic one."""
    xi0, eta0 = (y - g.northing) / g.radius, (x - g.easting) / g.radius
    xi, eta = xi0.copy(), eta0.copy()
    for k, c in enumerate(g.series(INVERSE), 1):
        xi -= c * np.sin(2 * k * xi0) * np.cosh(2 * k * eta0)
        eta -= c * np.cos(2 * k * xi0) * np.sinh(2 * k * eta0)
    e2, e = g.ellipsoid.e2, math.sqrt(g.ellipsoid.e2)
    goal = np.sin(xi) / np.hypot(np.sinh(eta), np.cos(xi))
    tau = goal / (1 - e2)
    for _ in range(5):
        s = np.sinh(e * np.arctanh(e * tau / np.hypot(1, tau)))
        now = tau * np.hypot(1, s) - s * np.hypot(1, tau)
        tau += (goal - now) / np.hypot(1, now) * (1 + (1 - e2) * tau**2) / ((1 - e2) * np.hypot(1, tau))
    return g.central_meridian + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(np.arctan(tau))


def to_geocentric(el: Ellipsoid, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Geocentric position of a point on the ellipsoid."""
    phi, lam = np.radians(lat), np.radians(lon)
    v = el.a / np.sqrt(1 - el.e2 * np.sin(phi) ** 2)
    return v * np.cos(phi) * np.cos(lam), v * np.cos(phi) * np.sin(lam), v * (1 - el.e2) * np.sin(phi)


def from_geocentric(el: Ellipsoid, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude. The latitude comes from that of the auxiliary sphere, which is improved until it stays."""
    p, b = np.hypot(x, y), el.a * math.sqrt(1 - el.e2)
    phi = np.arctan2(z, p * (1 - el.e2))
    while phi.size:
        beta = np.arctan2(b * np.sin(phi), el.a * np.cos(phi))
        now = np.arctan2(z + el.e2 / (1 - el.e2) * b * np.sin(beta) ** 3, p - el.e2 * el.a * np.cos(beta) ** 3)
        if not np.nanmax(np.abs(now - phi), initial=0.0) > 1e-15:
            break
        phi = now
    return np.degrees(np.arctan2(y, x)), np.degrees(phi)


def pairs(kernel, a, b) -> Column:
    """Struct (x, y) of a kernel on two columns of numbers."""

    @pandas_udf("x double, y double")
    def of(u: pd.Series, v: pd.Series) -> pd.DataFrame:
        x, y = kernel(u.to_numpy(np.float64), v.to_numpy(np.float64))
        return pd.DataFrame({"x": x, "y": y})

    return of(a, b)


def to_grid(g: Grid, lon, lat) -> Column:
    """Struct (x, y): easting and northing of degrees."""
    return pairs(lambda u, v: to_grid_arrays(g, u, v), lon, lat)


def from_grid(g: Grid, x, y) -> Column:
    """Struct (x, y): longitude and latitude of a grid point."""
    return pairs(lambda u, v: from_grid_arrays(g, u, v), x, y)


#: Geocentric shift from the older South American datum to the present one, in metres (fixed values, as published).
OLDER_DATUM = (-67.35, 3.88, -38.22)


@dataclass(frozen=True)
class System:
    """A reference system: a grid, or degrees where there is none, on an ellipsoid that is shifted against that of WGS84."""

    grid: Grid | None
    ellipsoid: Ellipsoid
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)


#: Zones of transverse Mercator grids by EPSG code: first code, first zone, last zone, south, datum (fixed values, as
#: published). Degrees of a datum have a code of their own.
ZONES = (
    (32601, 1, 60, False, "wgs84"), (32701, 1, 60, True, "wgs84"), (31965, 11, 22, False, "sirgas"), (31977, 17, 25, True, "sirgas"),
    (29168, 18, 22, False, "older"), (29188, 18, 25, True, "older"),
)
DEGREES = {4326: "wgs84", 4674: "sirgas", 4618: "older"}
DATUMS = {"wgs84": (WGS84, (0.0, 0.0, 0.0)), "sirgas": (GRS80, (0.0, 0.0, 0.0)), "older": (GRS67, OLDER_DATUM)}


def system(name: str) -> System:
    """The system of a CRS name: degrees (EPSG:4326, 4674, 4618) or a UTM zone of WGS84, SIRGAS 2000 or the older South
    American datum. Raises for others."""
    kind, _, code = name.strip().upper().partition(":")
    number = int(code) if kind == "EPSG" and code.isdigit() else 0
    if number in DEGREES:
        return System(None, *DATUMS[DEGREES[number]])
    for first, low, high, south, datum in ZONES:
        if 0 <= number - first <= high - low:
            ellipsoid, shift = DATUMS[datum]
            return System(Grid(ellipsoid, 6.0 * (low + number - first) - 183, northing=10_000_000.0 if south else 0.0), ellipsoid, shift)
    raise ValueError(f"unknown CRS {name!r}; known: EPSG:4326, 4674, 4618 and UTM zones of EPSG:326xx, 327xx, 31965-31985, 29168-29172, 29188-29195")


def crs_grid(name: str) -> Grid | None:
    """Grid of a CRS name, None for degrees."""
    return system(name).grid


def moved_arrays(a: System, b: System, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates led from one system to another: off the grid, over the geocentric shift between datums, onto the grid."""
    lon, lat = (x, y) if a.grid is None else from_grid_arrays(a.grid, x, y)
    if a.shift != b.shift:
        at = to_geocentric(a.ellipsoid, lon, lat)
        lon, lat = from_geocentric(b.ellipsoid, *(p + s - t for p, s, t in zip(at, a.shift, b.shift)))
    return (lon, lat) if b.grid is None else to_grid_arrays(b.grid, lon, lat)


def reproject(polygons: DataFrame, source: str, target: str) -> DataFrame:
    """polygons with the points of rings moved from one CRS to another, as system names them. Datums without a shift between
    them share their degrees. All points of a batch are moved as two arrays."""
    a, b = system(source), system(target)
    if a == b:
        return polygons

    @arrow_udf(RINGS)
    def moved(rings: pa.Array) -> pa.Array:
        inner = rings.flatten()
        points = inner.flatten()
        x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xy")
        x, y = moved_arrays(a, b, x, y)
        ends = lambda lists: np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int32)
        made = pa.ListArray.from_arrays(ends(inner), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))
        return pa.ListArray.from_arrays(ends(rings), made)

    return polygons.where("rings is not null").withColumn("rings", moved("rings"))


def shift_datum(df: DataFrame, source: Grid, target: Grid, shift: tuple[float, float, float] = OLDER_DATUM, x: str = "x", y: str = "y") -> DataFrame:
    """Grid coordinates moved to another datum by a geocentric shift in metres."""

    def move(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = to_geocentric(source.ellipsoid, *from_grid_arrays(source, u, v))
        return to_grid_arrays(target, *from_geocentric(target.ellipsoid, *(p + s for p, s in zip(at, shift))))

    moved = df.withColumn("moved point", pairs(move, F.col(x), F.col(y)))
    return moved.withColumn(x, F.col("`moved point`.x")).withColumn(y, F.col("`moved point`.y")).drop("moved point")


def ring_points(polygons: DataFrame, key: str) -> DataFrame:
    """(key, ring, i, x, y): polygons as rows of points."""
    rings = polygons.select(key, F.posexplode("rings").alias("ring", "points"))
    return rings.select(key, "ring", F.posexplode("points").alias("i", "p")).select(key, "ring", "i", "p.x", "p.y")


def shoelace_rows(points: DataFrame, key: str) -> DataFrame:
    """Signed area of each ring given as rows, by a look at the next point."""
    w = Window.partitionBy(key, "ring").orderBy("i")
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(w)), F.coalesce(F.lead("y").over(w), F.first("y").over(w))
    return points.withColumn("t", F.col("x") * ny - nx * F.col("y")).groupBy(key, "ring").agg((F.sum("t") / 2).alias("signed_area"))
