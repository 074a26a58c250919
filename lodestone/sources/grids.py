"""Grids and vector layers as DataFrames: cells (r, c, v), polygons (fid, props, rings), points of lines."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import RINGS, Affine, contains, crs_grid, signed_area
from ..operators.ordering import free_name

LAYER = f"source string, fid long, kind string, props string, rings {RINGS}"


@dataclass(frozen=True)
class Meta:
    """Size, transform and reference system (an EPSG string, not interpreted) of a grid."""

    height: int
    width: int
    transform: Affine = field(default_factory=Affine)
    crs: str | None = None


def read_csv_grid(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """(r, c, v) of a delimited grid in one file; r counts data lines. Fields that are no numbers are null."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")).alias("r", "line"))
    rows = lines.where(F.col("r") >= 1).withColumn("r", F.col("r") - 1) if header else lines
    cells = rows.select("r", F.posexplode(F.split("line", sep)).alias("c", "t"))
    return cells.select("r", "c", F.trim("t").try_cast("double").alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def read_float32_grid(spark: SparkSession, path: str, width: int, nodata: float | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, big_endian: bool = False) -> DataFrame:
    """(r, c, v) of a headerless float32 grid, read in byte ranges; the file's size gives its height.

    Only the rows and columns asked for are read. nodata is compared as float32; it and NaN are null.
    """
    from .raster import file_size, read_raster

    span = lambda x: None if x is None else f"{x[0]}:{x[1]}"
    return read_raster(spark, path, width=width, height=file_size(path) // (4 * width), order="big" if big_endian else "little", nodata=nodata, rows=span(rows), cols=span(cols))


def read_header(text: str) -> dict[str, str]:
    """Key = value lines of a plain-text raster header; names in lower case, quotes removed, blocks flattened."""
    out = {}
    for line in text.splitlines():
        if "=" in line:
            k, v = line.split("=", 1)
            out[k.strip().lower()] = v.strip().strip('"')
    return out


def resolve_crs(source: str | None, forced: str | None = None) -> str:
    """The reference system of a layer: the forced one, else its own. Raises where there is neither, or an unknown one."""
    name = forced or source
    if not name:
        raise ValueError("the layer names no reference system; force one only if it is known")
    crs_grid(name)
    return name.strip().upper()


def check_registered(metas: dict[str, Meta]) -> Meta:
    """The common size, transform and reference system of variables; raises where they differ."""
    names = list(metas)
    for n in names[1:]:
        if metas[n] != metas[names[0]]:
            raise ValueError(f"grid {n!r} doesn't match {names[0]!r}: {metas[n]} and {metas[names[0]]}")
    return metas[names[0]]


def stack(grids: dict[str, DataFrame]) -> DataFrame:
    """(r, c, one column a variable) from (r, c, v) grids: one shuffle by cell, cells of any variable kept."""
    long = None
    for name, g in grids.items():
        part = g.select(F.lit(name).alias("var"), "r", "c", "v")
        long = part if long is None else long.unionByName(part)
    return long.groupBy("r", "c").pivot("var", list(grids)).agg(F.first("v"))


def crop_box(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells of rows r0..r1-1 and columns c0..c1-1, numbered from 0; ranges reach the scan as filters."""
    return cells.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)).withColumn("r", F.col("r") - r0).withColumn("c", F.col("c") - c0)


def crop_polygon(cells: DataFrame, t: Affine, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Cells whose centres lie in a polygon (even-odd rule)."""
    x, y = t.to_map(F.col("r") + 0.5, F.col("c") + 0.5)
    xs, ys = [p[0] for ring in rings for p in ring], [p[1] for ring in rings for p in ring]
    poly = F.array(*[F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring]) for ring in rings])
    boxed = cells.withColumn("center x", x).withColumn("center y", y).where((F.col("center x") >= min(xs)) & (F.col("center x") <= max(xs)) & (F.col("center y") >= min(ys)) & (F.col("center y") <= max(ys)))
    return boxed.where(contains(poly, F.col("center x"), F.col("center y"))).drop("center x", "center y")


def turn(ring) -> float:
    """Twice the signed area of a ring of (x, y, ...); positive where it runs anticlockwise."""
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], ring[0]]))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature part: source file, fid (place in the file), kind, props (JSON) and rings. A multi-part feature has
    a row for each part; a line is one open ring, a point a ring of one. Features without geometry are dropped."""

    def parse(frames):
        for f in frames:
            for source, text in zip(f["source"], f["value"]):
                doc = json.loads(text)
                out = []
                for i, feature in enumerate(doc.get("features", [doc] if doc.get("type") == "Feature" else [])):
                    g = feature.get("geometry") or {}
                    kind, xy = g.get("type"), g.get("coordinates") or []
                    parts = {"Point": [[[xy]]], "MultiPoint": [[[p]] for p in xy], "LineString": [[xy]], "MultiLineString": [[line] for line in xy], "Polygon": [xy], "MultiPolygon": xy}.get(kind, [])
                    for rings in parts:
                        if kind in ("Polygon", "MultiPolygon"):  # outline clockwise, holes the other way, whatever the file has
                            rings = [r if not r or (turn(r) > 0) == (k > 0) else r[::-1] for k, r in enumerate(rings)]
                        points = [[{"x": float(p[0]), "y": float(p[1])} for p in ring] for ring in rings if ring and ring[0]]
                        if points:
                            out.append((source, i, kind.removeprefix("Multi"), json.dumps(feature.get("properties") or {}, ensure_ascii=False), points))
                yield pd.DataFrame(out, columns=["source", "fid", "kind", "props", "rings"])

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return texts.mapInPandas(parse, LAYER)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Features of .shp files, with the attributes of the .dbf beside each as props ({} without one). A polygon is one row a
    record, which may have several outlines; outlines run clockwise and come first, holes the other way. Each part of a line
    and each point is a row. Null shapes are dropped."""
    from .maps import from_dbf

    def parse(frames):
        for f in frames:
            for source, raw, table in zip(f["path"], f["content"], f["table"]):
                raw, at, out, records = bytes(raw), 100, [], from_dbf(None if table is None else bytes(table))
                while at + 12 <= len(raw):
                    number, words = struct.unpack(">ii", raw[at : at + 8])
                    kind = struct.unpack("<i", raw[at + 8 : at + 12])[0] % 10
                    props = json.dumps(records[number - 1] if number <= len(records) else {}, ensure_ascii=False)
                    if kind in (3, 5):
                        parts, points = struct.unpack("<ii", raw[at + 44 : at + 52])
                        first = [*struct.unpack(f"<{parts}i", raw[at + 52 : at + 52 + 4 * parts]), points]
                        start = at + 52 + 4 * parts
                        xy = np.frombuffer(raw[start : start + 16 * points], dtype="<f8").reshape(-1, 2)
                        rings = [xy[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
                        shapes = [("Polygon", sorted(rings, key=lambda r: turn(r) > 0))] if kind == 5 else [("LineString", [r]) for r in rings]
                    elif kind in (1, 8):
                        start, points = (at + 12, 1) if kind == 1 else (at + 48, struct.unpack("<i", raw[at + 44 : at + 48])[0])
                        shapes = [("Point", [[p]]) for p in np.frombuffer(raw[start : start + 16 * points], dtype="<f8").reshape(-1, 2).tolist()]
                    else:
                        shapes = []
                    out += [(source, number - 1, name, props, [[{"x": x, "y": y} for x, y in r] for r in rings]) for name, rings in shapes]
                    at += 8 + 2 * words
                    if len(out) >= 4096:
                        yield pd.DataFrame(out, columns=["source", "fid", "kind", "props", "rings"])
                        out = []
                yield pd.DataFrame(out, columns=["source", "fid", "kind", "props", "rings"])

    folder, slash, name = path.rpartition("/")
    files = lambda ending, glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load((folder or slash or ".") if path.lower().endswith(".shp") else path).select("path", "content", F.regexp_replace("path", rf"(?i)\.{ending}$", "").alias("stem"))
    stem = name[:-4] if path.lower().endswith(".shp") else "*"
    tables = files("dbf", stem + ".[dD][bB][fF]").select("stem", F.col("content").alias("table"))
    return files("shp", stem + ".[sS][hH][pP]").join(tables, "stem", "left").select("path", "content", "table").mapInPandas(parse, LAYER)


def fix_rings(layer: DataFrame) -> DataFrame:
    """Points equal to the one before go, then rings with fewer than three points or without area, and with them polygons
    without an outline."""
    plain = F.transform("rings", lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1))))
    return layer.withColumn("rings", F.filter(plain, lambda r: (F.size(r) >= 3) & (F.abs(signed_area(r)) > 0))).where(F.size("rings") > 0)


def densify(layer: DataFrame, step: float) -> DataFrame:
    """(fid, x, y): points along lines and outlines, no further apart than step."""
    rings = layer.select("fid", F.posexplode("rings").alias("ring", "points")).select("fid", "ring", F.posexplode("points").alias("i", "p"))
    ahead = Window.partitionBy("fid", "ring").orderBy("i")
    seg = rings.select("fid", "p.x", "p.y", F.lead("p.x").over(ahead).alias("nx"), F.lead("p.y").over(ahead).alias("ny"))
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.coalesce("nx", "x") - F.col("x"), F.coalesce("ny", "y") - F.col("y")) / step)).cast("int")
    seg = seg.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    along = lambda a, b: F.col(a) + (F.coalesce(b, a) - F.col(a)) * F.col("k") / F.col("n")
    return seg.select("fid", along("x", "nx").alias("x"), along("y", "ny").alias("y")).distinct()


def first_of_each(layer: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in the given order, such as a feature that several requests returned."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    name = free_name(layer, "row of key")
    return layer.withColumn(name, place).where(F.col(f"`{name}`") == 1).drop(name)
