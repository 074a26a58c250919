"""Map layers as binary files: a Spark data source that writes GeoPackages and shapefiles, and readers of their records.

    write_map(layer, "/maps/top.gpkg", crs="EPSG:31982")      one file, for a layer of bounded size
    write_map(layer, "/maps/all", "shp", crs="EPSG:31982")    a folder of parts, written by all tasks

A task collects rows until a part is full and then starts the next one, so memory follows the size of a part and not that of
the layer. Parts are written beside their place and moved there when all tasks are done: a task that is run again leaves
nothing behind, and a job that fails leaves no layer.
"""

from __future__ import annotations

import json
import sqlite3
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.geometry import system
from .raster import opened

#: Rows and bytes (of Arrow) of a part, about; rows that are encoded at a time.
PART_ROWS, PART_BYTES, SLICE = 65_536, 64 << 20, 512
#: Fixed values of the public formats: shape types, WKB types, the mark of a GeoPackage and its version, bytes of a text field.
SHAPES = {"polygon": 5, "line": 3, "point": 1, "points": 8}
WKB = {"point": 1, "line": 2, "polygon": 3, "many": 3}
APPLICATION, VERSION, TEXT_BYTES = 0x47504B47, 10300, 254
GEOMETRIES = ("polygon", "line", "point")
KINDS = {"gpkg": (".gpkg",), "shp": (".shp", ".shx", ".dbf", ".cpg", ".prj")}
CATALOGUE = """
create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer not null primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
create table gpkg_contents (table_name text not null primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer references gpkg_spatial_ref_sys (srs_id));
create table gpkg_geometry_columns (table_name text not null unique references gpkg_contents (table_name), column_name text not null, geometry_type_name text not null, srs_id integer not null references gpkg_spatial_ref_sys (srs_id), z tinyint not null, m tinyint not null, primary key (table_name, column_name));
"""


def crs_text(name: str) -> str:
    """A reference system as text that map programs read; systems are those of `geometry.system`."""
    s, code = system(name), name.strip().upper().removeprefix("EPSG:")
    mark = f'AUTHORITY["EPSG","{code}"]'
    shift = ",".join(f"{v:g}" for v in (*s.shift, 0, 0, 0, 0))
    earth = f'DATUM["unnamed",SPHEROID["unnamed",{s.ellipsoid.a!r},{s.ellipsoid.inverse_flattening!r}],TOWGS84[{shift}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]'
    if s.grid is None:
        return f'GEOGCS["EPSG:{code}",{earth},{mark}]'
    g = s.grid
    settings = {"latitude_of_origin": 0.0, "central_meridian": g.central_meridian, "scale_factor": g.scale, "false_easting": g.easting, "false_northing": g.northing}
    listed = ",".join(f'PARAMETER["{k}",{v!r}]' for k, v in settings.items())
    return f'PROJCS["EPSG:{code}",GEOGCS["unnamed",{earth}],PROJECTION["Transverse_Mercator"],{listed},UNIT["metre",1],{mark}]'


# --- shapes -----------------------------------------------------------------------------------------------------------


def rings_of(column: pa.Array) -> Iterator[list[np.ndarray] | None]:
    """The rings of each row as arrays of points; None for a null. Rings without points are left out."""
    inner = column.flatten()
    points = inner.flatten()
    xy = np.column_stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xy"])
    sizes = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
    rings = iter(np.split(xy, np.cumsum(sizes)[:-1])) if len(sizes) else iter(())
    for n in pc.list_value_length(column).to_pylist():
        yield None if n is None else [r for r in (next(rings) for _ in range(n)) if len(r)]


def spin(ring: np.ndarray) -> float:
    """Twice the signed area of a ring, positive where it runs anticlockwise."""
    x, y = (ring - ring[0]).T
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1))


def within(points: np.ndarray, ring: np.ndarray) -> int:
    """How many points lie in a ring (even-odd)."""
    a, b = ring[:, None], np.roll(ring, -1, axis=0)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[..., 0] + (points[:, 1] - a[..., 1]) / (b[..., 1] - a[..., 1]) * (b[..., 0] - a[..., 0])
    hit = ((a[..., 1] > points[:, 1]) != (b[..., 1] > points[:, 1])) & (points[:, 0] < at)
    return int((hit.sum(axis=0) % 2).sum())


def arranged(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Closed rings as polygons: each an outline, anticlockwise, with its holes, clockwise. In the layer outlines run
    clockwise; where no ring does, the first is the outline. A hole goes to the outline that holds most of its corners, of
    several the smallest."""
    closed = [r if len(r) > 1 and (r[0] == r[-1]).all() else np.vstack([r, r[:1]]) for r in rings]
    turns = [spin(r) for r in closed]
    outer = [i for i, t in enumerate(turns) if t < 0] or [0]
    out = {i: [closed[i][:: -1 if turns[i] < 0 else 1]] for i in outer}
    for i, ring in enumerate(closed):
        if i not in out:
            home = outer[0] if len(outer) == 1 else max(outer, key=lambda o: (within(ring[:-1], closed[o]), -abs(turns[o])))
            out[home].append(ring[:: -1 if turns[i] > 0 else 1])
    return list(out.values())


def counted(points: np.ndarray) -> bytes:
    return struct.pack("<I", len(points)) + points.astype("<f8").tobytes()


def wkb(rings: list[np.ndarray], geometry: str, many: bool) -> bytes:
    """Rings as little-endian well-known binary; many: as a collection of the geometry, whatever their number."""
    head = struct.pack("<BI", 1, WKB[geometry])
    if geometry == "polygon":
        parts = [head + struct.pack("<I", len(p)) + b"".join(counted(r) for r in p) for p in arranged(rings)]
    elif geometry == "line":
        parts = [head + counted(r) for r in rings]
    else:
        parts = [head + p.astype("<f8").tobytes() for r in rings for p in r]
    return parts[0] if not many else struct.pack("<BII", 1, WKB[geometry] + WKB["many"], len(parts)) + b"".join(parts)


def bounds_of(rings: list[np.ndarray]) -> tuple[float, float, float, float]:
    every = np.vstack(rings)
    return (*every.min(axis=0).tolist(), *every.max(axis=0).tolist())


# --- parts ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layer:
    """What all parts of a layer share."""

    kind: str
    columns: tuple[tuple[str, str], ...]  # name and type of the attributes
    geometry: str = "polygon"
    name: str = "layer"
    crs: str | None = None
    truncate: bool = False

    def part(self, shapes: list, rows: list[tuple]) -> dict[str, bytes]:
        """The files of a part by their endings."""
        return {".gpkg": self.geopackage(shapes, rows)} if self.kind == "gpkg" else self.shapefile(shapes, rows)

    def geopackage(self, shapes: list, rows: list[tuple]) -> bytes:
        """A database made in memory."""
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        taken = {n.lower() for n, _ in self.columns}
        key, geom = (next(n for n in (base + "_" * i for i in range(len(taken) + 1)) if n not in taken) for base in ("fid", "geom"))
        many = any(s and (len(s) > 1 if self.geometry == "line" else len(arranged(s)) > 1 if self.geometry == "polygon" else sum(map(len, s)) > 1) for s in shapes)
        shape_name = ("MULTI" if many else "") + {"polygon": "POLYGON", "line": "LINESTRING", "point": "POINT"}[self.geometry]
        code = int(self.crs.strip().upper().removeprefix("EPSG:")) if self.crs else -1
        typed = {"int": "INTEGER", "real": "REAL", "bool": "BOOLEAN", "date": "DATE", "time": "DATETIME", "text": "TEXT", "bytes": "BLOB"}
        boxes = [bounds_of(s) for s in shapes if s]
        whole = (None,) * 4 if not boxes else (*np.min(boxes, axis=0)[:2].tolist(), *np.max(boxes, axis=0)[2:].tolist())
        db = sqlite3.connect(":memory:")
        try:
            db.execute(f"pragma application_id = {APPLICATION}")
            db.execute(f"pragma user_version = {VERSION}")
            db.executescript(CATALOGUE)
            systems = {-1: ("undefined plane", -1, "NONE", -1, "undefined", None), 0: ("undefined degrees", 0, "NONE", 0, "undefined", None), 4326: ("EPSG:4326", 4326, "EPSG", 4326, crs_text("EPSG:4326"), None)}
            if self.crs:
                systems[code] = (f"EPSG:{code}", code, "EPSG", code, crs_text(self.crs), None)
            db.executemany("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, ?, ?)", list(systems.values()))
            fields = "".join(f", {quoted(n)} {typed[t]}" for n, t in self.columns)
            db.execute(f"create table {quoted(self.name)} ({key} integer primary key autoincrement, {geom} {shape_name}{fields})")
            db.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, 'features', ?, ?, ?, ?, ?, ?)", (self.name, self.name, *whole, code))
            db.execute("insert into gpkg_geometry_columns values (?, ?, ?, ?, 0, 0)", (self.name, geom, shape_name, code))

            def blob(s):
                if not s:
                    return None
                x0, y0, x1, y1 = bounds_of(s)
                return b"GP" + struct.pack("<BBi4d", 0, 0b11, code, x0, x1, y0, y1) + wkb(s, self.geometry, many)

            marks = ", ".join("?" * (1 + len(self.columns)))
            names = ", ".join([geom, *(quoted(n) for n, _ in self.columns)])
            db.executemany(f"insert into {quoted(self.name)} ({names}) values ({marks})", ((blob(s), *r) for s, r in zip(shapes, rows)))
            db.commit()
            return db.serialize()
        finally:
            db.close()

    def shapefile(self, shapes: list, rows: list[tuple]) -> dict[str, bytes]:
        """Records, their index, and the table of attributes."""
        kind = "points" if self.geometry == "point" and any(s and sum(map(len, s)) > 1 for s in shapes) else self.geometry
        body, index, at = [], [], 50
        for number, s in enumerate(shapes, 1):
            record = struct.pack("<i", 0) if not s else self.record(s, kind)
            words = len(record) // 2
            body.append(struct.pack(">ii", number, words) + record)
            index.append(struct.pack(">ii", at, words))
            at += 4 + words
        boxes = [bounds_of(s) for s in shapes if s]
        whole = (0.0,) * 4 if not boxes else (*np.min(boxes, axis=0)[:2].tolist(), *np.max(boxes, axis=0)[2:].tolist())
        head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, SHAPES[kind], *whole, 0, 0, 0, 0)
        out = {".shp": head(at) + b"".join(body), ".shx": head(50 + 4 * len(index)) + b"".join(index), ".dbf": self.table(rows), ".cpg": b"UTF-8"}
        return out | ({".prj": crs_text(self.crs).encode()} if self.crs else {})

    def record(self, s: list[np.ndarray], kind: str) -> bytes:
        every = np.vstack(s)
        if kind == "point":
            return struct.pack("<i2d", SHAPES[kind], *every[0])
        head = struct.pack("<i4d", SHAPES[kind], *bounds_of(s))
        if kind == "points":
            return head + counted(every)
        parts = s if kind == "line" else [r[::-1] for p in arranged(s) for r in p]
        starts = np.append(0, np.cumsum([len(p) for p in parts]))
        return head + struct.pack(f"<ii{len(parts)}i", len(parts), starts[-1], *starts[:-1]) + np.vstack(parts).astype("<f8").tobytes()

    def table(self, rows: list[tuple]) -> bytes:
        """Attributes in fields of fixed width. Names are cut to ten bytes and told apart by numbers."""
        columns = self.columns or (("fid", "int"),)
        rows = rows if self.columns else [(i,) for i in range(len(rows))]
        names, fields = [], []
        for n, _ in columns:
            short, k = n.encode()[:10].decode(errors="ignore"), 0
            while short.lower() in names:
                k += 1
                short = n.encode()[: 9 - len(str(k))].decode(errors="ignore") + f"_{k}"
            names.append(short.lower())
            fields.append(short)
        cells, specs = [], []
        for j, (n, t) in enumerate(columns):
            some = [self.field(n, t, r[j]) for r in rows]
            width = 8 if t == "date" else 1 if t == "bool" else max(1, max(map(len, some), default=1))
            pad = bytes.rjust if t in ("int", "real") else bytes.ljust
            cells.append([b"?" if t == "bool" and not v else pad(v, width) for v in some])
            mark = {"int": b"N", "real": b"N", "date": b"D", "bool": b"L"}.get(t, b"C")
            specs.append(struct.pack("<11sc4xBB14x", fields[j].encode(), mark, width, min(15, max(width - 2, 1)) if t == "real" else 0))
        size = 1 + sum(s[16] for s in specs)
        head = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(rows), 32 + 32 * len(specs) + 1, size)
        return head + b"".join(specs) + b"\r" + b"".join(b" " + b"".join(r) for r in zip(*cells)) + b"\x1a"

    def field(self, name: str, kind: str, v) -> bytes:
        if v is None or (kind == "real" and not np.isfinite(v)):
            return b""
        if kind == "bool":
            return b"T" if v else b"F"
        raw = v.replace("-", "").encode() if kind == "date" else v.hex().encode() if kind == "bytes" else (repr(v) if kind == "real" else str(v)).encode()
        if kind in ("text", "bytes") and len(raw) > TEXT_BYTES:
            if not self.truncate:
                raise ValueError(f"column {name!r} holds a text of {len(raw)} bytes, and a shapefile's fields end at {TEXT_BYTES}; write a GeoPackage, or allow cutting")
            raw = raw[:TEXT_BYTES].decode(errors="ignore").encode()
        return raw


# --- writing ----------------------------------------------------------------------------------------------------------


@dataclass
class Parts(WriterCommitMessage):
    """Names of a task's parts in the waiting folder."""

    files: list[str]


def plain(v):
    """A value as both formats take it: days and moments (in UTC) as text, the rest as it is."""
    if isinstance(v, datetime):
        return (v if v.tzinfo is None else v.astimezone(UTC).replace(tzinfo=None)).isoformat(timespec="milliseconds") + "Z"
    return v.isoformat() if isinstance(v, date) else v


class MapWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layer: Layer, one: bool, overwrite: bool, part_rows: int, part_bytes: int):
        self.path, self.layer, self.one, self.overwrite = path, layer, one, overwrite
        self.part_rows, self.part_bytes = part_rows, part_bytes
        self.run = uuid.uuid4().hex[:12]

    @property
    def waiting(self) -> str:
        """The folder of parts that aren't in their place yet."""
        place = opened(self.path)[1].rstrip("/")
        return f"{place}.waiting-{self.run}" if self.one else f"{place}/_waiting-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, _ = opened(self.path)
        store.create_dir(self.waiting, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        done, shapes, rows, size = [], [], [], 0

        def flush():
            name = f"part-{task:05d}-{len(done):04d}-{self.run}-{attempt}"
            for ending, raw in self.layer.part(shapes, rows).items():
                with store.open_output_stream(f"{self.waiting}/{name}{ending}") as f:
                    f.write(raw)
            done.append(name)

        for batch in iterator:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                more = [list(map(plain, some.column(n).to_pylist())) for n, _ in self.layer.columns]
                n, size = some.num_rows, size + some.nbytes
                shapes += rings_of(some.column("rings"))
                rows += zip(*more) if more else [()] * n
                if len(rows) >= self.part_rows or size >= self.part_bytes:
                    flush()
                    shapes, rows, size = [], [], 0
        if rows:
            flush()
        return Parts(done)

    def commit(self, messages: list[Parts | None]) -> None:
        """Moves what the finished tasks wrote; parts of other attempts go with the waiting folder."""
        store, place = opened(self.path)
        names = [n for m in messages if m is not None for n in m.files]
        endings = KINDS[self.layer.kind]
        try:
            if self.one and len(names) > 1:
                raise ValueError("the layer is larger than one file should be; give a folder, or larger limits of a part")
            stem = place[: -len(endings[0])] if self.one else place
            if self.overwrite:
                old = store.get_file_info([stem + e for e in endings] if self.one else fs.FileSelector(place, allow_not_found=True))
                for f in old:
                    if f.type == fs.FileType.File and (self.one or f.base_name.startswith("part-")):
                        store.delete_file(f.path)
            for name in names:
                for ending in endings:
                    target = f"{stem}{ending}" if self.one else f"{stem}/{name}{ending}"
                    if store.get_file_info(f"{self.waiting}/{name}{ending}").type == fs.FileType.File:
                        store.move(f"{self.waiting}/{name}{ending}", target)
        finally:
            self.clear(store)

    def abort(self, messages: list[Parts | None]) -> None:
        self.clear(opened(self.path)[0])

    def clear(self, store: fs.FileSystem) -> None:
        if store.get_file_info(self.waiting).type == fs.FileType.Directory:
            store.delete_dir(self.waiting)


class MapSink(DataSource):
    """Options: path, kind (gpkg, shp), geometry (polygon, line, point), layer, crs, truncate, one, part_rows, part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_map"

    def writer(self, schema: T.StructType, overwrite: bool) -> MapWriter:
        o = self.options
        of = {T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "real", T.DoubleType: "real", T.BooleanType: "bool", T.DateType: "date", T.TimestampType: "time", T.TimestampNTZType: "time", T.BinaryType: "bytes"}
        columns = tuple((f.name, of.get(type(f.dataType), "text")) for f in schema.fields if f.name != "rings")
        layer = Layer(o["kind"], columns, o.get("geometry", "polygon"), o.get("layer", "layer"), o.get("crs"), o.get("truncate", "false") == "true")
        return MapWriter(o["path"], layer, o.get("one", "false") == "true", overwrite, int(o.get("part_rows", PART_ROWS)), int(o.get("part_bytes", PART_BYTES)))


def write_map(df: DataFrame, path: str, kind: str | None = None, crs: str | None = None, geometry: str = "polygon", layer: str = "layer", order: list[str] | None = None, mode: str = "errorifexists", truncate: bool = False, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> None:
    """Rows with rings as GeoPackages or shapefiles: one file where path ends in .gpkg or .shp, else a folder of parts.

    All other columns are attributes; nested ones become JSON, decimals doubles. rings hold outlines and holes, or lines, or
    points (geometry). Null or empty rings give a record without a shape. order sorts the rows of a file. A layer without
    rows is an error, as is a single file beyond a part's limits. Shapefiles can't tell empty texts from nulls; their names
    are cut to ten bytes; a text of over 254 bytes is an error unless truncate is set.
    """
    endings = {".gpkg": "gpkg", ".shp": "shp"}
    found = next((k for e, k in endings.items() if path.lower().endswith(e)), None)
    kind = kind or found
    if kind not in KINDS or found not in (None, kind):
        raise ValueError(f"{path!r} is no place for a layer of kind {kind!r}; known: {', '.join(KINDS)}")
    if geometry not in GEOMETRIES:
        raise ValueError(f"unknown geometry {geometry!r}; known: {', '.join(GEOMETRIES)}")
    if crs:
        crs_text(crs)
    store, place = opened(path)
    if mode not in ("errorifexists", "overwrite", "append") or (found and mode == "append"):
        raise ValueError(f"unknown mode {mode!r} for {path!r}")
    if mode == "errorifexists" and store.get_file_info(place).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    if df.isEmpty():
        raise ValueError("the layer has no rows")
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    for f in df.schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        if f.name != "rings" and isinstance(f.dataType, nested):
            df = df.withColumn(f.name, F.to_json(F.col(name)))
        elif isinstance(f.dataType, T.DecimalType):
            df = df.withColumn(f.name, F.col(name).cast("double"))
        elif f.name != "rings" and not isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BinaryType | T.StringType):
            df = df.withColumn(f.name, F.col(name).cast("string"))
    df = df.repartition(1) if found else df
    df = df.sortWithinPartitions(*order) if order else df
    df.sparkSession.dataSource.register(MapSink)
    options = {"kind": kind, "geometry": geometry, "layer": layer, "crs": crs, "truncate": str(truncate).lower(), "one": str(bool(found)).lower(), "part_rows": part_rows, "part_bytes": part_bytes}
    w = df.write.format(MapSink.name()).options(**{k: v for k, v in options.items() if v is not None})
    w.mode("overwrite" if mode == "overwrite" else "append").save(path)


# --- reading ----------------------------------------------------------------------------------------------------------


def from_wkb(raw: bytes, at: int = 0) -> tuple[list[tuple[str, list[np.ndarray]]], int]:
    """(kind, rings) of each part of a geometry that starts at a place, and the place after it; heights are left out."""
    end = "<" if raw[at] else ">"
    code = struct.unpack_from(end + "I", raw, at + 1)[0]
    flags, code = code >> 29, code & 0x1FFFFFFF
    # either thousands or the upper bits of the type tell of heights and measures
    wide = 2 + (flags >> 2 & 1) + (flags >> 1 & 1) + (0, 1, 1, 2)[code // 1000 % 4]
    at += 9 if flags & 1 else 5
    code %= 1000

    def points(n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(raw, end + "f8", n * wide, at).reshape(n, wide)[:, :2]
        at += 8 * n * wide
        return got

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(end + "I", raw, at - 4)[0]

    if code == 1:
        return [("Point", [points(1)])], at
    if code == 2:
        return [("LineString", [points(number())])], at
    if code == 3:
        return [("Polygon", [points(number()) for _ in range(number())])], at
    if code not in (4, 5, 6, 7):
        raise ValueError(f"unknown geometry type {code}")
    out = []
    for _ in range(number()):
        parts, at = from_wkb(raw, at)
        out += parts
    return out, at


def from_geopackage(raw: bytes, layer: str | None) -> Iterator[tuple[int, str, str, list]]:
    """(fid, kind, props, rings) of a file's features; a feature of several parts has a row for each."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(raw)
        db.row_factory = sqlite3.Row
        found = db.execute("select table_name, column_name from gpkg_geometry_columns where ? is null or table_name = ? order by 1", (layer, layer)).fetchall()
        if layer is not None and not found:
            raise ValueError(f"no layer {layer!r} in the file")
        for name, geom in map(tuple, found):
            quoted = '"' + name.replace('"', '""') + '"'
            keys = {r["name"] for r in db.execute(f"pragma table_info({quoted})") if r["pk"]}
            for n, row in enumerate(db.execute(f"select rowid as \"row of table\", * from {quoted} order by rowid")):
                blob = row[geom]
                props = {k: row[k].hex() if isinstance(row[k], bytes) else row[k] for k in row.keys()[1:] if k != geom and k not in keys}
                if blob is None or blob[3] & 0b10000:
                    continue
                size = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
                for kind, rings in from_wkb(blob, 8 + size)[0]:
                    if kind == "Polygon":  # outline clockwise, holes the other way
                        rings = [r if (spin(r) > 0) == (k > 0) else r[::-1] for k, r in enumerate(rings) if len(r)]
                    if rings and len(rings[0]):
                        yield int(row["row of table"] if row["row of table"] is not None else n), kind, json.dumps(props, ensure_ascii=False), [[{"x": x, "y": y} for x, y in r.tolist()] for r in rings]
    finally:
        db.close()


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """(source, fid, kind, props, rings) of the features of GeoPackages, of all layers or of one; null shapes are dropped. A
    file is read by one task: large layers are folders of parts."""
    from .grids import LAYER

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for source, raw in zip(f["path"], f["content"]):
                rows = []
                for row in from_geopackage(bytes(raw), layer):
                    rows.append((source, *row))
                    if len(rows) == 8 * SLICE:
                        yield pd.DataFrame(rows, columns=["source", "fid", "kind", "props", "rings"])
                        rows = []
                yield pd.DataFrame(rows, columns=["source", "fid", "kind", "props", "rings"])

    files = spark.read.format("binaryFile") if path.lower().endswith(".gpkg") else spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg")
    return files.load(path).select("path", "content").mapInPandas(parse, LAYER)


def from_dbf(raw: bytes | None) -> list[dict]:
    """The records of a table of attributes; blanks are None."""
    if not raw:
        return []
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while at + 32 <= head and raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(errors="replace"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32

    def value(kind: str, decimals: int, text: str):
        if not text or text.strip("*") == "" or kind == "L" and text == "?":
            return None
        if kind in "NF":
            return float(text) if decimals or any(c in text for c in ".eE") else int(text)
        return text in "TtYy" if kind == "L" else f"{text[:4]}-{text[4:6]}-{text[6:]}" if kind == "D" else text

    out = []
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, kind, width, decimals in fields:
            row[name] = value(kind, decimals, raw[at : at + width].decode(errors="replace").strip(" \0"))
            at += width
        out.append(row)
    return out
