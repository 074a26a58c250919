"""Binary rasters as a Spark data source: byte ranges as partitions, bands, and reading of only the rows and columns asked for.

    spark.dataSource.register(RasterSource)
    spark.read.format("lodestone_raster").options(width=900, height=1200, rows="100:200", cols="40:80").load(path)

A file holds rows from the top; a row holds its bands one after the other. Files are opened by the file systems of
pyarrow, so a path may be local or a URI of a store that executors reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geometry import Affine
from .grids import Meta, read_header

#: Number types by the names that raster headers use (fixed values of public formats), in lower case.
CELL_TYPES = {
    "ieee4bytereal": "f4", "ieee8bytereal": "f8", "signed8bitinteger": "i1", "unsigned8bitinteger": "u1", "signed16bitinteger": "i2",
    "unsigned16bitinteger": "u2", "signed32bitinteger": "i4", "unsigned32bitinteger": "u4", "float32": "f4", "float64": "f8", "int16": "i2", "int32": "i4", "uint8": "u1",
}
#: Bytes of a partition, about, and of an Arrow batch's cells.
PART_BYTES, BATCH_CELLS = 16 << 20, 1 << 18


def span(text: str | None, size: int) -> tuple[int, int]:
    """Bounds "a:b" within 0 and size; either may be left out."""
    a, _, b = (text or ":").partition(":")
    low, high = int(a) if a.strip() else 0, int(b) if b.strip() else size
    return max(0, low), max(0, min(high, size))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def file_size(path: str) -> int:
    store, place = opened(path)
    size = store.get_file_info(place).size
    if size is None:
        raise FileNotFoundError(path)
    return size


@dataclass(frozen=True)
class Layout:
    """How a file's bytes are rows, columns and bands, and which of them are wanted."""

    width: int
    height: int
    bands: int = 1
    kind: str = "<f4"
    skip: int = 0
    nodata: float | None = None
    rows: tuple[int, int] = (0, 0)
    cols: tuple[int, int] = (0, 0)
    band: int = 0

    @classmethod
    def of(cls, o: dict) -> Layout:
        """From a source's options; raises where a size is missing or a type unknown."""
        o = {k.lower(): v for k, v in o.items()}
        if not {"width", "height"} <= set(o):
            raise ValueError("a raster needs the options width and height")
        kind = CELL_TYPES.get(str(o.get("type", "float32")).lower())
        if kind is None:
            raise ValueError(f"unknown cell type {o['type']!r}; known: {', '.join(sorted(CELL_TYPES))}")
        order = {"lsbfirst": "<", "little": "<", "msbfirst": ">", "big": ">"}[str(o.get("order", "little")).lower()]
        width, height, bands, band = int(o["width"]), int(o["height"]), int(o.get("bands", 1)), int(o.get("band", 0))
        if min(width, height, bands) < 1 or not 0 <= band <= bands:
            raise ValueError("width, height and bands must be 1 at least, band a number of a band or 0 for all")
        nodata = o.get("nodata")
        return cls(width, height, bands, order + kind, int(o.get("skip", 0)), None if nodata in (None, "") else float(nodata), span(o.get("rows"), height), span(o.get("cols"), width), band)

    @property
    def wanted(self) -> list[int]:
        """Places of the bands that are read."""
        return [self.band - 1] if self.band else list(range(self.bands))

    @property
    def names(self) -> list[str]:
        return ["v"] if len(self.wanted) == 1 else [f"v{b + 1}" for b in self.wanted]

    def ranges(self, first: int, last: int) -> list[tuple[int, int, int, int, int]]:
        """(offset, bytes, row, rows, band) of what is read for rows first to last - 1. Whole rows with all their bands are
        one range (band -1); where less than a quarter of a row is wanted, each piece of it is a range of its own."""
        item = np.dtype(self.kind).itemsize
        line, (lo, hi) = self.bands * self.width * item, self.cols
        if 4 * (hi - lo) * len(self.wanted) >= self.bands * self.width:
            return [(self.skip + first * line, (last - first) * line, first, last - first, -1)]
        return [(self.skip + r * line + (b * self.width + lo) * item, (hi - lo) * item, r, 1, b) for r in range(first, last) for b in self.wanted]


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class RasterReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, part_bytes: int):
        self.path, self.layout, self.part_bytes = path, layout, part_bytes

    def partitions(self) -> list[InputPartition]:
        l, (a, b) = self.layout, self.layout.rows
        if a >= b or l.cols[0] >= l.cols[1]:
            return [Rows(0, 0)]
        size = sum(n for _, n, *_ in l.ranges(a, a + 1))
        step = max(1, self.part_bytes // max(size, 1))
        return [Rows(r, min(b, r + step)) for r in range(a, b, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        l, (first, last), (lo, hi) = self.layout, partition.value, self.layout.cols
        if first >= last:
            return
        store, path = opened(self.path)
        step = max(1, BATCH_CELLS // (l.bands * l.width))
        with store.open_input_file(path) as f:
            for r in range(first, last, step):
                end = min(last, r + step)
                block = np.empty((end - r, len(l.wanted), hi - lo), dtype=l.kind)
                for offset, n, row, rows, band in l.ranges(r, end):
                    f.seek(offset)
                    raw = f.read(n)
                    if len(raw) < n:
                        raise ValueError(f"{self.path} ends before row {row + rows}")
                    if band < 0:
                        block[:] = np.frombuffer(raw, dtype=l.kind).reshape(rows, l.bands, l.width)[:, l.wanted, lo:hi]
                    else:
                        block[row - r, l.wanted.index(band)] = np.frombuffer(raw, dtype=l.kind)
                yield self.cells(block, r)

    def cells(self, block: np.ndarray, row: int) -> pa.RecordBatch:
        """Cells of some rows; NaN and the nodata value, compared in the file's own type, are null."""
        rows, _, width = block.shape
        kind = self.layout.kind
        missing = None if self.layout.nodata is None else np.dtype(kind).type(self.layout.nodata)
        out = [pa.array(np.repeat(np.arange(row, row + rows, dtype=np.int32), width)), pa.array(np.tile(np.arange(*self.layout.cols, dtype=np.int32), rows))]
        for b in range(block.shape[1]):
            v = block[:, b].ravel()
            bad = np.isnan(v) if v.dtype.kind == "f" else np.zeros(len(v), dtype=bool)
            out.append(pa.array(v.astype(np.float64), mask=bad if missing is None else bad | (v == missing)))
        return pa.RecordBatch.from_arrays(out, names=["r", "c", *self.layout.names])


class RasterSource(DataSource):
    """(r, c, v), or v1, v2... of several bands. Options: path, width, height, bands, band (from 1; 0 for all), type, order
    (little, big), skip (bytes of a header in the file), nodata, rows and cols ("a:b"), part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_raster"

    def schema(self) -> str:
        return "r int, c int, " + ", ".join(f"{n} double" for n in Layout.of(self.options).names)

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"], Layout.of(self.options), int(self.options.get("part_bytes", PART_BYTES)))


def read_raster(spark: SparkSession, path: str, **options) -> DataFrame:
    """Cells of a binary raster, by RasterSource; null options are left out."""
    spark.dataSource.register(RasterSource)
    return spark.read.format(RasterSource.name()).options(**{k: v for k, v in options.items() if v is not None}).load(path)


def describe(header: str, crs: str | None = None) -> tuple[Meta, dict]:
    """Meta and reading options from the text of a raster header of key = value lines. The registered cell's corner and the
    cell sizes give the transform; without them cells count from 0."""
    h = read_header(header)
    height, width = int(h["nroflines"]), int(h["nrofcellsperline"])
    options = {"height": height, "width": width, "bands": int(h.get("nrofbands", 1)), "type": h.get("celltype", "IEEE4ByteReal"), "order": h.get("byteorder", "LSBFirst"), "nodata": h.get("nullcellvalue"), "skip": int(h.get("headeroffset", 0))}
    if "eastings" not in h:
        return Meta(height, width, Affine(e=1.0), crs), options
    dx, dy = float(h.get("xdimension", 1)), float(h.get("ydimension", 1))
    left, top = float(h["eastings"]) - dx * float(h.get("registrationcellx", 0)), float(h["northings"]) + dy * float(h.get("registrationcelly", 0))
    return Meta(height, width, Affine(dx, 0.0, left, 0.0, -dy, top), crs), options


def load(spark: SparkSession, path: str, crs: str | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, transform: Affine | None = None, band: int = 1) -> tuple[DataFrame, Meta]:
    """One variable's (r, c, v) and Meta: a raster by its header (.ers beside its body), cells in Parquet, or a CSV grid.

    With rows and cols only that part is read; its cells are numbered from 0, and the transform starts there.
    """
    from pyspark.sql import functions as F

    from .grids import crop_box, read_csv_grid

    text = lambda span: None if span is None else f"{span[0]}:{span[1]}"
    if path.lower().endswith(".ers"):
        meta, options = describe(spark.read.text(path, wholetext=True).first()[0], crs)
        cells = read_raster(spark, path[:-4], **options, band=band, rows=text(rows), cols=text(cols))
    else:
        cells = read_csv_grid(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path).select("r", "c", "v")
        size = cells.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
        meta = Meta((-1 if size.r is None else size.r) + 1, (-1 if size.c is None else size.c) + 1, Affine(e=1.0), crs)
    t = transform or meta.transform
    if rows or cols:
        (r0, r1), (c0, c1) = span(text(rows), meta.height), span(text(cols), meta.width)
        x, y = t.to_map(r0, c0)
        cells, meta, t = crop_box(cells, r0, r1, c0, c1), Meta(r1 - r0, c1 - c0, t, crs), Affine(t.a, t.b, x, t.d, t.e, y)
    return cells, Meta(meta.height, meta.width, t, crs)


def load_all(spark: SparkSession, run) -> tuple[DataFrame, Meta]:
    """(r, c, one column a variable) of the grids that a run names, and what they have in common; raises where they don't
    lie on each other. The run's extra settings may hold transform (six numbers) and crop (first and last row and column)."""
    from .grids import check_registered, resolve_crs, stack

    crop, six = run.extra.get("crop"), run.extra.get("transform")
    crs = resolve_crs(None, run.grid_crs) if run.grid_crs else None
    found = {v: load(spark, run.grid_path(v), crs, tuple(crop[:2]) if crop else None, tuple(crop[2:]) if crop else None, Affine(*map(float, six)) if six else None) for v in run.variables()}
    meta = check_registered({v: m for v, (_, m) in found.items()})
    return stack({v: cells for v, (cells, _) in found.items()}), meta
