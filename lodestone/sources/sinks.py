"""Result tables, map layers and provenance as files."""

from __future__ import annotations

import json
import platform
import subprocess
import sys
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box_rings
from .maps import KINDS, write_map


def wkt(rings: str = "rings") -> Column:
    """Polygon text of rings."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring), ", "), F.lit(")"))


def geojson_feature(df: DataFrame, rings: str = "rings") -> DataFrame:
    """One column, value: each row as a GeoJSON feature; the other columns are its properties."""
    props = [c for c in df.columns if c != rings]
    coordinates = F.transform(F.col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_layer(df: DataFrame, path: str, kind: str = "geojson", mode: str = "errorifexists", **options) -> None:
    """Polygons as lines of GeoJSON features, as WKT in Parquet, as CSV with WKT, or as GeoPackages (gpkg) and shapefiles
    (shp) with the options of `maps.write_map`. An empty layer is an error."""
    if kind in KINDS:
        return write_map(df, path, kind, mode=mode, **options)
    if df.isEmpty():
        raise ValueError("the layer has no rows")
    if kind == "geojson":
        geojson_feature(df).write.mode(mode).text(path)
    elif kind == "parquet":
        df.withColumn("wkt", wkt()).drop("rings").write.mode(mode).parquet(path)
    elif kind == "csv":
        df.withColumn("wkt", wkt()).drop("rings").write.mode(mode).csv(path, header=True)
    else:
        raise ValueError(f"unknown layer kind: {kind}")


def windows_layer(ranked: DataFrame) -> DataFrame:
    """Ranked windows with boxes (x0, x1, y0, y1) as polygons."""
    return ranked.withColumn("rings", box_rings("x0", "x1", "y0", "y1")).drop("x0", "x1", "y0", "y1")


def circles_layer(ranked: DataFrame, radius: float, points: int = 64) -> DataFrame:
    """Windows with centres (cx, cy) as polygons of circles."""
    at = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.struct((F.col("cx") + radius * F.cos(2 * F.pi() * (i % points) / points)).alias("x"), (F.col("cy") + radius * F.sin(2 * F.pi() * (i % points) / points)).alias("y")))
    return ranked.withColumn("rings", F.array(at)).drop("cx", "cy")


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet", mode: str = "overwrite", partition: list[str] | None = None) -> None:
    """Each table in a folder of its own; CSV tables are small summaries and get one file."""
    for name, df in tables.items():
        w = (df.coalesce(1) if kind in ("csv", "json") else df).write.mode(mode)
        w = w.partitionBy(*partition) if partition else w
        w.csv(f"{folder}/{name}", header=True) if kind == "csv" else w.json(f"{folder}/{name}") if kind == "json" else w.parquet(f"{folder}/{name}")


def read_results(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Result tables below folders, with the file each row comes from."""
    return spark.read.option("recursiveFileLookup", "true").parquet(*folders).withColumn("source", F.input_file_name())


def provenance(spark: SparkSession, command: list[str] | None = None, repo: str | None = None) -> dict:
    """Time, command, versions and settings of a run; the repository's commit if there is one."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    conf = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}
    out = {"time": datetime.now(UTC).isoformat(), "command": command or sys.argv, "python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "conf": conf}
    return out | ({"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))} if repo else {})


def write_json(spark: SparkSession, doc: dict, path: str) -> None:
    """A document as one JSON file, in any store that Spark writes to."""
    spark.createDataFrame([(json.dumps(doc, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a path; each file is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, expected: dict[str, str]) -> list[str]:
    """What is wrong with artefacts: names (ends of paths) that are missing or have another digest than expected."""
    spark = found.sparkSession
    want = spark.createDataFrame(list(expected.items()), "name string, digest string")
    got = want.join(found, F.col("path").endswith(F.concat(F.lit("/"), F.col("name"))), "left")  # one row a name
    return [f"{r.name}: {'missing' if r.sha256 is None else 'differs'}" for r in got.where("sha256 is null or sha256 <> digest").orderBy("name").collect()]
