"""python -m lodestone CONFIG: run a configuration and write its tables.

CONFIG is YAML or JSON and names the grids (rasters with a header, CSV, or cells in Parquet) and the footprints (GeoJSON or
shapefile). --cells takes cells that are ready instead (Parquet with r, c and a column for each variable, with --height and
--width), --footprints another layer.

python -m lodestone compare FOLDER... --output PATH [--base METHOD]: tables that set the stored results of runs side by side.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.geometry import Affine
from .operators import ordering, runs
from .sources import config, grids, raster, sinks


def compare(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="lodestone compare")
    p.add_argument("folders", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--base", help="method over which gains are taken")
    a = p.parse_args(argv)
    sinks.write_tables(runs.compared(SparkSession.builder.getOrCreate(), a.folders, a.base), a.output, "csv")
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["compare"]:
        return compare(argv[1:])
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("config")
    p.add_argument("--cells")
    p.add_argument("--footprints")
    p.add_argument("--height", type=int)
    p.add_argument("--width", type=int)
    p.add_argument("--transform", type=float, nargs=6, default=(1, 0, 0, 0, -1, 0))
    p.add_argument("--check", action="store_true", help="validate the configuration and stop")
    a = p.parse_args(argv)
    run = config.build(config.read(a.config))
    if a.check:
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.cells and not (a.height and a.width):
        p.error("--cells needs --height and --width")
    cells, meta = (spark.read.parquet(a.cells), grids.Meta(a.height, a.width, Affine(*a.transform))) if a.cells else raster.load_all(spark, run)
    layer = a.footprints or run.footprints
    polygons = grids.read_shapefile(spark, layer) if layer.lower().endswith(".shp") else grids.read_geojson(spark, layer)
    polygons = grids.fix_rings(polygons).select((F.col("fid") + 1).cast("int").alias("dep_id"), "rings")
    out = runs.run_all(run, ordering.cut(cells), polygons, meta.transform, meta.height, meta.width)
    sinks.write_tables({"summary": out["summary"]}, f"{run.output}/{run.name}", "csv")
    sinks.write_json(spark, sinks.provenance(spark), f"{run.output}/{run.name}/provenance")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
