"""A configured run from cells to recovery tables, and its comparison with a random selection."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Affine, bounds, reproject
from ..sources.config import Run
from . import recovery as V
from .ordering import cut, top, top_per_group
from .ranking import fuse, rank_components, rank_raw, rank_references
from .windows import Shape, circle_mask, circle_template, resample, template, windows, with_reference

#: A case's reference vector: joint is that of all variables, raw_vector and raw_shape are those of a raw comparison.
REFERENCES = "dep_ref int, method string, analysis string, variable string, joint array<double>, vector array<double>, raw_vector array<double>, shape array<int>, raw_shape array<int>"


def footprint_bounds(polygon: DataFrame):
    """x0, x1, y0 and y1 over all parts of a footprint; raises without one."""
    b = polygon.select(bounds(F.col("rings")).alias("b")).agg(*[f(f"b.{c}").alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))]).first()
    if b.x0 is None:
        raise ValueError("the reference has no footprint")
    return b


def footprint_box(polygon: DataFrame, t: Affine, height: int, width: int) -> tuple[int, int, int, int]:
    """First and last row and column (the last ones beyond) of the cells that a footprint's bounds touch, held within the
    grid; raises where they lie beside it."""
    b = footprint_bounds(polygon)
    rows, cols = zip(*(t.to_cell(x, y) for x, y in ((b.x0, b.y0), (b.x1, b.y1))))
    box = [int(f) for f in (np.clip(np.floor(min(rows)), 0, height), np.clip(np.ceil(max(rows)), 0, height), np.clip(np.floor(min(cols)), 0, width), np.clip(np.ceil(max(cols)), 0, width))]
    if box[0] >= box[1] or box[2] >= box[3]:
        raise ValueError("the reference's footprint lies outside the grid")
    return tuple(box)


def window_of(box: tuple[int, int, int, int]) -> tuple[int, int]:
    return box[1] - box[0], box[3] - box[2]


def footprint_circle(run: Run, polygon: DataFrame, t: Affine) -> tuple[float, float, float]:
    """Centre of a footprint's bounds and the radius on the map: that of the run, in cells, else half the larger extent."""
    b = footprint_bounds(polygon)
    radius = run.radius * abs(t.a) if run.radius else max(b.x1 - b.x0, b.y1 - b.y0) / 2
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2, radius


def reference_patch(cells: DataFrame, column: str, polygon: DataFrame, t: Affine, h: int, w: int, rotation: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """The h x w patch about a footprint's bounds, turned and scaled where asked. A footprint may have parts, one a row;
    the bounds are those of all. Raises where cells are missing, and without a footprint."""
    b = footprint_bounds(polygon)
    rows, cols = zip(*(t.to_cell(x, y) for x, y in ((b.x0, b.y0), (b.x1, b.y1))))
    r0, c0 = max(0, int(np.floor(min(rows)))), max(0, int(np.floor(min(cols))))
    if rotation == 0 and scale == 1:
        patch = template(cells, column, r0, r0 + h, c0, c0 + w)
    else:
        m = int(np.ceil(max(h, w) * max(1.0, 1 / scale)))
        patch = resample(template(cells, column, r0 - m, r0 + h + m, c0 - m, c0 + w + m), m, m, h, w, rotation, scale)
    if np.isnan(patch).any():
        raise ValueError(f"the reference lacks {int(np.isnan(patch).sum())} cells of {column}")
    return patch


@dataclass(frozen=True)
class Shared:
    """What cases of one grid share: the windows, cut once, and distances that one scan has given (window_id, ref, k, dist),
    with the number in it of each reference, angle and scale. Nothing, where each reference has a window of its own."""

    places: DataFrame | None
    dist: DataFrame | None = None
    numbers: dict = field(default_factory=dict)


def shared(run: Run, cells: DataFrame, footprints: DataFrame, t: Affine, height: int, width: int, wanted: list[tuple[int, float, float]], ks: list) -> Shared:
    """Windows for all cases, and all distances of one variable's components in one scan: wanted has the reference, angle
    and scale of each case. Fusions and ks by variable share the windows alone."""
    if run.window is None:
        return Shared(None)
    h, w = run.window
    mask = circle_mask(h, w, run.radius) if run.patch == "circle" else None
    places = cut(windows(cells, Shape(height, width, h, w, *run.stride), run.variables(), mask))
    if len(run.variables()) > 1 or any(isinstance(k, tuple) for k in ks):
        return Shared(places)
    if run.crs_policy == "reproject":
        footprints = reproject(footprints, run.footprint_crs, run.grid_crs)
    column, keep = run.variables()[0], slice(None) if mask is None else mask.ravel()
    vectors = {n: reference_patch(cells, column, footprints.where(F.col("dep_id") == r), t, h, w, angle, scale).ravel()[keep] for n, (r, angle, scale) in enumerate(wanted)}
    dist = rank_references(places, vectors, ks, column, run.weight_mode, run.weights_over, run.whiten)
    best = top_per_group(dist, ["ref", "k"], run.top_k, ["dist", "window_id"]).drop("rank")
    return Shared(places, cut(best), {one: n for n, one in enumerate(wanted)})


def case(run: Run, cells: DataFrame, footprints: DataFrame, t: Affine, height: int, width: int, reference: int, k: int | tuple[int, ...], raw: bool = False, common: Shared | None = None) -> dict[str, DataFrame]:
    """One reference and k: ranked windows, cells, curve, coverage, hits, events, summary. footprints has dep_id, rings.
    common: what this case shares with others, from shared()."""
    columns = run.variables()
    if run.crs_policy == "reproject":
        footprints = reproject(footprints, run.footprint_crs, run.grid_crs)
    polygon = footprints.where(F.col("dep_id") == reference)
    if run.window is None and run.patch == "circle":
        found = {c: circle_template(cells, c, t, *footprint_circle(run, polygon, t)) for c in columns}
        (first, mask, _), keep = found[columns[0]], found[columns[0]][1].ravel()
        (h, w), vectors = first.shape, {c: patch.ravel()[keep] for c, (patch, _, _) in found.items()}
    else:
        h, w = run.window or window_of(footprint_box(polygon, t, height, width))
        mask = circle_mask(h, w, run.radius) if run.patch == "circle" else None
        keep = slice(None) if mask is None else mask.ravel()
        vectors = {c: reference_patch(cells, c, polygon, t, h, w, run.rotation, run.scale).ravel()[keep] for c in columns}
    shape = Shape(height, width, h, w, *run.stride)
    places = common.places if common and common.places is not None else windows(cells, shape, columns, mask)
    options = {"mode": run.weight_mode, "over": run.weights_over, "whiten": run.whiten}
    number = common.numbers.get((reference, run.rotation, run.scale)) if common and not raw else None
    frame = cut(with_reference(places.drop("r0", "c0"), vectors=vectors)) if number is None else None
    if number is not None:
        dist = common.dist.where((F.col("ref") == number) & (F.col("k") == k)).select("window_id", "dist")
    elif raw:
        dist = rank_raw(frame, columns[0])
    elif len(columns) == 1:
        dist = rank_components(frame, columns[0], k=k, **options)
    else:
        ks = list(k) if isinstance(k, tuple) else [k] * len(columns)
        extra = {"concat_alpha": [run.alpha], "two_stage": [max(ks)]}.get(run.fusion, [])
        weights = {"alpha": [run.alpha, 1 - run.alpha]} if run.fusion == "late_sum" and len(columns) == 2 else {}
        dist = fuse(run.fusion, frame, columns, ks, *extra, **weights)
    ranked = top(dist, run.top_k, ["dist", "window_id"])
    ids = F.col("window_id")
    ranked = cut(ranked.withColumn("r0", (F.floor(ids / shape.per_row) * shape.sy).cast("int")).withColumn("c0", (ids % shape.per_row * shape.sx).cast("int")))
    tested = cut(V.polygon_cells(footprints.where(F.col("dep_id") != reference), t))
    gained, areas = V.gains(ranked, tested, h, w), V.areas(tested)
    covered = cut(V.coverage(gained, areas))
    hits, curve = V.first_hits(covered, run.min_cover), V.curve(gained, areas, run.top_k)
    tag = [F.lit(reference).alias("dep_ref"), F.lit("-".join(map(str, k if isinstance(k, tuple) else (k,)))).alias("ks")]
    joint = np.concatenate([vectors[c] for c in columns]).tolist() if run.analysis == "multivariate" else None
    vector = None if joint else vectors[columns[0]].tolist()
    reference_row = (reference, "raw" if raw else run.fusion if run.analysis == "multivariate" else "components", run.analysis, columns[0] if vector else None, joint, vector, vector if raw else None, [h, w], None)
    return {
        "reference": cells.sparkSession.createDataFrame([reference_row], REFERENCES),
        "ranked": ranked, "tested": tested, "curve": curve, "coverage": covered, "hits": hits, "events": V.events(ranked, tested, covered, h, w, run.min_cover),
        "summary": V.summary(curve.select("*", *tag), hits.select("*", *tag), ["dep_ref", "ks"]), "windows": places.select("window_id", "r0", "c0"),
    }


def against_random(run: Run, tables: dict[str, DataFrame], grid: DataFrame, cell_area: float = 1.0) -> DataFrame:
    """Recovery over that of a random selection of equal area, for a finished case. grid has the cells that count."""
    (h, w), (sy, sx) = run.window or tables["reference"].select("shape").first()[0], run.stride
    n, t_max = tables["windows"].count(), min(run.top_k, tables["windows"].count())
    null = V.null_curve(V.cover_counts(tables["tested"], tables["windows"], h, w, sy, sx), n, t_max)
    area = V.null_union(V.cover_counts(grid.select("r", "c"), tables["windows"], h, w, sy, sx), n, t_max, cell_area)
    return V.equal_area(tables["curve"], V.union_area(tables["ranked"], h, w, run.top_k, cell_area), null, area)


def swap_references(run: Run, cells: DataFrame, footprints: DataFrame, t: Affine, height: int, width: int, references: list[int], k: int) -> DataFrame:
    """Summaries with each footprint as the reference in turn."""
    common = shared(run, cells, footprints, t, height, width, [(r, run.rotation, run.scale) for r in references], [k])
    out = None
    for r in references:
        one = case(run, cells, footprints, t, height, width, r, k, common=common)["summary"]
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(*tables: DataFrame) -> str:
    """Digest of tables' rows, whatever their order: counts and sums of hashes, one pass each."""
    parts = []
    for t in tables:
        hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(t.columns)])
        parts += list(t.agg(F.count(F.lit(1)), F.sum(hashed.cast("decimal(38,0)"))).first()) + sorted(t.columns)
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any store that Spark reads."""
    try:
        spark.read.text(path).limit(1).count()
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def run_all(run: Run, cells: DataFrame, footprints: DataFrame, t: Affine, height: int, width: int, write: bool = True) -> dict[str, DataFrame]:
    """Every case of a run, written to its folder, and all summaries together.

    A folder's name holds the digest of settings and data, and its last file is the resolved configuration: a case with
    the same digest that was written to its end is read instead.
    """
    from ..sources.sinks import write_json, write_tables

    spark: SparkSession = cells.sparkSession
    data = fingerprint(cells, footprints) + repr((t, height, width)) if write else ""
    every = None
    todo = [(r, k) for r, k in run.cases() if not write or not exists(spark, f"{run.folder(r, k, data)}/finished")]
    wanted = list(dict.fromkeys((r, run.rotation, run.scale) for r, _ in todo))
    common = shared(run, cells, footprints, t, height, width, wanted, list(dict.fromkeys(k for _, k in todo))) if todo else None
    for reference, k in run.cases():
        folder = run.folder(reference, k, data)
        if not write:
            summary = case(run, cells, footprints, t, height, width, reference, k, common=common)["summary"]
        else:
            if (reference, k) in todo:
                write_tables(case(run, cells, footprints, t, height, width, reference, k, common=common), folder)
                write_json(spark, run.resolved() | {"reference": reference, "k": k, "data": data}, f"{folder}/finished")
            summary = spark.read.parquet(f"{folder}/summary")
        every = summary if every is None else every.unionByName(summary)
    return {"summary": every}


def swept(run: Run, cells: DataFrame, footprints: DataFrame, t: Affine, height: int, width: int, rotations: list[float], scales: list[float]) -> DataFrame:
    """Summaries of every case with the template turned and scaled, each against a random selection of equal area."""
    turns = [(float(a), float(s)) for a in rotations for s in scales]
    cases = run.cases()
    common = shared(run, cells, footprints, t, height, width, [(r, a, s) for a, s in turns for r in dict.fromkeys(r for r, _ in cases)], list(dict.fromkeys(k for _, k in cases)))
    out = None
    for angle, scale in turns:
        turned = replace(run, rotation=float(angle), scale=float(scale))
        for reference, k in turned.cases():
            tables = case(turned, cells, footprints, t, height, width, reference, k, common=common)
            ratio = against_random(turned, tables, cells).where(F.col("rank") == min(run.top_k, tables["windows"].count())).select("ratio", F.lit(reference).alias("dep_ref"))
            one = tables["summary"].withColumn("angle", F.lit(float(angle))).withColumn("scale", F.lit(float(scale))).join(ratio, "dep_ref", "left")
            out = one if out is None else out.unionByName(one)
    return out


def rescored(run: Run, ranked: DataFrame, footprints: DataFrame, t: Affine, pool: DataFrame | None = None) -> dict[str, DataFrame]:
    """Curve, coverage and first hits of a finished ranking (window_id, rank, r0, c0) against other footprints, and with
    pool (window_id) of the windows in it alone, numbered anew."""
    h, w = run.window
    ranked = ranked if pool is None else V.reranked(ranked, pool, run.top_k)
    tested = cut(V.polygon_cells(footprints, t))
    gained, areas = V.gains(ranked, tested, h, w), V.areas(tested)
    covered = cut(V.coverage(gained, areas))
    return {"ranked": ranked, "curve": V.curve(gained, areas, run.top_k), "coverage": covered, "hits": V.first_hits(covered, run.min_cover)}


def compared(spark: SparkSession, folders: list[str], base: str | None = None) -> dict[str, DataFrame]:
    """Stored results of several runs side by side: all summaries with the settings of their folders, each footprint's best
    case, bands of the curves over the cases of a method, and gains over a base method."""
    from ..functions.names import parse_case
    from ..sources.sinks import read_results
    from . import compare as C

    tagged = lambda name: read_results(spark, [f"{f}/*/*/*/*/{name}" for f in folders]).withColumn("case", parse_case(F.col("source")))
    settings = ["case.dep_id", "case.method", F.array_join(F.transform("case.ks", lambda k: k.cast("string")), "-").alias("k")]
    summary = cut(tagged("summary").select(*settings, "auc", "end_fraction", "n_hits"))
    curves = tagged("curve").select(*settings, "rank", "mean_fraction")
    out = {"summary": summary, "best": C.best(summary, ["dep_id", "method"], "auc", "k"), "bands": C.bands(curves, "mean_fraction", ["method"])}
    if base is not None:
        out["gains"] = C.gains(summary.groupBy(F.col("method").alias("grp"), "dep_id").agg(F.max("auc").alias("score")), base)
    return out


def reference_vectors(cases: DataFrame, method: str = "raw", analysis: str | None = None, variable: str | None = None) -> DataFrame:
    """(dep_ref, x, shape, source): each reference's vector, from the first of five sources in which any case has one.

    cases has the columns of REFERENCES and place, the order of cases. Sources are the cases of the method, analysis and
    variable; of method and analysis; of the analysis; of the method; and all. Of a source, the first case of a reference
    with a vector and a shape counts. Multivariate cases give the joint vector first, others the raw one. Raises where
    there is no vector at all.
    """
    name = lambda c: F.when(F.upper(F.trim(c)) == "MTI", "TMI").otherwise(F.trim(c))
    by_method, every = F.col("method") == method, F.lit(True)
    by_analysis = every if analysis is None else F.col("analysis") == analysis
    by_variable = every if variable is None else name(F.col("variable")) == name(F.lit(variable))
    sources = {"preferred": by_method & by_analysis & by_variable, "method and analysis": by_method & by_analysis, "analysis": by_analysis, "method": by_method, "all": every}
    x = F.when(F.col("analysis") == "multivariate", F.coalesce("joint", "vector", "raw_vector")).otherwise(F.coalesce("raw_vector", "vector", "joint"))
    whole = cut(cases.withColumn("x", x).withColumn("shape", F.coalesce("shape", "raw_shape")).where("x is not null and shape is not null"))
    for source, condition in sources.items():
        mine = whole.where(condition)
        if not mine.isEmpty():
            first = mine.groupBy("dep_ref").agg(F.min_by(F.struct("x", "shape"), "place").alias("v"))
            return first.select("dep_ref", "v.x", "v.shape", F.lit(source).alias("source"))
    raise ValueError("no case has a reference vector")
