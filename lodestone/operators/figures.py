"""The tables that figures plot. Signs of components are arbitrary, so tables of scores and loadings are for pictures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import Components, scores
from .ordering import quantiles
from .ranking import reference


def score_map(frame: DataFrame, model: Components, x: str = "x", k: int | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(window_id, score) of the component on which the reference stands out most, or of component k (from 1), and the
    limits: the reference's score plus and minus the population deviation."""
    (ref,) = reference(frame, x)
    z = model.scores(ref)
    at = int(np.abs(z).argmax()) if k is None else k - 1
    out = frame.where("not is_ref").select("window_id", F.get(scores(model, x), F.lit(at)).alias("score"))
    sd = float(np.sqrt(model.eigvals[at]))
    return out, {"pc": at + 1, "low": float(z[at]) - sd, "high": float(z[at]) + sd}


def score_pairs(frame: DataFrame, model: Components, pairs: list[tuple[int, int]], top_ids: DataFrame, x: str = "x") -> DataFrame:
    """(window_id, pc_a, pc_b, z_a, z_b, is_top, is_ref) for pairs of components (from 1); top_ids has window_id."""
    s = frame.select("window_id", "is_ref", scores(model, x).alias("z")).join(top_ids.select("window_id", F.lit(True).alias("is_top")), "window_id", "left")
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])).alias("p")
    s = s.select("window_id", "is_ref", F.coalesce("is_top", F.lit(False)).alias("is_top"), "z", at)
    return s.select("window_id", F.col("p.a").alias("pc_a"), F.col("p.b").alias("pc_b"), F.get("z", F.col("p.a") - 1).alias("z_a"), F.get("z", F.col("p.b") - 1).alias("z_b"), "is_top", "is_ref")


def highlights(ranked: DataFrame, n: int, reference_id: int | None = None) -> DataFrame:
    """The first n windows of a ranking (window_id, rank), the reference's own left out."""
    rows = ranked if reference_id is None else ranked.where(F.col("window_id") != reference_id)
    return rows.select("window_id", "rank").orderBy("rank").limit(max(0, n))


def loadings(spark, model: Components, w: int, keep: np.ndarray | None = None) -> DataFrame:
    """(pc, row, col, loading); keep is the mask of features in the patch, all by default."""
    p = model.loadings.shape[1]
    places = np.arange(p) if keep is None else np.flatnonzero(np.asarray(keep).ravel())
    rows = [(k + 1, int(j // w), int(j % w), float(v)) for k, line in enumerate(model.loadings) for j, v in zip(places, line)]
    return spark.createDataFrame(rows, "pc int, row int, col int, loading double")


def chips(frame: DataFrame, ids: DataFrame, w: int, x: str = "x") -> DataFrame:
    """(window_id, row, col, v): the patches of chosen windows."""
    some = frame.join(ids.select("window_id"), "window_id", "left_semi").select("window_id", F.posexplode(x).alias("j", "v"))
    return some.select("window_id", F.floor(F.col("j") / w).cast("int").alias("row"), (F.col("j") % w).cast("int").alias("col"), "v")


def decimated(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column, for surfaces."""
    return cells.where((F.col("r") % step == 0) & (F.col("c") % step == 0))


def display_limits(cells: DataFrame, value: str = "v", share: float = 0.98, step: float = 50.0) -> DataFrame:
    """One row (low, high): the share's percentile of the absolute value, rounded up to a multiple of step."""
    at = F.lit(quantiles(cells.select(F.abs(value).alias("v")), ["v"], share)[0]).cast("double")
    return cells.sparkSession.range(1).select((F.ceil(at / step) * step).cast("double").alias("high")).select((-F.col("high")).alias("low"), "high")


def two_stage_rebuild(first: list[Components], ks: list[int], second: Components, z: np.ndarray, k: int) -> list[np.ndarray]:
    """Patches of each variable from the first k scores of a second analysis over the variables' scores."""
    joint, out, at = second.rebuild(z, k), [], 0
    for model, n in zip(first, ks):
        out.append(model.rebuild(joint[..., at : at + n], n))
        at += n
    return out
