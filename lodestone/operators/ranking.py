"""Similarity ranking of windows against a reference row, in raw or component space, for one or more variables.

Windows come as (window_id, is_ref, x...) with one reference row; results are (window_id, dist), the reference left out.
Ties go to the smaller window id wherever rows are numbered.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .linalg import Components, components_of, fit, matrix, moments
from .ordering import cut, quantiles

WEIGHT_NAMES = {"square": "square", "squared": "square", "sq": "square", "abs": "abs", "absolute": "abs", "uniform": "uniform", "none": "uniform"}
OVER_NAMES = {"selected": "selected", "selected_pcs": "selected", "all": "all", "all_pcs": "all"}
EPS = 1e-12


def weights(z: np.ndarray, k: int, mode: str = "square", over: str = "selected") -> np.ndarray:
    """Weights of the first k components from the reference's scores; uniform where all are 0."""
    mode, over = WEIGHT_NAMES[mode.lower()], OVER_NAMES[over.lower()]
    if mode == "uniform":
        return np.ones(k)
    raw = z**2 if mode == "square" else np.abs(z)
    base = raw[:k] if over == "selected" else raw
    total = base.sum()
    return raw[:k] / total if total > 0 else np.full(k, 1 / len(base))


def reference(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """The one reference row's vectors."""
    rows = df.where("is_ref").select(*columns).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"need one reference row, found {'none' if not rows else 'more'}")
    return [np.array(v, dtype=np.float64) for v in rows[0]]


def by_vector(kernel: Callable[..., np.ndarray], *columns: str) -> Column:
    """A double column from array columns by a vectorised kernel."""

    @pandas_udf("double")
    def of(*rows: pd.Series) -> pd.Series:
        return pd.Series(kernel(*[np.array(r.tolist(), dtype=np.float64) for r in rows]) if len(rows[0]) else [], dtype="float64")

    return of(*[F.col(c) for c in columns])


def ranked(df: DataFrame, dist: Column) -> DataFrame:
    return df.where("not is_ref").select("window_id", dist.alias("dist"))


@dataclass(frozen=True)
class Block:
    """A variable's components, the reference's scores, and the weights and scales of its first k scores."""

    model: Components
    z_ref: np.ndarray
    k: int
    w: np.ndarray
    scale: np.ndarray

    def squared(self, x: np.ndarray) -> np.ndarray:
        z = self.model.scores(x, self.k)
        return (((z - self.z_ref[: self.k]) / self.scale) ** 2 * self.w).sum(axis=1)


def block(df: DataFrame, x: str = "x", k: int | None = None, mode: str = "square", over: str = "selected", whiten: bool = False, rule: str = "reference", ddof: int = 1) -> Block:
    """Fit a variable. rule: weights from the reference's scores; "whitened", from its whitened scores; "inverse", 1 /
    eigenvalue. whiten divides scores by the roots of the eigenvalues, with weights from raw scores all the same."""
    model, (ref,) = fit(df, x, ddof), reference(df, x)
    k = max(1, min(k or len(model.eigvals), len(model.eigvals)))
    z, root = model.scores(ref), np.sqrt(np.maximum(model.eigvals, EPS))
    w = {"reference": lambda: weights(z, k, mode, over), "whitened": lambda: weights(z / root, k, mode, over), "inverse": lambda: 1 / np.maximum(model.eigvals[:k], EPS)}[rule]()
    return Block(model, z, k, w, root[:k] if whiten else np.ones(k))


def rank_components(df: DataFrame, x: str = "x", squared: bool = False, **options) -> DataFrame:
    """Weighted distance in component space."""
    b = block(df, x, **options)
    d = by_vector(b.squared, x)
    return ranked(df, d if squared else F.sqrt(d))


def rank_raw(df: DataFrame, x: str = "x", standardize: bool = True, squared: bool = False) -> DataFrame:
    """Plain distance of features, standardised by column (with the reference among the rows) or not."""
    (ref,) = reference(df, x)
    sd = moments(df, x).sd(1) if standardize else np.ones(len(ref))
    d = by_vector(lambda v: (((v - ref) / sd) ** 2).sum(axis=1), x)
    return ranked(df, d if squared else F.sqrt(d))


def rank_demeaned(df: DataFrame, x: str = "x") -> DataFrame:
    """Distance of windows less their own means."""
    (ref,) = reference(df, x)
    ref = ref - ref.mean()
    return ranked(df, F.sqrt(by_vector(lambda v: ((v - v.mean(axis=1, keepdims=True) - ref) ** 2).sum(axis=1), x)))


def correlation(df: DataFrame, x: str = "x") -> Column:
    """Normalised cross-correlation with the reference; 0 for a constant window."""
    (ref,) = reference(df, x)
    ref = ref - ref.mean()
    norm = np.linalg.norm(ref)

    def of(v: np.ndarray) -> np.ndarray:
        v = v - v.mean(axis=1, keepdims=True)
        size = np.linalg.norm(v, axis=1) * norm
        return np.divide(v @ ref, size, out=np.zeros(len(v)), where=size > EPS)

    return by_vector(of, x)


def rank_correlation(df: DataFrame, x: str = "x") -> DataFrame:
    """(window_id, similarity), larger is nearer."""
    return df.where("not is_ref").select("window_id", correlation(df, x).alias("similarity"))


def rank_mix(df: DataFrame, x1: str, x2: str, alpha: float, kind: str = "correlation") -> DataFrame:
    """Two variables' baselines mixed: correlations, or demeaned distances over their population deviations."""
    if kind == "correlation":
        return df.where("not is_ref").select("window_id", (alpha * correlation(df, x1) + (1 - alpha) * correlation(df, x2)).alias("similarity"))
    a, b = rank_demeaned(df, x1), rank_demeaned(df, x2)
    sa, sb = (d.agg(F.stddev_pop("dist")).first()[0] or 1.0 for d in (a, b))
    both = a.withColumnRenamed("dist", "d1").join(b.withColumnRenamed("dist", "d2"), "window_id")
    return both.select("window_id", (alpha * F.col("d1") / sa + (1 - alpha) * F.col("d2") / sb).alias("dist"))


def squared_by_variable(df: DataFrame, columns: list[str], ks: list[int], **options) -> DataFrame:
    """(window_id, is_ref, d1, d2, ...): squared distances of each variable's own component space."""
    blocks = [block(df, x, k, **options) for x, k in zip(columns, ks)]
    return df.select("window_id", "is_ref", *[by_vector(b.squared, x).alias(f"d{i}") for i, (b, x) in enumerate(zip(blocks, columns), 1)])


def fuse_late(df: DataFrame, columns: list[str], ks: list[int], combine: str = "sum", alpha: list[float] | None = None, **options) -> DataFrame:
    """Squared distances over their medians (reference row included), added with weights or the largest of them. Where a
    median is 0, the variable's distances stay as they are: divided by next to nothing, they would decide alone."""
    d = squared_by_variable(df, columns, ks, **options)
    names = [f"d{i}" for i in range(1, len(columns) + 1)]
    med = dict(zip(names, quantiles(d, names)))
    parts = [F.col(c) / (med[c] if med[c] and med[c] > EPS else 1.0) for c in names]
    alpha = alpha or [1 / len(parts)] * len(parts)
    if combine not in ("sum", "max"):
        raise ValueError(f"unknown combination: {combine}")
    total = F.greatest(*parts) if combine == "max" else sum((a * p for a, p in zip(alpha[1:], parts[1:])), alpha[0] * parts[0])
    return ranked(d, F.sqrt(total))


def fuse_concat(df: DataFrame, columns: list[str], ks: list[int], alpha: float | list[float], **options) -> DataFrame:
    """Raw scores side by side with each variable's own weights: alpha * d1 + (1 - alpha) * d2, squared distances."""
    alpha = [alpha, 1 - alpha] if isinstance(alpha, (int, float)) else list(alpha)
    d = squared_by_variable(df, columns, ks, **options)
    return ranked(d, F.sqrt(sum((a * F.col(f"d{i}") for i, a in enumerate(alpha[1:], 2)), alpha[0] * F.col("d1"))))


def scores_side_by_side(df: DataFrame, columns: list[str], ks: list[int], ddof: int = 1) -> DataFrame:
    """(window_id, is_ref, x): the variables' first k scores in one vector."""
    models = [fit(df, x, ddof) for x in columns]

    @pandas_udf("array<double>")
    def of(*rows: pd.Series) -> pd.Series:
        parts = [m.scores(np.array(r.tolist(), dtype=np.float64), k) for m, r, k in zip(models, rows, ks)]
        return pd.Series(list(np.hstack(parts))) if len(rows[0]) else pd.Series([], dtype=object)

    return df.select("window_id", "is_ref", of(*[F.col(c) for c in columns]).alias("x"))


def fuse_concat_standardized(df: DataFrame, columns: list[str], ks: list[int], mode: str = "square", over: str = "selected") -> DataFrame:
    """Scores side by side, standardised again, with one weight vector from the joint reference row."""
    both = scores_side_by_side(df, columns, ks)
    m, (ref,) = moments(both, "x"), reference(both, "x")
    mean, sd = m.mean, m.sd(1)
    z = (ref - mean) / sd
    w = weights(z, len(z), mode, over)
    return ranked(both, F.sqrt(by_vector(lambda v: (((v - mean) / sd - z) ** 2 * w).sum(axis=1), "x")))


def cut_gap(eigvals: np.ndarray, k: int) -> float:
    """How far the k-th eigenvalue lies above the next, as a share of itself; infinite where nothing is cut off."""
    return float("inf") if k == len(eigvals) else float((eigvals[k - 1] - eigvals[k]) / max(abs(eigvals[k - 1]), EPS))


def fuse_two_stage(df: DataFrame, columns: list[str], ks: list[int], k: int | None = None, least_gap: float = 1e-4, **options) -> DataFrame:
    """Components of the variables' standardised scores, then the weighted distance of the first k of these.

    Between two eigenvalues that are nearly equal the components are any turn of one another, so a k that parts them gives a
    ranking that another run need not repeat: a RuntimeWarning tells where the gap at k is under least_gap.
    """
    squared = options.pop("squared", False)
    both = scores_side_by_side(df, columns, ks)
    b = block(both, "x", k=k, **options)
    gap = cut_gap(b.model.eigvals, b.k)
    if gap < least_gap:
        warnings.warn(f"k = {b.k} parts two components whose eigenvalues differ by a share of {gap:.2e}; take k at a wider gap", RuntimeWarning, stacklevel=2)
    d = by_vector(b.squared, "x")
    return ranked(both, d if squared else F.sqrt(d))


def fuse_joint(df: DataFrame, columns: list[str], k: int, **options) -> DataFrame:
    """Components of all variables' features in one vector."""
    return rank_components(df.select("window_id", "is_ref", F.concat(*columns).alias("x")), "x", k=k, **options)


FUSIONS: dict[str, Callable[..., DataFrame]] = {
    "late_sum": lambda df, columns, ks, **o: fuse_late(df, columns, ks, "sum", **o),
    "late_max": lambda df, columns, ks, **o: fuse_late(df, columns, ks, "max", **o),
    "concat_alpha": fuse_concat,
    "concat_standardized": fuse_concat_standardized,
    "two_stage": fuse_two_stage,
    "joint": fuse_joint,
}


def fuse(name: str, df: DataFrame, *args, **options) -> DataFrame:
    """A fusion by name; FUSIONS may be extended with functions of the same form."""
    if name not in FUSIONS:
        raise ValueError(f"unknown fusion {name!r}; known: {', '.join(sorted(FUSIONS))}")
    return FUSIONS[name](df, *args, **options)


def sweep_k(df: DataFrame, ks: list[int], x: str = "x", mode: str = "square") -> DataFrame:
    """(window_id, k, dist) for every k in one pass: numerators and denominators are running sums over components."""
    model, (ref,) = fit(df, x), reference(df, x)
    z = model.scores(ref)
    raw = z**2 if WEIGHT_NAMES[mode] == "square" else np.abs(z) if WEIGHT_NAMES[mode] == "abs" else np.ones(len(z))
    total = np.cumsum(raw)
    ks = sorted({max(1, min(k, len(z))) for k in ks})
    at = np.array(ks) - 1

    @pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        d = (model.scores(np.array(rows.tolist(), dtype=np.float64)) - z) ** 2
        some = np.where(total > 0, np.cumsum(d * raw, axis=1) / np.where(total > 0, total, 1), np.cumsum(d, axis=1) / np.arange(1, len(z) + 1))
        return pd.Series(list(np.sqrt(some[:, at])))

    names = F.array(*[F.lit(k) for k in ks])
    both = df.where("not is_ref").select("window_id", F.explode(F.arrays_zip(names.alias("k"), of(F.col(x)).alias("dist"))).alias("s"))
    return both.select("window_id", F.col("s.k").alias("k"), F.col("s.dist").alias("dist"))


def rank_references(df: DataFrame, references: dict[int, np.ndarray], ks: list[int], x: str = "x", mode: str = "square", over: str = "selected", whiten: bool = False, ddof: int = 1) -> DataFrame:
    """(window_id, ref, k, dist): distances to every reference in its own components, for every k, from windows alone.

    The windows' moments are taken once; each reference adds a row to them, and its components come from that. One scan then
    gives the scores of all references as one product of matrices, and all k as running sums. Only moments and loadings are
    sent out: features x references x the largest k numbers. Equal to rank_components with the reference among the rows.
    """
    m, blocks = moments(df, x), []
    for ref, vector in references.items():
        model = components_of(m.with_row(np.asarray(vector, dtype=np.float64)), ddof)
        most = max(1, min(max(ks), len(model.eigvals)))
        z, root = model.scores(vector), np.sqrt(np.maximum(model.eigvals, EPS))
        blocks.append((ref, model, z[:most], root[:most] if whiten else np.ones(most), {k: weights(z, min(k, most), mode, over) for k in ks}))
    sent = df.sparkSession.sparkContext.broadcast(blocks)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value
        each = [model.loadings[: len(z)] / model.sd for _, model, z, *_ in parts]
        loads, base = np.vstack(each), np.concatenate([one @ p[1].mean for one, p in zip(each, parts)])
        for b in batches:
            if not b.num_rows:
                continue
            every = matrix(b.column(1)) @ loads.T - base
            at, ids, out = 0, b.column(0).to_numpy(), []
            for ref, _, z, scale, by_k in parts:
                square = ((every[:, at : at + len(z)] - z) / scale) ** 2
                at += len(z)
                out += [(ref, k, np.sqrt(square[:, : len(w)] @ w)) for k, w in by_k.items()]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(out))), pa.array(np.repeat([o[0] for o in out], n).astype(np.int32)), pa.array(np.repeat([o[1] for o in out], n).astype(np.int32)), pa.array(np.concatenate([o[2] for o in out]))], names=["window_id", "ref", "k", "dist"])

    return df.select(F.col("window_id").cast("long"), x).mapInArrow(scored, "window_id long, ref int, k int, dist double")


def sweep_alpha(squared: DataFrame, alphas: list[float]) -> DataFrame:
    """(window_id, alpha, dist) from (window_id, d1, d2): the mixture is linear in the squared distances."""
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha")
    rows = squared.where("not is_ref") if "is_ref" in squared.columns else squared
    return rows.select("window_id", "d1", "d2", grid).select("window_id", "alpha", F.sqrt(F.col("alpha") * F.col("d1") + (1 - F.col("alpha")) * F.col("d2")).alias("dist"))


def agreement(a: DataFrame, b: DataFrame, tops: tuple[int, ...] = (20, 50, 100, 250)) -> DataFrame:
    """One row that compares ranking b with target a, both (window_id, rank): overlaps of the tops, length of the equal
    prefix, mean, median and largest rank in b of a's rows, mean reciprocal rank, mean absolute rank difference."""
    both = cut(a.select("window_id", F.col("rank").alias("ra")).join(b.select("window_id", F.col("rank").alias("rb")), "window_id"))
    first_off = F.min(F.when(F.col("ra") != F.col("rb"), F.least("ra", "rb")))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(first_off - 1, F.max("ra")).cast("long").alias("prefix"),
        *[F.sum(F.when((F.col("ra") <= t) & (F.col("rb") <= t), 1).otherwise(0)).cast("long").alias(f"overlap_{t}") for t in tops],
        F.avg("rb").alias("mean_rank"), F.lit(quantiles(both, ["rb"])[0]).cast("double").alias("median_rank"), F.max("rb").cast("long").alias("max_rank"),
        F.avg(1 / F.col("rb")).alias("mrr"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("rank_mae"),
    )
