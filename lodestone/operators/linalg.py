"""Standardisation and principal components from partial Gram matrices.

One pass over the vectors returns row count, sums and the Gram matrix of shifted rows. Partial Grams are added by row
on the executors, so the driver receives p rows of p numbers whatever the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DEGENERATE_GAP = 1e-4


def matrix(column) -> np.ndarray:
    """Rows of equal length from an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass(frozen=True)
class Moments:
    """Row count, column means and the centred Gram matrix."""

    n: int
    mean: np.ndarray
    gram: np.ndarray

    def with_row(self, x: np.ndarray) -> Moments:
        """The moments with one more row: the Gram matrix grows by a product of the row's distance from the mean."""
        off = x - self.mean
        return Moments(self.n + 1, self.mean + off / (self.n + 1), self.gram + np.outer(off, off) * (self.n / (self.n + 1)))

    def sd(self, ddof: int = 1) -> np.ndarray:
        """Column deviations; a constant column counts as 1."""
        s = np.sqrt(np.maximum(np.diag(self.gram), 0) / max(self.n - ddof, 1))
        return np.where(s <= 1e-12 * np.maximum(1, np.abs(self.mean)), 1.0, s)


def moments(df: DataFrame, x: str = "x", tasks: int = 64) -> Moments:
    """Moments of an array column. Rows are shifted by a first row, against cancellation. Raises if a value is missing.

    Every input partition gives one partial matrix, in as many tasks as there are partitions. They are added by row in two
    levels, by about `tasks` parts of the partitions first, so that no task adds all of them.
    """
    shift = df.select(x).first()
    if shift is None:
        raise ValueError("no rows to measure")
    shift = np.array(shift[0], dtype=np.float64)
    p = len(shift)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for b in batches:
            if b.num_rows:
                rows = matrix(b.column(0))
                if not np.isfinite(rows).all():
                    raise ValueError(f"{int((~np.isfinite(rows)).sum())} values are missing or not finite")
                rows = np.column_stack([rows - shift, np.ones(len(rows))])
                total += rows.T @ rows
        part = np.full(p + 1, TaskContext.get().partitionId() % tasks, dtype=np.int32)
        if total[p, p]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p + 1, dtype=np.int32)), pa.array(part), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "part", "g"])

    def add(key, table):
        rows = matrix(table.column("g"))
        rows = rows[np.lexsort(rows.T[::-1])]  # a fixed order of summation
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "g": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    schema = "i int, part int, g array<double>"
    parts = df.select(x).mapInArrow(partial, schema).groupBy("i", "part").applyInArrow(add, schema)
    full = np.array([r.g for r in sorted(parts.groupBy("i").applyInArrow(add, schema).collect(), key=lambda r: r.i)])
    n, sums = int(round(full[p, p])), full[p, :p]
    return Moments(n, sums / n + shift, full[:p, :p] - np.outer(sums, sums) / n)


@dataclass(frozen=True)
class Components:
    """Standardisation and components; loadings has a row for each component."""

    n: int
    mean: np.ndarray
    sd: np.ndarray
    loadings: np.ndarray
    eigvals: np.ndarray

    @property
    def ratio(self) -> np.ndarray:
        return self.eigvals / self.eigvals.sum() if self.eigvals.sum() > 0 else self.eigvals

    def gaps(self) -> np.ndarray:
        """Relative distance of each eigenvalue to the next; below DEGENERATE_GAP a cut there is arbitrary."""
        following = np.append(self.eigvals[1:], 0.0)
        return (self.eigvals - following) / np.maximum(self.eigvals, 1e-300)

    def scores(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        return ((x - self.mean) / self.sd) @ self.loadings[:k].T

    def rebuild(self, z: np.ndarray, k: int) -> np.ndarray:
        """Vectors from their first k scores."""
        return (z[..., :k] @ self.loadings[:k]) * self.sd + self.mean


def fit(df: DataFrame, x: str = "x", ddof: int = 1, standardize: bool = True) -> Components:
    """Principal components of standardised columns; as many as the smaller of rows and columns."""
    return components_of(moments(df, x), ddof, standardize)


def components_of(m: Moments, ddof: int = 1, standardize: bool = True) -> Components:
    """The same from moments."""
    sd = m.sd(ddof) if standardize else np.ones(len(m.mean))
    values, vectors = np.linalg.eigh(m.gram / np.outer(sd, sd) / max(m.n - ddof, 1))
    order = np.argsort(-values, kind="stable")[: min(m.n, len(m.mean))]
    loadings = vectors[:, order].T
    lead = np.abs(loadings).argmax(axis=1)
    loadings = loadings * np.sign(loadings[np.arange(len(loadings)), lead])[:, None]
    return Components(m.n, m.mean, sd, loadings, np.maximum(values[order], 0))


def scores(model: Components, x: str = "x", k: int | None = None) -> Column:
    """Column of the first k scores."""

    @pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(list(model.scores(np.array(rows.tolist(), dtype=np.float64), k))) if len(rows) else pd.Series([], dtype=object)

    return of(F.col(x))


def standardized(df: DataFrame, x: str = "x", ddof: int = 1, tasks: int = 64) -> DataFrame:
    """df with x standardised by column."""
    m = moments(df, x, tasks)
    mean, sd = m.mean, m.sd(ddof)

    @pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(list((np.array(rows.tolist(), dtype=np.float64) - mean) / sd)) if len(rows) else pd.Series([], dtype=object)

    return df.withColumn(x, of(F.col(x)))


def column_moments(df: DataFrame, x: str = "x") -> DataFrame:
    """j, mean, and deviations with ddof 1 and 0 by column; only DataFrame functions."""
    long = df.select(F.posexplode(x).alias("j", "v"))
    one = lambda s: F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)
    return long.groupBy("j").agg(F.avg("v").alias("mean"), one(F.stddev_samp("v")).alias("sd_samp"), one(F.stddev_pop("v")).alias("sd_pop"))


def variables_in(features: int, size: int) -> int:
    """How many variables of size features a vector holds; raises where it holds no whole number of them."""
    if size < 1 or features < size or features % size:
        raise ValueError(f"{features} features are no whole number of variables with {size} each")
    return features // size


def components_to_show(k: int, most: int, extra: int = 0, per_row: int = 5) -> int:
    """k and some extra components, filled up to whole rows of a picture, but not more than there are."""
    return min(most, -(-(k + extra) // per_row) * per_row)
