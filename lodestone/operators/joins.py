"""Range joins of boxes and look-ups between sorted values, as equi joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .ordering import cut, number


def overlapping(a: DataFrame, b: DataFrame, tile: float, x: tuple[str, str] = ("x0", "x1"), y: tuple[str, str] = ("y0", "y1")) -> DataFrame:
    """All pairs of boxes of a and b that share some area. Both are dealt to square tiles and joined by tile; a pair is
    kept only in the tile that holds the lower corner of what it shares, so none comes twice. Columns of a get the
    prefix a_, those of b b_, and ax0.. hold the shared box as x0, x1, y0, y1."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        df = df.select([F.col(c).alias(p + c) for c in df.columns])
        span = lambda lo, hi: F.sequence(F.floor(F.col(p + lo) / tile), F.floor(F.col(p + hi) / tile))
        return df.withColumn("tx", F.explode(span(*x))).withColumn("ty", F.explode(span(*y)))

    both = dealt(a, "a_").join(dealt(b, "b_"), ["tx", "ty"])
    lo = lambda c: F.greatest("a_" + c, "b_" + c)
    hi = lambda c: F.least("a_" + c, "b_" + c)
    both = both.select("*", lo(x[0]).alias("x0"), hi(x[1]).alias("x1"), lo(y[0]).alias("y0"), hi(y[1]).alias("y1")).where("x0 < x1 and y0 < y1")
    return both.where((F.floor(F.col("x0") / tile) == F.col("tx")) & (F.floor(F.col("y0") / tile) == F.col("ty"))).drop("tx", "ty")


#: Points of a curve that are sent to all tasks; a longer curve is joined piece by piece.
CURVE_POINTS = 1_000_000


def interpolate(values: DataFrame, curve: DataFrame, at: str, x: str, y: str, name: str, most: int = CURVE_POINTS) -> DataFrame:
    """values with the curve's y at column `at`, linear between points and constant beyond the ends; null for null and NaN.

    Points of equal x count as one, with the mean y. The points are counted; up to `most` they go to every task, a longer
    curve is cut into pieces of as many points and each value meets one piece. Values are never brought together.
    """
    points = cut(curve.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("at x")).agg(F.avg(y).alias("at y")))
    n = points.count()

    def look_up(xs: np.ndarray, ys: np.ndarray, v: np.ndarray) -> np.ndarray:
        order = np.argsort(xs)
        return np.where(np.isnan(v), np.nan, np.interp(v, xs[order], ys[order]))

    place = F.col(at).cast("double")
    if not n:
        return values.withColumn(name, F.lit(None).cast("double"))
    if n <= most:
        known = points.toPandas().to_numpy(np.float64)

        @pandas_udf("double")
        def of(v: pd.Series) -> pd.Series:
            return pd.Series(look_up(known[:, 0], known[:, 1], v.to_numpy(np.float64)))

        got = of(place)
        return values.withColumn(name, F.when(~F.isnan(got), got))
    ranked = number(points, [], ["at x"], "k").withColumn("piece", F.floor((F.col("k") - 1) / most))
    # The first point of a piece also ends the one before, so that a value between two pieces has both its neighbours.
    both = ranked.withColumn("piece", F.explode(F.when((F.col("k") - 1) % most == 0, F.array(F.col("piece") - 1, F.col("piece"))).otherwise(F.array("piece")))).where("piece >= 0")
    starts = sorted((r["at x"], r.piece) for r in ranked.where((F.col("k") - 1) % most == 0).select("at x", "piece").collect())  # one number a piece
    bounds = F.array(*[F.lit(s) for s, _ in starts[1:]])
    dealt = values.withColumn("at x", place).withColumn("piece", F.size(F.filter(bounds, lambda b: b <= F.coalesce(F.col("at x"), F.lit(0.0)))).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields) + f", `{name}` double"

    def meet(v: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        got = look_up(p["at x"].to_numpy(), p["at y"].to_numpy(), v["at x"].to_numpy(np.float64)) if len(p) else np.full(len(v), np.nan)
        return v.drop(columns=["at x", "piece"]).assign(**{name: got})

    out = dealt.groupBy("piece").cogroup(both.select("piece", "at x", "at y").groupBy("piece")).applyInPandas(meet, schema)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))
