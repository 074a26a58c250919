"""Streams of events scored against a frozen model (an addition of this engine)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import Block


def window_counts(events: DataFrame, kinds: list[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, x): counts of each kind of event by time window, in the order of kinds; late events within the watermark."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"))
    counts = w.agg(*[F.sum((F.col("event_type") == k).cast("double")).alias(f"n{i}") for i, k in enumerate(kinds)])
    return counts.select(F.col("w.start").alias("start"), F.array(*[f"n{i}" for i in range(len(kinds))]).alias("x"))


def score(rows: DataFrame, frozen: Block, x: str = "x") -> DataFrame:
    """rows with dist, the distance to the model's reference: a stateless map, so it works on batches and streams."""

    @F.pandas_udf("double")
    def of(v: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(frozen.squared(np.array(v.tolist(), dtype=np.float64))) if len(v) else [], dtype="float64")

    return rows.withColumn("dist", of(F.col(x)))
