"""Materialisation and numbering that hold at any size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; only on a local master, where none is named, take a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))


def shared_place(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop's rounds in the shared folder; a table goes when the one after its next is written.

    A checkpoint remembers how large the planner guessed its rows to be, and the guess for a join is the product of both
    sides: over the rounds of a loop its digits double until planning takes longer than the work. A table that is read back
    has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_place(self.spark, "round")
        df.write.parquet(path)
        self.kept.append(path)
        if len(self.kept) > 2:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.kept.pop(0))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def number(df: DataFrame, groups: list[str], order: list, name: str) -> DataFrame:
    """df with a gapless number from 1 in each group (in all rows, without groups), in the given order.

    order holds columns or names and should end in a unique one. Rows are ranged over many partitions and numbered in
    each; a partition's first number is the sum of row counts before it, so no task holds a whole group.
    """
    keyed = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(f"order {k}") for k, o in enumerate(order)])
    sort = [f"order {k}" for k in range(len(order))]
    placed = cut(keyed.repartitionByRange(*groups, *sort).withColumn("part of rows", F.spark_partition_id()))
    keys = [*groups, "part of rows"]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    before = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("part of rows").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    numbered = placed.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))).join(first, keys)
    return numbered.withColumn(name, (F.col("first") + F.col(name)).cast("long")).drop("first", "part of rows", *sort)


def top(df: DataFrame, k: int, order: list, name: str = "rank") -> DataFrame:
    """The first k rows (1 at least) with their number from 1: a bounded top-k, then a number on k rows only."""
    few = df.orderBy(*order).limit(max(1, k))
    return few.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per_group(df: DataFrame, groups: list[str], k: int, order: list, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their number from 1; partial limits run before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(name, place.cast("long")).where(F.col(name) <= k)


#: Rows up to which exact quantiles are taken in one aggregation, values that come to the driver, and classes of a pass.
FEW, CLOSE, CLASSES = 1_000_000, 10_000, 1024


def quantiles(df: DataFrame, columns: list[str], share: float = 0.5) -> list[float | None]:
    """Exact quantile of each column over its non-null rows, between neighbouring values; null where there is none.

    Of many rows no task holds all: each pass counts the values of all columns in CLASSES classes between two bounds, and the
    bounds close in on the class that holds the place, until few values are left there. A pass returns CLASSES rows a column.
    """
    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = wide.columns
    counts = wide.agg(*[F.count(c).alias(c) for c in names]).first()
    if max(counts) <= FEW:
        return list(wide.agg(*[F.percentile(c, F.lit(share)).alias(c) for c in names]).first())
    ends = wide.agg(*[f(c).alias(f"{k} {c}") for c in names for k, f in (("min", F.min), ("max", F.max))]).first()
    bounds = {c: (ends[f"min {c}"], ends[f"max {c}"], 0, counts[c]) for c in names if counts[c]}
    place = {c: int(share * (counts[c] - 1)) for c in bounds}  # from 0
    found: dict[str, tuple[float, float]] = {}
    while bounds:
        for c, (low, high, before, n) in list(bounds.items()):
            if low == high:
                found[c] = (low, low)
            elif n <= CLOSE:
                near = sorted(r[0] for r in wide.where(F.col(c).between(low, high)).select(c).collect())
                at = place[c] - before
                found[c] = (near[at], near[min(at + 1, n - 1)])
            else:
                continue
            del bounds[c]
        if not bounds:
            break
        pieces = [F.when(F.col(c).between(low, high), F.struct(F.lit(c).alias("c"), F.col(c).alias("v"), F.least(F.lit(CLASSES - 1), F.floor((F.col(c) - low) / (high - low) * CLASSES)).alias("k"))) for c, (low, high, _, _) in bounds.items()]
        seen: dict[str, list] = {c: [] for c in bounds}
        for r in wide.select(F.explode(F.array_compact(F.array(*pieces))).alias("p")).groupBy("p.c", "p.k").agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("low"), F.max("p.v").alias("high")).collect():
            seen[r.c].append(r)
        for c, (_, _, before, _) in list(bounds.items()):
            classes = sorted(seen[c], key=lambda r: r.k)
            for i, r in enumerate(classes):
                if before + r.n > place[c]:
                    if before + r.n == place[c] + 1 and i + 1 < len(classes):  # the place is its class's last value
                        found[c] = (r.high, classes[i + 1].low)
                        del bounds[c]
                    else:
                        bounds[c] = (r.low, r.high, before, r.n)
                    break
                before += r.n
    part = {c: share * (counts[c] - 1) - place[c] for c in place}
    return [None if c not in found else found[c][0] + part[c] * (found[c][1] - found[c][0]) for c in names]
