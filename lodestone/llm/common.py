"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ordering import cut, ensure_checkpoint_dir, free_name

#: Unicode White_Space, as the tokenizer patterns mean it (fixed values of the Unicode standard).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; callers may pass another path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_mod(column, modulus: int):
    """crc32 of the id as text, modulo: the fold that the contracts fix."""
    return F.crc32(column.cast("string")) % F.lit(modulus)


def smallest_hashes(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The n rows whose ids hash lowest: a bounded sample that doesn't depend on order or partitions."""
    return df.orderBy(F.xxhash64(id_col), id_col).limit(n)


#: Labels whose shares are sent to all tasks; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def bounded_sample(rows: DataFrame, per_label: int) -> DataFrame:
    """About the per_label rows (id, text, label) of lowest hash of each label, per_label at most; no label is left out.

    Rows with one id and label count as one, with the smallest of their texts. A label's number of ids is estimated first,
    so that only hashes below one and a half times the wanted share are ranked: no task ranks all rows of a common label.
    """
    hashed = rows.withColumn("hash", F.xxhash64("id", "label"))
    ids = cut(hashed.groupBy("label").agg(F.approx_count_distinct("hash").alias("ids")))
    limit = (2.0 * (1.5 * per_label + 64) / F.greatest(F.col("ids"), F.lit(1)) - 1.0) * float(1 << 63)
    limits = ids.select("label", limit.alias("limit"))
    low = hashed.join(F.broadcast(limits) if ids.count() <= BROADCAST_LABELS else limits, "label").where(F.col("hash").cast("double") <= F.col("limit"))
    # Few rows: texts go along, so that the table is read once more and no row is joined back.
    low = low.groupBy("label", "hash").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("hash"))
    return low.withColumn("k", rank).where(F.col("k") <= per_label).drop("k")


def number_in_groups(df: DataFrame, groups: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """df with a gapless number from 0 in each group, in the given order; no task needs to hold a whole group.

    Rows are ranged by group and order over many partitions and numbered in each; a partition's first number is the sum
    of the group's row counts in the partitions before it. Rows equal in all of these columns get numbers next to each
    other. Columns of df keep their names and values, whatever they are called; name itself is the number.
    """
    row, part, n, first_row = (free_name(df, c) for c in ("row of rows", "part of rows", "rows", "first"))
    rows = df.withColumn(row, F.monotonically_increasing_id())
    order = [*order, row]
    spread = rows.repartitionByRange(partitions, *groups, *order) if partitions else rows.repartitionByRange(*groups, *order)
    placed = cut(spread.withColumn(part, F.spark_partition_id()))
    keys = [*groups, part]
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first_row))
    numbered = placed.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).join(first, keys)
    return numbered.withColumn(name, (F.col(first_row) + F.col(name) - 1).cast("long")).drop(first_row, row, part)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name beside the checkpoints, where driver and executors all see it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_HELD: dict = {}


def release() -> None:
    """Drop what another operator left in this reused Python worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as far as the allocators can: an idle worker shouldn't keep a task's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another libc: the memory stays with the process
        pass


def held(key, build):
    """A worker's one large object, kept between its tasks until an operator needs another."""
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]
