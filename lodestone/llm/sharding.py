"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots.

Each shard gives a record's key a hash-based score, -ln(u) / weight; the smallest wins. A key's scores don't depend on
the other shards, so a further shard takes records only into itself, and no others move. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_in_groups


def uniform(key: Column, shard: Column) -> Column:
    """A number between 0 and 1 (both excluded) from a key and a shard."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit("rendezvous"), key, shard), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Struct (score, shard) of the winning shard; equal scores go to the smaller number, weight 0 takes nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    array = F.array(*[F.lit(float(w)) for w in weights])
    open_shards = F.array(*[F.lit(i) for i, w in enumerate(weights) if w > 0])
    return F.array_min(F.transform(open_shards, lambda i: F.struct((-F.log(uniform(key, i)) / F.get(array, i)).alias("score"), i.alias("shard"))))


def shard(docs: DataFrame, weights: list[float] | int = 24, new_weight: float | None = None, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put each row into a shard by its key and give it a slot there; one row per row of docs.

    Columns: the id, size (UTF-8 bytes of the text plus 8), text_crc32, law ("key"), shard, slot (gapless from 0 in each
    shard, by id, text_crc32 and size), grown_shard (with one more shard of new_weight, by default the mean weight). A
    null text has no bytes. The key is the id alone: rows of one id, null ids too, share a shard, also where that makes
    the shard large. Groups of equal texts are not kept together: equal texts of different ids need not meet. Equal rows get slots next to each other. Other columns are not read.

    Slots need no task to hold a whole shard: rows are ranged by shard and id over many partitions, numbered in each, and
    each partition's first slot is the sum of the shard's row counts before it.
    """
    weights = [1.0] * weights if isinstance(weights, int) else list(map(float, weights))
    new_weight = sum(weights) / len(weights) if new_weight is None else float(new_weight)
    key, n = F.col("key"), len(weights)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("won", rendezvous(key, weights))
    extra = -F.log(uniform(key, F.lit(n))) / new_weight if new_weight > 0 else F.lit(None).cast("double")
    rows = rows.select("key", "size", "text_crc32", F.col("won.shard").alias("shard"), F.when(extra < F.col("won.score"), n).otherwise(F.col("won.shard")).alias("grown_shard"))
    placed = number_in_groups(rows, ["shard"], ["key", "text_crc32", "size"], "slot", partitions)
    return placed.select(F.col("key").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
