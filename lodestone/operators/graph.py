"""Connected components of an edge table that needn't fit anywhere but on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import Rounds, cut


#: Edges that a task of a round holds, about: few edges are not spread over as many files as there are shuffle partitions.
EDGES_A_TASK = 20_000
#: Edges up to which each node's smallest neighbour is sent to all tasks (a row of two nodes for each).
BROADCAST_EDGES = 200_000
#: Of more edges a node's are dealt to several tasks: edges for each salt, and the most salts.
SALT_EDGES, MOST_SALTS = 200_000, 64


def star(edges: DataFrame, large: bool, salts: int = 0) -> DataFrame:
    """One star operation on edges (a, b), a > b. Large: each node's larger neighbours link to the smallest node around
    it. Small: the node and its smaller neighbours do. A hub's edges never meet in one task: without salts the smallest
    neighbours are broadcast, with salts they are joined to each of so many parts of a node's edges."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if salts:
        around = around.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        some = around.groupBy("u", "salt").agg(F.min("v").alias("m"))
        least = some.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(some.select("u", "salt").join(least, "u"), ["u", "salt"])
    else:
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(F.broadcast(least), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its smallest node.

    edges has columns a and b of one orderable type. Large and small stars alternate until nothing changes, which takes
    about log(n) ** 2 rounds at most; every round is materialised in the shared checkpoint folder. Loops say nothing.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    parts = 1 + n // EDGES_A_TASK
    rounds = Rounds(edges.sparkSession)
    mark, salts = None, 0 if n <= BROADCAST_EDGES else min(MOST_SALTS, 1 + n // SALT_EDGES)
    for _ in range(most_rounds):
        edges = rounds.write(star(star(edges, True, salts), False, salts).coalesce(parts))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
