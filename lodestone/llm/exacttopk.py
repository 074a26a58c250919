"""Exact top-k inner products by the three-phase uniform threshold.

A vector's components are dealt to lists, which lie in different tasks: none of them knows a whole score. Phase one gathers
the best entries of every list for each query; the exact scores of these rows give a score that k rows reach. A row that
stays below the list count's share of it in every list can't reach it, so this share is a safe cutoff, and phase two
collects the entries above it from every list. What has been seen of a row, and the cutoff where nothing was, bound its
score; phase three computes the scores of the rows whose bound still reaches the k-th exact one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Entries of a table of rows by queries that is made at a time.
TABLE = 1 << 21
LOWEST = -(1 << 63)


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Distinct id and x, the floored components, of rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(finite, F.lit(False)), x).alias("v")).where("id is not null and v is not null")
    square = F.aggregate("v", F.lit(0.0), lambda a, v: a + F.floor(scale * v).cast("double") * F.floor(scale * v).cast("double"))
    return rows.where(square < 9.2e18).select("id", F.transform("v", lambda v: F.floor(scale * v).cast("long")).alias("x")).dropDuplicates(["id", "x"])


def matrix(column) -> np.ndarray:
    """Rows of equal length from an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows and queries; in doubles where every sum is below 2^53."""
    if not x.size or not q.size:
        return np.zeros((len(x), len(q)), dtype=np.int64)
    if float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < 2.0**53:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return x @ q.T


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, lists: int = 2, depth: int = 64, query_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query, a row whose id is divisible by every, with all other rows.

    Columns: query_id, rank (from 1), vec_id, score (long): the inner product of floor(scale * component). Equal scores go to
    the smaller id. A query has fewer than k rows only where there are fewer candidates.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id, nor vectors whose
    integer square is 2^63 or more, as a long doesn't hold their scores. Vectors of another length have no inner product
    with a query: each length is searched for itself (that of empty ones is 0). Rows equal in id and vector count once; an
    id with several vectors is several rows, each asked and found for itself, but an id is no candidate for itself. Of equal
    vectors only the k + 1 with the smallest ids can be among the highest, so a group of copies is reduced to these first.
    An empty table gives an empty result. Other columns are not read.

    Queries are taken in blocks of about query_rows, whose vectors are sent to all tasks; rows are never sent. depth: entries
    of a list and query whose exact scores set the cutoff; more lower the number of entries above it.
    """
    rows = cut(whole_numbers(vectors, scale, id_col, vector_col))
    spark, out = rows.sparkSession, None
    for length in sorted(r.n for r in rows.groupBy(F.size("x").alias("n")).count().collect()):
        some = rows.where(F.size("x") == length)
        got = of_length(some if length else some.withColumn("x", F.array(F.lit(0).cast("long"))), max(length, 1), every, k, min(lists, max(length, 1)), max(k, depth), query_rows)
        out = got if out is None or got is None else out.unionAll(got)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def of_length(rows: DataFrame, length: int, every: int, k: int, lists: int, depth: int, query_rows: int) -> DataFrame | None:
    """search() among rows whose vectors have one length; None without queries."""
    spark = rows.sparkSession
    queries = rows.where(F.col("id") % every == 0)
    blocks = -(-queries.count() // query_rows)
    copies = Window.partitionBy("x").orderBy("id")
    base = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    base = cut(base.withColumn("rid", F.monotonically_increasing_id()))
    # Each list in tasks of its own, about four million numbers in one.
    edges = [length * i // lists for i in range(lists + 1)]
    each = max(spark.sparkContext.defaultParallelism // lists, -(-base.count() * length // (lists << 22)), 1)
    parts = F.array(*[F.slice("x", a + 1, b - a) for a, b in zip(edges, edges[1:])])
    filed = cut(base.select("rid", "id", F.posexplode(parts).alias("list", "part")).repartition(lists * each, "list", F.pmod(F.xxhash64("rid"), F.lit(each))))
    queries = cut(queries.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(max(blocks, 1)))))
    out = None
    for b in range(blocks):
        asked = queries.where(F.col("block") == b).select("id", "x").toArrow()  # about query_rows rows
        if asked.num_rows:
            got = of_block(base, filed, asked, edges, k, depth)
            got = cut(got) if blocks > 1 else got
            out = got if out is None else out.unionAll(got)
    return out


def of_block(base: DataFrame, filed: DataFrame, asked: pa.Table, edges: list[int], k: int, depth: int) -> DataFrame:
    """search() for one block of queries."""
    spark, lists = base.sparkSession, len(edges) - 1
    sent = spark.sparkContext.broadcast((asked.column("id").to_numpy(), matrix(asked.column("x"))))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """List, row keys, ids and a list's scores (rows x queries), some rows at a time; a query's own row has the lowest."""
        ids, q = sent.value
        for whole in batches:
            for one in np.unique(whole.column(2).to_numpy()).tolist():
                b = whole.filter(pa.array(whole.column(2).to_numpy() == one))
                x, rid, own, some = matrix(b.column(3)), b.column(0).to_numpy(), b.column(1).to_numpy(), q[:, edges[one] : edges[one + 1]]
                step = max(1, TABLE // len(q))
                for lo in range(0, len(x), step):
                    part = slice(lo, lo + step)
                    table = products(x[part], some)
                    for i in np.flatnonzero(np.isin(own[part], ids)).tolist():
                        table[i, ids == own[part][i]] = LOWEST
                    yield one, rid[part], own[part], table

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase one: a task's k best entries of each list and query."""
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for one, rid, _, table in tables(batches):
            rids = np.broadcast_to(rid[:, None], table.shape)
            if one in best:
                table, rids = np.vstack([best[one][0], table]), np.vstack([best[one][1], rids])
            if len(table) > k:
                head = np.argpartition(table, len(table) - k, axis=0)[len(table) - k :]
                table, rids = np.take_along_axis(table, head, axis=0), np.take_along_axis(rids, head, axis=0)
            best[one] = table, rids
        for one, (table, rids) in best.items():
            at = np.flatnonzero(table.ravel() > LOWEST)
            q = np.broadcast_to(np.arange(table.shape[1], dtype=np.int32), table.shape).ravel()[at]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(at), one, dtype=np.int32)), pa.array(rids.ravel()[at]), pa.array(table.ravel()[at])], names=["q", "list", "rid", "part"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for b in batches:
            if b.num_rows:
                at = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.einsum("ij,ij->i", matrix(b.column(2)), q[at]))], names=["q", "id", "score"])

    def resolved(pairs: DataFrame) -> DataFrame:
        return pairs.join(base, "rid").select("q", "id", "x").mapInArrow(exact, "q int, id long, score long")

    def floors(scores: DataFrame) -> DataFrame:
        """The k-th best of each query's exact scores, where there are k."""
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        return scores.withColumn("place", place).where(F.col("place") <= k).groupBy("q").agg(F.count("score").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select("q", "floor")

    found = filed.mapInArrow(gathered, "q int, list int, rid long, part long")
    place = F.row_number().over(Window.partitionBy("q", "list").orderBy(F.desc("part"), "rid"))
    heads = found.withColumn("place", place).where(F.col("place") <= depth).select("q", "rid").distinct()
    floor = np.full(asked.num_rows, LOWEST, dtype=np.int64)
    for r in floors(resolved(F.broadcast(heads))).collect():  # a row a query of the block; heads are query_rows x lists x depth at most
        floor[r.q] = r.floor
    cutoff = np.where(floor > LOWEST, -(-floor // lists), LOWEST)
    limits = spark.sparkContext.broadcast(cutoff)

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase two: a task's entries that reach the cutoff."""
        for one, rid, own, table in tables(batches):
            i, q = np.nonzero((table >= limits.value[None, :]) & (table > LOWEST))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(rid[i]), pa.array(own[i]), pa.array(table[i, q])], names=["q", "rid", "id", "part"])

    entries = filed.mapInArrow(collected, "q int, rid long, id long, part long")
    seen = cut(entries.groupBy("q", "rid", "id").agg(F.sum("part").alias("score"), F.count("part").cast("int").alias("lists")))
    whole = seen.where(F.col("lists") == lists).select("q", "id", "score")
    cuts = spark.createDataFrame(pa.table({"q": np.arange(len(cutoff), dtype=np.int32), "cutoff": cutoff, "known": floor}).to_pandas(), "q int, cutoff long, known long")
    cuts = cuts.join(floors(whole), "q", "left").select("q", "cutoff", F.greatest("known", F.coalesce("floor", F.lit(LOWEST))).alias("floor"))
    # Unseen parts are below the cutoff; where it is the lowest there are no other parts.
    bound = F.when(F.col("cutoff") > LOWEST, F.col("score") + (lists - F.col("lists")) * (F.col("cutoff") - 1))
    open_pairs = seen.where(F.col("lists") < lists).join(F.broadcast(cuts), "q").where(F.coalesce(bound >= F.col("floor"), F.lit(True))).select("q", "rid")
    scores = whole.unionAll(resolved(open_pairs))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    names = spark.createDataFrame(pa.table({"q": np.arange(asked.num_rows, dtype=np.int32), "query_id": asked.column("id")}).to_pandas(), "q int, query_id long")
    return scores.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "q").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
