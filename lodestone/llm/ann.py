"""Approximate nearest neighbours by inner product: inverted file with product-quantised residuals and exact reranking.

A bounded sample fixes coarse centroids and codebooks of the residuals. Every row is assigned to its centroid's list and
coded. A query is sent to its best lists; there a table of its inner products with all codewords gives each row's
approximate score in a few look-ups, and a shortlist is reranked with the original vectors. The sample sets how many lists
a query visits, so that they hold the wanted share of true neighbours, and how far below a wanted score an approximate
one may lie, so that dense groups, which codes hardly tell apart, are reranked whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, smallest_hashes


#: Entries of a table of rows by centroids that is made at a time.
TABLE = 1 << 22
#: Queries whose tables of codewords are held at a time.
QUERIES = 256
#: Broadcast tables have a row for each list or crowded group; beyond this many they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def light(x: np.ndarray) -> np.ndarray:
    """Single precision, where the numbers allow it; approximate scores need no more."""
    return x.astype(np.float32) if not x.size or np.abs(x).max() < 1e15 else x


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids (all rows, if fewer); empty ones take the rows farthest from theirs."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at, far = nearest(x, c)
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=k)
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far)[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row and the squared distance, up to the row's own square; some rows at a time."""
    at, far, square = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=x.dtype), (c**2).sum(axis=1)
    step = max(1, TABLE // len(c))
    for lo in range(0, len(x), step):
        d = square - 2 * (x[lo : lo + step] @ c.T)
        at[lo : lo + step] = d.argmin(axis=1)
        far[lo : lo + step] = np.take_along_axis(d, at[lo : lo + step, None], axis=1)[:, 0]
    return at, far + (x**2).sum(axis=1)


@dataclass(frozen=True)
class Index:
    """What fitting leaves: centroids, codebooks (parts x words x width), the lists a query visits, and how much an exact
    score exceeds the approximate one (margin) or stays below it (excess) at most, but for one pair in a thousand."""

    centroids: np.ndarray
    books: np.ndarray
    visits: int = 1
    margin: float = 0.0
    excess: float = 0.0

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, residual codes and scale of each row. The scale makes up for what coding takes from a row along itself."""
        at, _ = nearest(x, self.centroids)
        left = x - self.centroids[at]
        width = self.books.shape[2]
        codes = [nearest(left[:, p * width : (p + 1) * width], book)[0] for p, book in enumerate(self.books)]
        kept = self.centroids[at] + np.hstack([book[c] for book, c in zip(self.books, codes)])
        along = (x * kept).sum(axis=1) / np.maximum((x**2).sum(axis=1), 1e-30)
        return at.astype(np.int32), np.column_stack(codes).astype(np.uint8), (1 / np.clip(along, 0.5, 1.0)).astype(x.dtype)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of all codewords with each query's parts: parts x words x queries."""
        width = self.books.shape[2]
        return np.stack([book @ q[:, p * width : (p + 1) * width].T for p, book in enumerate(self.books)])

    def approximate(self, q: np.ndarray, tables: np.ndarray, at: int, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Scores of coded rows of a list (rows x queries), from the queries' tables: whole rows of them are added up."""
        near = np.repeat((self.centroids[at] @ q.T)[None, :], len(codes), axis=0)
        for p in range(codes.shape[1]):
            near += tables[p][codes[:, p]]
        near *= scale[:, None]
        return near


def matrix(column) -> np.ndarray:
    """Rows of equal length from an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x (doubles) of rows that take part: id not null, vector not null or zero, all components finite."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(F.coalesce(whole, F.lit(False)) & F.exists("x", lambda v: v != 0))


def fit(rows: DataFrame, count: int, k: int, list_rows: int = 256, max_lists: int = 16_384, parts: int = 16, words: int = 256, share: float = 0.965, seed: int = 5) -> tuple[Index, np.ndarray, np.ndarray]:
    """Index from a bounded sample (16 rows a list, 8,192 to 131,072 rows), and 8,192 rows of the sample: ids and vectors.

    The number of lists follows the row count, list_rows to a list, up to max_lists.
    """
    lists = int(np.clip(count // list_rows, 1, max_lists))
    sample = smallest_hashes(rows, min(131_072, max(8_192, 16 * lists))).toPandas()
    ids, x = sample["id"].to_numpy(), np.stack(sample.pop("x").to_numpy()).astype(np.float64)
    whole, x = x[:8_192], light(x)
    dim = x.shape[1]
    parts = max(p for p in range(1, parts + 1) if dim % p == 0)
    rng = np.random.default_rng(seed)
    centroids = k_means(x, lists, 10, rng)
    at, _ = nearest(x, centroids)
    left, width = x - centroids[at], dim // parts
    books = [k_means(left[: 1 << 15, p * width : (p + 1) * width], words, 8, rng) for p in range(parts)]
    most = max(map(len, books))
    books = np.stack([np.vstack([b, np.repeat(b[:1], most - len(b), axis=0)]) for b in books])
    probe = x[: min(256, len(x))]
    scores = probe @ x.T
    scores[np.arange(len(probe)), np.arange(len(probe))] = -np.inf
    true = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
    order = np.argsort(-(probe @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(probe), 0), axis=1)
    needed = np.sort(np.take_along_axis(place, at[true], axis=1).ravel())
    visits = int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))))]) + 1
    index = Index(centroids, books, visits)
    some = x[: 1 << 14]
    at, codes, scale = index.code(some)
    over, tables = [], index.tables(probe)
    for one in np.unique(at).tolist():
        mine = np.flatnonzero(at == one)
        over.append((some[mine] @ probe.T - index.approximate(probe, tables, one, codes[mine], scale[mine])).ravel())
    low, high = np.quantile(np.concatenate(over), [0.001, 0.999])
    return Index(centroids, books, visits, max(float(high), 0.0), max(float(-low), 0.0)), ids[:8_192], whole


def search(vectors: DataFrame, every: int = 20, k: int = 20, group_rows: int = 4096, query_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding", **fitting) -> DataFrame:
    """The k nearest found of each query, a row whose id is divisible by every, among all other rows.

    Columns: query_id, rank (from 1), vec_id, score (inner product in double precision on the original vectors). Equal
    scores go to the smaller id. A query has fewer than k rows only if there are fewer candidates.
    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows with a null id. Vectors of
    another length have no inner product with a query: each length is indexed and searched for itself. A result names ids,
    so rows equal in id and vector count once, and an id is no candidate for itself. Of equal vectors only the k + 1 with
    the smallest ids can be among the nearest, so a group of copies is reduced to these first. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    out = None
    for length in sorted(r.n for r in rows.groupBy(F.size("x").alias("n")).count().collect()):
        got = search_length(rows.where(F.size("x") == length), every, k, group_rows, query_rows, fitting)
        out = got if out is None else out.unionAll(got)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_length(rows: DataFrame, every: int, k: int, group_rows: int, query_rows: int, fitting: dict) -> DataFrame:
    """query_id, vec_id and score of at least the k nearest found; all rows have vectors of one length."""
    spark = rows.sparkSession
    copies = Window.partitionBy("x").orderBy("id")
    base = cut(rows.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).drop("copy").dropDuplicates(["x", "id"]))
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["x", "id"])
    model = spark.sparkContext.broadcast(fit(base, base.count(), k, **fitting))
    n_lists = len(model.value[0].centroids)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value[0]
        for b in batches:
            if b.num_rows:
                at, codes, scale = index.code(light(matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale.astype(np.float64))], names=["id", "x", "list", "code", "scale"])

    filed = cut(base.mapInArrow(coded, "id long, x array<double>, list int, code binary, scale double"))
    sizes = np.zeros(n_lists, dtype=np.int64)
    for r in filed.groupBy("list").count().collect():  # as many rows as lists, max_lists at most
        sizes[r["list"]] = r["count"]
    # Neighbouring small lists share a group, a large list is split over several.
    first, split, group, held = np.zeros(n_lists, dtype=np.int64), np.ones(n_lists, dtype=np.int64), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > group_rows:
            group, held = group + 1, 0
        first[i], split[i] = group, max(1, -(-int(n) // group_rows))
        group, held = (group + int(split[i]), 0) if split[i] > 1 else (group, held + int(n))
    places = spark.createDataFrame([(i, int(first[i]), int(split[i])) for i in range(n_lists)], "list int, first long, split long")
    stock = filed.join(F.broadcast(places), "list").withColumn("group", F.col("first") + F.pmod(F.xxhash64("id"), "split")).drop("first", "split")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each query and group that holds lists it visits. floor is a score that k rows of the sample reach; a
        group need not return less, but for the query's nearest lists, k + 1 rows together, which return whatever they
        have. So each query finds k rows where there are k; where its lists are too small it visits more."""
        index, ids, known = model.value
        for whole in batches:
            for b in (whole.slice(lo, 512) for lo in range(0, whole.num_rows, 512)):
                q, own = matrix(b.column(1)), b.column(0).to_numpy()
                order = np.argsort(-(light(q) @ index.centroids.T), axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) < k + 1).sum(axis=1) + 1
                seen = q @ known.T
                seen[own[:, None] == ids[None, :]] = -np.inf
                reached = np.partition(seen, -k, axis=1)[:, -k] if len(known) > k else np.full(len(q), -np.inf)
                row, groups, lists, home = [], [], [], []
                for i, mine in enumerate(order):
                    to: dict[int, list[int]] = {}
                    near = set()
                    for place, one in enumerate(mine[: max(index.visits, int(enough[i]))].tolist()):
                        for g in range(int(first[one]), int(first[one] + split[one])):
                            to.setdefault(g, []).append(one)
                            if place < enough[i]:
                                near.add(g)
                    row += [i] * len(to)
                    groups += to
                    lists += to.values()
                    home += [g in near for g in to]
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(reached[row] - 1e-9 * np.abs(reached[row])), pa.array(home, pa.bool_()), pa.array(groups, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "q", "floor", "home", "group", "lists"])

    asked = queries.mapInArrow(routed, "query_id long, q array<double>, floor double, home boolean, group long, lists array<int>")
    # A group's rows are read once; only where many queries meet they are read again for each block of queries.
    crowded = cut(asked.groupBy("group").count().where(F.col("count") > query_rows).select("group", F.ceil(F.col("count") / query_rows).cast("int").alias("blocks")))
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    blocks = F.coalesce("blocks", F.lit(1))
    stock = stock.join(crowded, "group", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    asked = asked.join(crowded, "group", "left").withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).drop("blocks")

    def scored(left, right):
        index, found = model.value[0], []
        if left.num_rows and right.num_rows:
            order = np.lexsort([left.column("id").to_numpy(), left.column("list").to_numpy()])
            cand, x = left.column("id").to_numpy()[order], matrix(left.column("x"))[order]
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), dtype=np.uint8).reshape(len(cand), -1)[order]
            in_list, scale = left.column("list").to_numpy()[order], light(left.column("scale").to_numpy()[order])
            start = np.flatnonzero(np.diff(in_list, prepend=-1))
            bounds = {int(in_list[a]): (a, b) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(in_list)])}
            q, floor, own = matrix(right.column("q")), right.column("floor").to_numpy(), right.column("query_id").to_numpy()
            floor = np.where(np.asarray(right.column("home").combine_chunks()), -np.inf, floor)
            lists = right.column("lists").to_pylist()
            for lo in range(0, len(q), QUERIES):
                some = slice(lo, lo + QUERIES)
                asking = light(q[some])
                tables, wanted = index.tables(asking), {}
                for i, ones in enumerate(lists[some]):
                    for one in ones:
                        wanted.setdefault(one, []).append(i)
                near = np.full((len(cand), len(asking)), -np.inf, dtype=asking.dtype)
                for one, who in wanted.items():
                    a, b = bounds.get(one, (0, 0))
                    if b > a and len(who) == len(asking):
                        near[a:b] = index.approximate(asking, tables, one, codes[a:b], scale[a:b])
                    elif b > a:
                        near[a:b, who] = index.approximate(asking[who], tables[:, :, who], one, codes[a:b], scale[a:b])
                near[cand[:, None] == own[some][None, :]] = -np.inf
                # What k rows here reach, less both errors of the approximation, is left by no row that counts.
                kth = np.partition(near, len(cand) - k, axis=0)[len(cand) - k] if len(cand) > k else np.full(len(asking), -np.inf)
                least = np.maximum(kth - index.margin - index.excess, floor[some] - index.margin)
                c, r = np.nonzero((near >= least[None, :]) & (near > -np.inf))
                exact = np.einsum("pd,pd->p", x[c], q[some][r])
                keep = exact >= floor[some][r]
                c, r, exact = c[keep], r[keep], exact[keep]
                best = np.lexsort([cand[c], -exact, r])
                r = r[best]
                first_of = np.flatnonzero(np.diff(r, prepend=-1))
                head = np.arange(len(r)) - np.repeat(first_of, np.diff(np.append(first_of, len(r)))) < k
                found.append((own[some][r[head]], cand[c[best]][head], exact[best][head]))
        parts = [np.concatenate(v) for v in zip(*found)] if found else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)), "score": pa.array(parts[2].astype(np.float64))})

    return stock.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(scored, "query_id long, vec_id long, score double")
