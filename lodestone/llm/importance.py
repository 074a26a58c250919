"""Importance resampling towards a target: hashed n-gram gains, Gumbel scores, and the exact highest ones with ranks.

Words and their CRC-32 are found on the flat bytes of many texts at once; bucket counts are added up by partition, and
the gains of all buckets, one array of fixed size, score each text. Every partition then sorts its eligible rows to a run.
Runs are cut at the bounds of score ranges and lie in the shared folder; the runs of a range are merged by a tournament
tree, block by block, and merging stops after the exact draw count. Ranges are small, so no task holds all runs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back

#: Bytes of text that are taken apart at a time; a longer text is taken whole.
SLICE = 1 << 21
#: Bytes of a word up to which many words are hashed together.
SHORT = 64
#: Rows of a range that one task merges, and rows of a block of a run.
RANGE_ROWS, BLOCK_ROWS = 1 << 18, 1 << 13
NO_ID = -(1 << 63)


def crc_table() -> np.ndarray:
    """CRC-32's table of 256 remainders, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = crc_table()
#: Bytes in lower case, A to Z alone, and whether such a byte lies in a word: digits, a to z, and all beyond ASCII.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes from start to end. Longer words come first, so each step works on a head of the arrays."""
    length = end - start
    order = np.argsort(SHORT - np.minimum(length, SHORT).astype(np.int16), kind="stable")
    at, reg, steps = start[order], state[order], -np.minimum(length[order], SHORT)
    for j in range(-int(steps[0]) if len(steps) else 0):
        n = int(np.searchsorted(steps, -j, side="left"))
        reg[:n] = CRC[(reg[:n] ^ data[at[:n] + j]) & 255] ^ (reg[:n] >> np.uint32(8))
    out = np.empty_like(reg)
    out[order] = reg
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] + SHORT : end[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and text and bucket of each feature (single words, then pairs of neighbours)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = LOWER[np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]]] if body is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = np.unique(offsets[(offsets > 0) & (offsets < len(data))])  # a word ends with its text
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    one = advance(np.full(len(start), 0xFFFFFFFF, dtype=np.uint32), data, start, end)
    pair = np.flatnonzero(text[1:] == text[:-1])
    spaced = CRC[(one[pair] ^ np.uint32(32)) & 255] ^ (one[pair] >> np.uint32(8))
    two = advance(spaced, data, start[pair + 1], end[pair + 1])
    hashed = ~np.concatenate([one, two]) % np.uint32(buckets)
    return np.bincount(text, minlength=len(texts)), np.concatenate([text, text[pair]]), hashed.astype(np.int64)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SLICE bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + SLICE, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task sends one row a bucket, the driver gets one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for whole in batches:
            for b in slices(whole, 0):
                total += np.bincount(features(b.column(0), buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])
        give_back()

    out = np.zeros(buckets, dtype=np.int64)
    for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: how much commoner it is in the target than in the source, in thousandths of the logarithm."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


@dataclass(frozen=True)
class Draw:
    """Settings: buckets of features, least words of an eligible document, share drawn in percent, and the seed."""

    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def resample(docs: DataFrame, target: DataFrame, how: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Score every document by its likeness to the target's texts and draw the highest scores; one row per row of docs.

    Columns, all long: the id, n_features, weight, score, rank (1, 2, 3... of those drawn by falling score, then rising id;
    else null). Features are single words and pairs of neighbouring words of the text with A to Z in lower case; words are
    runs of digits, a to z and characters beyond ASCII. The weight is the floored mean of the gains of a text's features, 0
    without features. The score adds Gumbel noise that seed and id fix. Of the rows with least_words words or more, percent
    in a hundred, rounded down, are drawn.

    A null text has no words. Ids are integers; a null id is hashed as the text "null" and comes first among ties. Repeated
    rows are rows of their own: rows of one id and score follow each other in an order that isn't stated. Empty tables give
    an empty result (docs) or a target without features. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, how.buckets), bucket_counts(target, target_col, how.buckets))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                words, text, bucket = features(b.column(1), how.buckets)
                n = np.bincount(text, minlength=b.num_rows)
                total = np.bincount(text, weights=gain[bucket], minlength=b.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id", "words", "n_features", "weight"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(score, "id long, words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = cut(rows.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("eligible", F.col("words") >= how.least_words).drop("words"))
    return ranked(rows, how.percent, range_rows).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def ranked(rows: DataFrame, percent: int, range_rows: int) -> DataFrame:
    """rows (id, n_features, weight, score, eligible) with rank. No join brings ranks back: drawn rows leave the merge.

    Scores are whole thousandths of logarithms of 64-bit counts, so there are less than 150,000 different ones whatever the
    input, and their counts come to the driver. They give the lowest score drawn and the ranges.
    """
    counts = sorted(((r.score, r["count"]) for r in rows.where("eligible").groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    none = F.lit(None).cast("long")
    if not wanted:
        return rows.withColumn("rank", none)
    taken, range_of, held, ranges = 0, [], 0, 0
    for score, n in counts:
        if taken >= wanted:
            break
        if held and held + n > range_rows:
            ranges, held = ranges + 1, 0
        range_of.append((score, ranges, n))
        held, taken = held + n, taken + n
    lowest = range_of[-1][0]
    at = F.coalesce("id", F.lit(NO_ID))
    high = rows.where(F.col("eligible") & (F.col("score") >= lowest)).withColumn("at", at)
    rest = rows.where(~F.col("eligible") | (F.col("score") < lowest)).withColumn("rank", none)
    bounds = id_bounds(high, [(s, n) for s, _, n in range_of if n > range_rows], range_rows)
    places, first = [], 0
    for i, (score, k, _) in enumerate(range_of):
        if i and k != range_of[i - 1][1]:
            first += 1 + len(bounds.get(range_of[i - 1][0], ()))
        places.append((score, first, bounds.get(score, [])))
    spark = rows.sparkSession
    place = F.broadcast(spark.createDataFrame(places, "score long, first int, bounds array<struct<at:long,parts:int>>"))
    below = F.size(F.filter("bounds", lambda b: b["at"] < F.col("at")))
    high = high.join(place, "score").withColumn("row", F.monotonically_increasing_id()).withColumn("below", below)
    parts = F.coalesce(F.get(F.col("bounds"), F.col("below"))["parts"], F.lit(1))
    high = high.select("score", "at", "n_features", "weight", F.col("id").isNotNull().cast("long").alias("named"), (F.col("first") + F.col("below")).alias("range"), F.pmod("row", parts).cast("int").alias("part"))
    runs = cut(high.sortWithinPartitions("range", "part", F.desc("score"), "at").mapInArrow(blocks, "range int, part int, run int, block int, n long, rows binary"))
    sizes = sorted((r.range, r.part, r.n) for r in runs.groupBy("range", "part").agg(F.sum("n").alias("n")).collect())  # a row for range_rows rows or a score
    before = np.cumsum([0, *(n for _, _, n in sizes)]).tolist()
    starts = spark.createDataFrame([(r, p, b, wanted) for (r, p, _), b in zip(sizes, before)], "range int, part int, before long, wanted long")
    merged = runs.join(starts, ["range", "part"]).groupBy("range", "part").applyInArrow(merge, "id long, n_features long, weight long, score long, rank long")
    return merged.unionByName(rest.select("id", "n_features", "weight", "score", "rank"))


def id_bounds(rows: DataFrame, heavy: list[tuple[int, int]], range_rows: int) -> dict[int, list[tuple[int, int]]]:
    """Ids at which the rows of one frequent score are cut, with the parts that a range ends in: more than one where the
    range is a single frequent id, whose rows may come in any order."""
    if not heavy:
        return {}
    pieces = max(-(-n // range_rows) for _, n in heavy)
    some = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(s,) for s, _ in heavy], "score long")), "score")
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    out = {}
    for r in some.groupBy("score").agg(F.percentile_approx("at", shares, 10_000).alias("cuts")).collect():
        found: dict[int, int] = {}
        for v in r.cuts:
            found[v] = found.get(v, 0) + 1
        bounds: dict[int, int] = {}
        for v, times in sorted(found.items()):
            if times > 1 and v > NO_ID:
                bounds.setdefault(v - 1, 1)
            bounds[v] = times
        out[r.score] = sorted(bounds.items())
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sorted rows as blocks of its run, each within one range."""
    run, number = TaskContext.get().partitionId(), 0
    for b in batches:
        if not b.num_rows:
            continue
        c = {n: b.column(n).to_numpy() for n in b.schema.names}
        table = np.column_stack([c[n] for n in ("score", "at", "n_features", "weight", "named")]).astype(np.int64)
        edge = np.flatnonzero((np.diff(c["range"]) != 0) | (np.diff(c["part"]) != 0)) + 1
        bound = np.unique(np.concatenate([[0], edge, np.arange(0, b.num_rows, BLOCK_ROWS), [b.num_rows]])).tolist()
        rows = [(int(c["range"][lo]), int(c["part"][lo]), run, number + i, hi - lo, table[lo:hi].tobytes()) for i, (lo, hi) in enumerate(zip(bound, bound[1:]))]
        number += len(rows)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["range", "part", "run", "block", "n", "rows"])


class Tournament:
    """A tree of matches between sorted sources. Inner nodes keep losers, so a winner's next entry replays one path."""

    def __init__(self, heads: list):
        k = self.k = len(heads)
        self.heads, self.losers = heads, [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if heads[a] <= heads[b] else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def replace(self, head) -> None:
        """The winner's source goes on with this entry."""
        heads, losers, won = self.heads, self.losers, self.winner
        heads[won] = head
        node = (self.k + won) // 2
        while node:
            if heads[losers[node]] < heads[won]:
                losers[node], won = won, losers[node]
            node //= 2
        self.winner = won


#: After every entry of a source.
END = (math.inf,)


def entries(parts: list[bytes], run: int, first: int) -> Iterator[tuple]:
    """Keys of a run in order, with each row's place; one block is opened at a time."""
    for part in parts:
        table = np.frombuffer(part, dtype=np.int64).reshape(-1, 5)
        for place, (score, at) in enumerate(table[:, :2].tolist(), first):
            yield -score, at, run, place
        first += len(table)


def merge(key, table):
    """The rows of one range in order with their ranks; those after the last drawn have none and aren't ordered."""
    order = np.lexsort([table.column("block").to_numpy(), table.column("run").to_numpy()]).tolist()
    run, body = table.column("run").to_pylist(), table.column("rows").to_pylist()
    before, wanted = table.column("before")[0].as_py(), table.column("wanted")[0].as_py()
    rows = np.frombuffer(b"".join(body[i] for i in order), dtype=np.int64).reshape(-1, 5)
    left = int(min(max(wanted - before, 0), len(rows)))
    drawn = []
    if left:
        by_run: dict[int, list[bytes]] = {}
        for i in order:
            by_run.setdefault(run[i], []).append(body[i])
        sources, first = [], 0
        for r, parts in by_run.items():
            sources.append(entries(parts, r, first))
            first += sum(map(len, parts)) // 40
        tree = Tournament([next(s) for s in sources])
        while len(drawn) < left:
            drawn.append(tree.heads[tree.winner][3])
            tree.replace(next(sources[tree.winner], END))
    others = np.ones(len(rows), dtype=bool)
    others[drawn] = False
    rows = rows[np.concatenate([np.array(drawn, dtype=np.int64), np.flatnonzero(others)])]
    ids = pa.array(rows[:, 1], mask=rows[:, 4] == 0)
    place = np.arange(1, len(rows) + 1)
    return pa.table({"id": ids, "n_features": rows[:, 2], "weight": rows[:, 3], "score": rows[:, 0], "rank": pa.array(before + place, mask=place > left)})
