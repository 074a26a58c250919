"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

Texts are sets of word n-grams; equal texts are joined by their digest and stand for one. Each distinct text has a label
of MinHash values in every tree. A tree is its sorted labels: texts that share a prefix lie side by side, and a trie node is
a run of labels with a common prefix. Matched prefixes start at full length and are shortened node by node: down to the
depth at which all trees together reach the target recall, but not below a node that holds a crowd. From the lengths it got
in all trees follows the recall a text has reached; texts that a crowd kept below the target form the next, smaller forest,
in which larger crowds are allowed, until every text has reached it. Texts of one node are compared by their sketches;
what remains are candidate groups, which are verified exactly, block against block, with the n-gram sets. No step lists the
pairs of a group: blocks give link counts and a spanning forest of the links.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import cut, free_name, give_back, release

TREES, DEPTH = 24, 6
HASHES = TREES * DEPTH
#: A label is a byte for the tree and DEPTH values of 4 bytes.
LABEL = 1 + 4 * DEPTH
GROUP_BYTES = 400_000
#: Rows of an Arrow batch whose texts are Python strings at a time.
SLICE_ROWS = 1000
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Largest table of 16-byte keys that is broadcast; a larger one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Labels that a task sorts and holds, about: the number of tasks follows the number of texts.
TASK_LABELS = 400_000
#: Rows of one text beyond which what is known of it is sent to all tasks, so that no task gets all these rows.
CROWDED = 1000


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BASE = odd_numbers(1, 3)[0]
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
PLACES = odd_numbers(64, 4)
MINWISE = odd_numbers(HASHES, 5)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            run = np.full(n, b, dtype=np.uint64)
            run[0] = 1
            _POWERS[k] = np.cumprod(run)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word n-grams, text after text, and each text's count. Words are runs without ASCII white
    space. A text of 1 to n - 1 words has one n-gram, all its words; one without words has none."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
    inside = ~BLANK[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))) + 1
    words = np.diff(np.concatenate(([0], np.searchsorted(start, bounds))))
    first = np.cumsum(words) - words
    counts = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    at = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.repeat(np.minimum(words, n), counts)
    padded = np.concatenate((word, np.zeros(n, np.uint64)))
    h = size.astype(np.uint64)
    short = size < n
    for k in range(n):
        part = padded[at + k] * PLACES[k]
        if k and short.any():
            part = np.where(size > k, part, np.uint64(0))
        h = h + part
    return mix(h), counts


def signatures(texts: list[str], n: int) -> tuple[list[bytes | None], list[bytes | None]]:
    """Labels of each text in all trees, one after the other, and its sketch; None without n-grams. A label holds the high
    halves of MinHash values, the sketch one byte of each value: two texts agree in about (their similarity) x HASHES."""
    grams, counts = shingles(texts, n)
    labels: list[bytes | None] = [None] * len(texts)
    sketches: list[bytes | None] = [None] * len(texts)
    full = np.flatnonzero(counts)
    if not len(full):
        return labels, sketches
    starts = (np.cumsum(counts) - counts)[full]
    out, buffer = np.empty((len(full), HASHES), dtype=">u4"), np.empty_like(grams)
    for k in range(HASHES):
        np.multiply(grams, MINWISE[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
    values = out.view(np.uint8).reshape(len(full), TREES, 4 * DEPTH)
    trees = np.broadcast_to(np.arange(TREES, dtype=np.uint8)[None, :, None], (len(full), TREES, 1))
    whole = np.concatenate([trees, values], axis=2).reshape(len(full), TREES * LABEL)
    low = np.ascontiguousarray(out.view(np.uint8)[:, 3::4])
    for i, label, sketch in zip(full.tolist(), whole, low):
        labels[i], sketches[i] = label.tobytes(), sketch.tobytes()
    return labels, sketches


def plan_depth(threshold: float, recall: float) -> int:
    """The longest prefix at which all trees together find a pair at the threshold with the wanted chance."""
    for depth in range(DEPTH, 0, -1):
        if (1 - threshold**depth) ** TREES <= 1 - recall:
            return depth
    raise ValueError(f"{TREES} trees don't reach a recall of {recall} at {threshold}")


def bytes_matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width), dtype=np.uint8)
    fixed = column.cast(pa.binary(width))
    return np.frombuffer(fixed.buffers()[1], dtype=np.uint8)[fixed.offset * width : (fixed.offset + len(fixed)) * width].reshape(-1, width)


def trie_nodes(shortest: int):
    """Walks a partition of sorted labels: of every depth from shortest on, how many rows around share the row's prefix here.

    A row whose prefix is its own even at the shortest depth is dropped, unless its run touches an end of the partition,
    where it may go on in the next one (edge).
    """

    def run(batches):
        release()
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        label = bytes_matrix(table.column("label"), LABEL)
        n, sizes = len(label), np.empty((len(label), DEPTH - shortest + 1), dtype=np.int32)
        edge = np.zeros(n, dtype=bool)
        equal = (label[1:] == label[:-1]).cumprod(axis=1, dtype=np.uint8)
        for k in range(sizes.shape[1]):
            start = np.flatnonzero(np.concatenate(([True], equal[:, 4 * (shortest + k)] == 0)))
            rows = np.diff(np.append(start, n))
            sizes[:, k] = np.repeat(rows, rows)
            if not k:
                edge[: rows[0]] = edge[n - rows[-1] :] = True
        keep = np.flatnonzero((sizes[:, 0] > 1) | edge)
        table = table.take(pa.array(keep))
        flat = pa.array(sizes[keep].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * sizes.shape[1]), flat)
        here = pa.array(np.full(len(keep), TaskContext.get().partitionId(), dtype=np.int32))
        whole = pa.Table.from_arrays([table.column("label"), table.column("key"), here, pa.array(edge[keep]), lists], names=["label", "key", "part", "edge", "sizes"])
        yield from whole.to_batches(max_chunksize=10_000)

    return run


def runs_over_ends(ends: list, shortest: int) -> dict[bytes, int]:
    """Rows of each prefix whose run goes over the end of a partition; ends has first and last (label, sizes) of each, in order."""
    found: dict[bytes, int] = {}
    for k in range(DEPTH - shortest + 1):
        width, run, rows, over = 1 + 4 * (shortest + k), None, 0, False
        for e in ends:
            first, last = bytes(e.first.label[:width]), bytes(e.last.label[:width])
            if run == first:
                rows, over = rows + e.first.sizes[k], True
            else:
                if over:
                    found[run] = rows
                run, rows, over = first, e.first.sizes[k], False
            if last != first:
                if over:
                    found[run] = rows
                run, rows, over = last, e.last.sizes[k], False
        if over:
            found[run] = rows
    return found


def choose(shortest: int, threshold: float, crowd: int, turn: int, over: dict[bytes, int]):
    """The node at which each row is matched: its shortest prefix whose node holds no more rows than crowd.

    Gives the node as a hash (null where the row is alone there, or where even the full label is crowded) with its rows, and
    missed: by how much the row's tree adds to the logarithm of the chance to miss a pair, over a match at the shortest.
    """
    miss = np.log1p(-(threshold ** np.arange(shortest, DEPTH + 1)))
    missed = np.append(miss - miss[0], -miss[0])
    prefixes = sorted(over)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            label, sizes = bytes_matrix(b.column("label"), LABEL), b.column("sizes").flatten().to_numpy().reshape(b.num_rows, -1).copy()
            edge = np.flatnonzero(np.asarray(b.column("edge"))) if over else ()
            if len(edge):
                some = label[edge]
                # Labels come in order, so few of the runs over ends begin between the first and the last of them.
                low, high = some[0].tobytes(), some[-1].tobytes()
                for key in prefixes[bisect.bisect_left(prefixes, low[: 1 + 4 * shortest]) : bisect.bisect_right(prefixes, high)]:
                    hit = (some[:, : len(key)] == np.frombuffer(key, dtype=np.uint8)).all(axis=1)
                    sizes[edge[hit], (len(key) - 1) // 4 - shortest] = over[key]
            fits = sizes <= crowd
            at = np.where(fits.any(axis=1), fits.argmax(axis=1), sizes.shape[1])
            rows = np.where(at < sizes.shape[1], sizes[np.arange(len(at)), np.minimum(at, sizes.shape[1] - 1)], 0)
            word = np.ascontiguousarray(label[:, 1:]).view(">u4").astype(np.uint64)
            node = mix(label[:, 0].astype(np.uint64) + np.uint64(turn << 32) + (at.astype(np.uint64) << np.uint64(16)))
            for k in range(DEPTH):
                node = np.where(k < shortest + at, mix(node * BASE + word[:, k]), node)
            keep = np.flatnonzero((rows > 1) | (at > 0))
            alone = pa.array(rows[keep] < 2)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(keep)), pc.if_else(alone, pa.scalar(None, pa.int64()), pa.array(node[keep].view(np.int64))), pa.array(rows[keep].astype(np.int32)), pa.array(missed[at[keep]])], names=["key", "bucket", "n", "missed"])

    return run


def forest(signed: DataFrame, threshold: float, recall: float, crowd: int = 64) -> DataFrame:
    """bucket, key and n (rows of the bucket): texts matched in a node of the forest. Every pair at the threshold shares a
    bucket with a chance of recall or more.

    A node's depth is decided for all its texts alike, so a text that has reached the target finds all its partners, also
    those that have not; only texts that have not are matched again among themselves.
    """
    shortest = plan_depth(threshold, recall)
    allowed = float(np.log1p(-recall) - TREES * np.log1p(-(threshold**shortest)))
    labels = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * LABEL + 1, F.lit(LABEL)))
    found, active, rows, turn = None, signed, signed.count(), 0
    usual = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        leaves = active.select(F.explode(labels).alias("label"), "key").repartitionByRange(max(usual, -(-rows * TREES // TASK_LABELS)), "label", "key").sortWithinPartitions("label", "key")
        nodes = cut(leaves.mapInArrow(trie_nodes(shortest), "label binary, key binary, part int, edge boolean, sizes array<int>"))
        # One row for each task of the sort, not of the data.
        ends = nodes.groupBy("part").agg(F.min(F.struct("label", "sizes")).alias("first"), F.max(F.struct("label", "sizes")).alias("last")).orderBy("part").collect()
        matched = cut(nodes.mapInArrow(choose(shortest, threshold, crowd, turn, runs_over_ends(ends, shortest)), "key binary, bucket long, n int, missed double"))
        slots = matched.where("bucket is not null").select("bucket", "key", "n")
        found = slots if found is None else found.unionAll(slots)
        if crowd >= rows:
            return found
        short = cut(matched.where("missed > 0").groupBy("key").agg(F.sum("missed").alias("missed")).where(F.col("missed") > allowed).select("key"))
        rows = short.count()
        if not rows:
            return found
        active, crowd, turn = signed.join(short, "key", "left_semi"), crowd * 16, turn + 1


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > GROUP_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def sign(n: int):
    def run(batches):
        release()
        for b in (whole.slice(lo, SLICE_ROWS) for whole in batches for lo in range(0, whole.num_rows, SLICE_ROWS)):
            texts = b.column("text").to_pylist()
            first: dict[bytes, int] = {}
            keys = b.column("key").to_pylist()
            fresh = [i for i, k in enumerate(keys) if first.setdefault(k, i) == i]
            own = [texts[i] for i in fresh]
            labels: list[bytes | None] = []
            sketches: list[bytes | None] = []
            for lo, hi in batches_of(own):
                for whole, part in zip((labels, sketches), signatures(own[lo:hi], n)):
                    whole += part
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in fresh], pa.binary()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())], names=["key", "sig", "sketch"])
        give_back()

    return run


def runs(batches, group: list[str]):
    """Arrow batches sorted by group, cut anew so that each table holds whole groups; yields (table, bounds of groups)."""
    held: list[pa.RecordBatch] = []

    def last_start(b: pa.RecordBatch) -> int:
        same = np.ones(b.num_rows, dtype=bool)
        for c in group:
            col = b.column(c)
            same &= np.asarray(pc.equal(col, col[b.num_rows - 1]))
        other = np.flatnonzero(~same)
        return int(other[-1]) + 1 if len(other) else 0

    def ready(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        change = np.zeros(t.num_rows, dtype=bool)
        change[0] = True
        for c in group:
            col = t.column(c).combine_chunks()
            change[1:] |= np.asarray(pc.not_equal(col[1:], col[:-1]))
        return t, np.append(np.flatnonzero(change), t.num_rows).tolist()

    for b in batches:
        if not b.num_rows:
            continue
        cut_at = last_start(b)
        if held and cut_at == 0 and any(held[-1].column(c)[-1] != b.column(c)[0] for c in group):
            yield ready(held)
            held = [b]
        elif cut_at == 0:
            held.append(b)
        else:
            yield ready([*held, b.slice(0, cut_at)])
            held = [b.slice(cut_at)]
    if held:
        yield ready(held)


def linked_tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric table of links; no list of all links is made."""
    edges, waiting = [], np.ones(len(linked), dtype=bool)
    for first in range(len(linked)):
        frontier = [first] if waiting[first] else []
        waiting[first] = False
        while frontier:
            i = frontier.pop()
            new = np.flatnonzero(linked[i] & waiting).tolist()
            waiting[new] = False
            edges += [(i, j) for j in new]
            frontier += new
    return edges


def near_tree(sketch: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the rows of sketch that agree in least places or more. Each row is compared with the rows not
    reached yet, so a dense group takes about one comparison for each of its rows."""
    edges, waiting, frontier = [], np.arange(1, len(sketch)), [0]
    while len(waiting):
        if not frontier:
            frontier, waiting = [int(waiting[0])], waiting[1:]
            continue
        some, frontier = frontier[:32], frontier[32:]
        agree = np.zeros((len(some), len(waiting)), dtype=bool)
        for lo in range(0, len(waiting), 1024):
            agree[:, lo : lo + 1024] = (sketch[some][:, None, :] == sketch[waiting[lo : lo + 1024]][None, :, :]).sum(axis=2) >= least
        hit = agree.any(axis=0)
        if hit.any():
            by = agree.argmax(axis=0)
            edges += [(some[by[j]], int(waiting[j])) for j in np.flatnonzero(hit)]
            frontier += waiting[hit].tolist()
            waiting = waiting[~hit]
    return edges


def candidates(least: int):
    """Spanning edges of the texts of a bucket (or of two blocks of one) whose sketches agree enough."""

    def run(batches):
        release()
        for table, bounds in runs(batches, ["bucket", "cell"]):
            keys = table.column("key").combine_chunks()
            sketch = bytes_matrix(table.column("sketch"), HASHES)
            a, b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo == 2 and (sketch[lo] == sketch[lo + 1]).sum() >= least:
                    a.append(lo)
                    b.append(lo + 1)
                elif hi - lo > 2:
                    for i, j in near_tree(sketch[lo:hi], least):
                        a.append(lo + i)
                        b.append(lo + j)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(a, pa.int64())), keys.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of incidence matrices in slices of the shared n-grams."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=m)
    grams, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = np.flatnonzero(n > 1)
    column = np.full(len(grams), -1, dtype=np.int64)
    column[shared] = np.arange(len(shared))
    col = column[at.ravel()]
    keep = col >= 0
    owner, col = owner[keep], col[keep]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = max(1024, 4_000_000 // m)
    out = np.zeros((m, m), dtype=np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64)
    for lo in range(0, len(shared), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((m, min(width, len(shared) - lo)), dtype=np.float32)
        part[owner[a:b], col[a:b] - lo] = 1
        out += part @ part.T
    return out


def verify(n: int, threshold: float):
    """For each cell of a candidate group: every text's links in it, counted with copies, and a spanning forest of them."""

    def run(batches):
        release()
        for table, bounds in runs(batches, ["group", "cell"]):
            keys, texts = table.column("key").combine_chunks(), table.column("text")
            sides, copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
            a, b, links = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                order = np.argsort(sides[lo:hi], kind="stable") + lo
                sets = []
                part = texts.take(pa.array(order)).to_pylist()
                for x, y in batches_of(part):
                    grams, counts = shingles(part[x:y], n)
                    sets += [np.unique(s) for s in np.split(grams, np.cumsum(counts)[:-1])]
                sizes = np.fromiter(map(len, sets), dtype=np.float64, count=len(sets))
                common = overlaps(sets)
                side, linked = sides[order], np.zeros(common.shape, dtype=bool)
                for x in range(0, len(sets), 256):  # some rows at a time, in double precision
                    some = common[x : x + 256].astype(np.float64)
                    linked[x : x + 256] = (some > 0) & (some >= threshold * (sizes[x : x + 256, None] + sizes[None, :] - some) - 1e-9)
                    if side[0] != side[-1]:
                        linked[x : x + 256] &= side[x : x + 256, None] != side[None, :]
                np.fill_diagonal(linked, False)
                mine = copies[order]
                weight = np.array([int(mine[row].sum()) for row in linked], dtype=np.int64)
                for i in np.flatnonzero(weight):
                    a.append(int(order[i]))
                    b.append(None)
                    links.append(int(weight[i]))
                for i, j in linked_tree(linked):
                    a.append(int(order[i]))
                    b.append(int(order[j]))
                    links.append(0)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(a, pa.int64())), keys.take(pa.array(b, pa.int64())), pa.array(links, pa.int64())], names=["a", "b", "links"])
        give_back()

    return run


def in_cells(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of a large group are dealt to blocks, and each pair of blocks is a cell; side tells them apart.

    rows has key and n (the group's size). A group of one block is one cell. A group of b blocks is read b times, in
    b * (b + 1) / 2 cells of two blocks at most.
    """
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    return rows.withColumn("cell", cell.cast("long")).withColumn("side", F.col("mine")).drop("blocks", "mine", "other", "n")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999, sigmas: float = 5.2, crowd: int = 64, bucket_block: int = 2048, verify_block: int = 512, verify_chars: int = 4_000_000, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join all texts whose sets of word n-grams have a Jaccard similarity of threshold or more.

    One row per row of docs: the id, class_id (smallest id of the documents linked directly or over others), n_links
    (other documents that this one is linked to, copies counted each), class_size, copies (rows with this very text),
    kept (true for one row of each class: the smallest id), and text_key (the text's digest).

    Equal texts are linked. A text of fewer than n words has one n-gram, all its words. A text without words is linked
    to equal texts alone. A null text is linked to nothing and is a class of its own (text_key null). Null ids are
    smaller than others; rows of one id are separate documents. Other columns are not read. An empty table gives none.

    recall is the chance that the forest finds a pair at the threshold. sigmas says how many standard deviations below the
    threshold the sketches of a pair may lie (5.2 lose one pair in ten million); infinity compares without sketches.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    members = cut(rows.select("id", "key", F.monotonically_increasing_id().alias("row")))
    copies = members.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    signed = rows.where("key is not null").select("key", "text").mapInArrow(sign(n), "key binary, sig binary, sketch binary").where("sig is not null")
    signed = cut(signed.groupBy("key").agg(F.first("sig").alias("sig"), F.first("sketch").alias("sketch")))
    slots = forest(signed.select("key", "sig"), threshold, recall, crowd)
    least = max(0, int(HASHES * (threshold - sigmas * np.sqrt(threshold * (1 - threshold) / HASHES)))) if np.isfinite(sigmas) else 0
    cells = in_cells(slots.join(signed.select("key", "sketch"), "key"), F.ceil(F.col("n") / bucket_block))
    edges = cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").select("bucket", "cell", "key", "sketch").mapInArrow(candidates(least), "a binary, b binary")
    groups = cut(components(edges).select(F.col("node").alias("key"), F.col("component").alias("group")))
    some = F.broadcast(groups.select("key")) if groups.count() <= BROADCAST_KEYS else groups.select("key")
    texts = rows.select("key", "text").join(some, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    chosen = cut(groups.join(texts, "key").join(copies, "key"))
    sizes = chosen.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / verify_block), F.least(F.col("n"), F.ceil(F.col("chars") / verify_chars)))
    cells = in_cells(chosen.join(sizes, "group"), blocks)
    checked = cells.repartition("group", "cell").sortWithinPartitions("group", "cell").select("group", "cell", "side", "key", "copies", "text")
    found = cut(checked.mapInArrow(verify(n, threshold), "a binary, b binary, links long"))
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    classes = components(found.where("b is not null").select("a", "b"))
    # What is known of a text is found text by text; its rows then meet it, those of a text with very many rows not in one task.
    known = copies.join(links, "key", "left").join(classes.select(F.col("node").alias("key"), "component"), "key", "left")
    out = with_known(members, cut(known))
    alone = F.concat(F.lit("row "), F.col("row").cast("string")).cast("binary")
    out = cut(out.withColumn("class", F.coalesce("component", "key", alone)))
    # Rows alone in their class need no look at others. Of the rest a large class is dealt to parts, none meets in one task.
    single = F.col("component").isNull() & (F.coalesce("copies", F.lit(1)) == 1)
    several = out.where(~single).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    parts = several.groupBy("class", "salt").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("rows"))
    best = parts.groupBy("class").agg(F.min("first").alias("first"), F.sum("rows").alias("class_size"))
    named = several.join(parts.select("class", "salt").join(best, "class"), ["class", "salt"]).drop("salt")
    named = named.unionByName(out.where(single).withColumn("first", F.struct("id", "row")).withColumn("class_size", F.lit(1).cast("long")))
    return named.select(
        F.col("id").alias(id_col), F.col("first.id").alias("class_id"),
        F.when(F.col("key").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        "class_size", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("key").alias("text_key"),
    )


def with_known(members: DataFrame, known: DataFrame) -> DataFrame:
    """members with what is known of their key (key, copies, ...), null without one."""
    usual = members.join(known, "key", "left")
    crowded = known.where(F.col("copies") > CROWDED)
    if not 0 < crowded.count() <= BROADCAST_KEYS:
        return usual
    few, names = F.broadcast(crowded), F.broadcast(crowded.select("key"))
    rest = members.join(names, "key", "left_anti").join(known.where(F.col("copies") <= CROWDED), "key", "left")
    return members.join(few, "key").unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each near-duplicate class, the one of smallest id; all columns are kept as they are.

    Rows equal in id and text stay once. Rows with a null text all stay.
    """
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    who, what = free_name(docs, "judged id"), free_name(docs, "judged key")
    per = cut(judged.where("text_key is not null").groupBy(F.col(id_col).alias(who), F.col("text_key").alias(what)).agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")))
    same = F.col(f"`{who}`").eqNullSafe(docs[id_col]) & (F.col(f"`{what}`") == text_key(docs[text_col]))

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df

    gone = per.where("not kept or rows > 1").select(who, what)
    out = docs.join(bounded(gone), same, "left_anti")
    again = per.where("kept and rows > 1").select(who, what)
    if again.count():
        mark = free_name(docs, "key of row")
        once = docs.join(bounded(again), same, "left_semi").withColumn(mark, text_key(docs[text_col]))
        out = out.unionByName(once.dropDuplicates([id_col, mark]).drop(mark))
    return out
