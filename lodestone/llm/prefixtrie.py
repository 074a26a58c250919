"""The trie of conversation prefixes: members, children, leaves and tokens saved by each shared prefix.

A prefix is known by a digest: the exclusive or, over its turns, of hashes of place and content. So a long conversation's
prefixes are found in stretches that don't wait for each other, and a prefix's parent is its digest without the last turn.
Sums over subtrees are rolled up by pointer jumping: in each round a node adds what it has gathered to the node it points
to and then points as far again, so the number of rounds is the logarithm of the depth. Python only hashes lists of ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import Rounds
from .common import cut, number_in_groups

#: A node to which more rows point is looked up apart, and this many such nodes may be sent to all tasks.
MANY, BROADCAST_NODES = 16_384, 100_000
#: Ids of a list of ends that are joined to one text, and turns of a stretch.
ENDS, STRETCH = 512, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(messages: DataFrame, span: int, heads: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, turns) and turns (conv, pos, digest, words) as they are after the first ones are exchanged."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), words.alias("words")).where("conv is not null")
    rows = cut(number_in_groups(rows, ["conv"], ["turn", "digest"], "pos").drop("turn"))
    convs = rows.groupBy("conv").agg((F.max("pos") + 1).alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string")) % heads).withColumn("origin", F.col("conv") - F.col("conv") % span)
    lengths = convs.select(F.col("conv").alias("origin"), F.col("own").alias("there"))
    convs = convs.join(lengths, "origin", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = cut(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).drop("there"))
    # A long conversation is joined stretch by stretch.
    spread = convs.select("conv", "h", "taken", "turns", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / STRETCH))).alias("stretch"))
    later = rows.withColumn("stretch", F.floor(F.col("pos") / STRETCH)).join(spread, ["conv", "stretch"]).where("pos >= h")
    later = later.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turns", "digest", "words")
    first = rows.where(F.col("pos") < heads - 1).withColumnRenamed("conv", "origin").join(convs, "origin").where("pos < h")
    return convs, first.select("conv", "pos", "turns", "digest", "words").unionByName(later)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, (a, b) the prefix's digest, (pa, pb) that of its parent, words of its last turn, ends: it is the whole."""
    turns = turns.withColumn("a", F.xxhash64("pos", "digest")).withColumn("b", F.xxhash64(F.lit("second"), "digest", "pos"))
    turns = cut(turns.withColumn("stretch", F.floor(F.col("pos") / STRETCH)).drop("digest"))
    whole = turns.groupBy("conv", "stretch").agg(F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv", "stretch", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(c) for c in ("ca", "cb")])
    inner = Window.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.withColumns({"xa": F.bit_xor("a").over(inner), "xb": F.bit_xor("b").over(inner)}).join(carried, ["conv", "stretch"])
    rows = rows.withColumns({"xa": F.col("xa").bitwiseXOR(F.col("ca")), "xb": F.col("xb").bitwiseXOR(F.col("cb"))})
    return rows.select(
        "conv", (F.col("pos") + 1).alias("depth"), F.col("xa").alias("a"), F.col("xb").alias("b"),
        F.col("xa").bitwiseXOR(F.col("a")).alias("pa"), F.col("xb").bitwiseXOR(F.col("b")).alias("pb"), "words", (F.col("pos") + 1 == F.col("turns")).alias("ends"),
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b) and ends_sha256 of rows (a, b, conv): SHA-256 of each node's ids in order, joined by commas.

    Ids are sorted and joined to short texts over ranged partitions. A hash takes its bytes one after another, so one task
    then reads the texts of a node, in order, and holds none of them.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, ids, block = TaskContext.get().partitionId(), None, [], 0
        rows: list[tuple] = []
        for b in batches:
            for a, c, i in zip(*(b.column(n).to_pylist() for n in ("a", "b", "conv"))):
                if ids and (now != (a, c) or len(ids) == ENDS):
                    rows.append((*now, at, block, ",".join(ids)))
                    ids, block = [], block + 1
                now = (a, c)
                ids.append(str(i))
            yield pack(rows)
            rows = []
        if ids:
            yield pack([(*now, at, block, ",".join(ids))])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["a", "b", "at", "block", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "ids"))):
                if now == (a, b):
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield out(done)
            done = []
        if state is not None:
            yield out([(*now, state.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])

    texts = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(joined, "a long, b long, at int, block int, ids string")
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "at", "block").mapInArrow(hashed, "a long, b long, ends_sha256 string")


def look_up(rows: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """rows with the columns of table's row whose (a, b) equals their keys; table (a, b, fan, ...) names how many rows ask.

    Nodes that very many rows ask for are sent to all tasks, so that no task gets all these rows.
    """
    table = table.withColumnsRenamed({"a": keys[0], "b": keys[1]})
    crowded = cut(table.where(F.col("fan") > MANY).drop("fan"))
    n = crowded.count()
    if not 0 < n <= BROADCAST_NODES:
        return rows.join(table.drop("fan"), keys)
    near, names = F.broadcast(crowded), F.broadcast(crowded.select(*keys))
    return rows.join(near, keys).unionByName(rows.join(names, keys, "left_anti").join(table.where(F.col("fan") <= MANY).drop("fan"), keys))


def roll_up(nodes: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """nodes (a, b, depth, pa, pb, conv_id, ...) with each of sums added up over subtrees, n_children and parent_conv_id.

    At the start of a round of reach r a node's sums hold what lies less than r levels below it, and it points r levels up.
    The nodes that point to it hold what lies r to 2r levels below. Rounds end where nothing points any more.
    """
    none = F.lit(None).cast("long")
    now = nodes.withColumns({"ta": F.col("pa"), "tb": F.col("pb"), "parent_conv_id": none, "n_children": F.lit(0).cast("long")}).drop("pa", "pb")
    root = nodes.where("depth = 0").select("conv_id").first()[0]
    rounds, reach = Rounds(nodes.sparkSession), 1
    while reach <= deepest:
        given = now.where(F.col("depth") >= reach).groupBy(F.col("ta").alias("a"), F.col("tb").alias("b")).agg(F.count(F.lit(1)).alias("fan"), *[F.sum(c).alias(f"more {c}") for c in sums])
        now = now.join(given, ["a", "b"], "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"more {c}"), F.lit(0)) for c in sums}).drop(*[f"more {c}" for c in sums])
        if reach == 1:
            now = now.withColumns({"n_children": F.coalesce("fan", F.lit(0).cast("long")), "parent_conv_id": F.when(F.col("depth") == 1, root)})
        now = rounds.write(now)
        # Nodes at most 2 * reach - 1 deep point to no further node; the root is never looked up.
        above = now.where((F.col("depth") >= reach) & F.col("fan").isNotNull()).select("a", "b", "fan", F.col("ta").alias("na"), F.col("tb").alias("nb"), F.col("conv_id").alias("above"))
        still = now.where(F.col("depth") < 2 * reach).drop("fan").withColumns({"ta": none, "tb": none})
        moved = look_up(now.where(F.col("depth") >= 2 * reach).drop("fan"), ["ta", "tb"], above).withColumns({"ta": F.col("na"), "tb": F.col("nb")})
        if reach == 1:
            moved = moved.withColumn("parent_conv_id", F.col("above"))
        now = rounds.write(still.unionByName(moved.drop("na", "nb", "above")))
        reach *= 2
    return now


def trie(messages: DataFrame, span: int = 20, heads: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rebuild conversations with shared first turns and return the trie of their prefixes; one row per node.

    Conversation c takes the first h = crc32(c) % heads turns of conversation c - c % span (all, if it has fewer; none, if
    there is none), then its own after its first h. Each distinct sequence of the first d turns (role, text) of a rebuilt
    conversation is a node of depth d; the root is that of depth 0. Columns: conv_id (the smallest member), depth,
    parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (nodes without children in the subtree, the
    node itself included), saved_tokens (members but one, times the words of the last text, summed over the subtree),
    ends_sha256 (of the members that end there).

    Turns are ordered by turn, null first, then by a digest of role and text. Null role or text is empty; rows with a null
    conversation belong to none and take no part. Repeated rows are turns of their own. An empty table gives no node, as not
    even the root has members. Other columns are not read. Contents are told apart by 128 bits of SHA-256, prefixes by two
    64-bit hashes.
    """
    convs, turns = rebuilt(messages, span, heads, conv_col, turn_col, role_col, text_col)
    rows = cut(prefixes(turns))
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("words"))
    parents = rows.select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.lit(0).alias("leaf")).distinct()
    nodes = nodes.unionByName(root).join(parents, ["a", "b"], "left")
    nodes = cut(nodes.withColumns({"n_leaves": F.coalesce("leaf", F.lit(1)).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}).drop("leaf", "words"))
    deepest = nodes.agg(F.max("depth")).first()[0]
    ends = rows.where("ends").select("a", "b", "conv").unionByName(convs.where("turns = 0").select(zero.alias("a"), zero.alias("b"), "conv"))
    summed = nodes.limit(0).withColumns({"parent_conv_id": zero, "n_children": zero}) if deepest is None else roll_up(nodes, ["n_leaves", "saved_tokens"], deepest)
    out = summed.join(ends_digests(ends), ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
