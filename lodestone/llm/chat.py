"""Quotation linking: conversations in reply order, without the quotes.

A message's lines are parsed into nested quote levels. Every quoted passage (block, paragraph and line) and every
message's own passages are normalised and hashed; a quote is joined to the latest earlier message of its conversation
that wrote the passage. Messages without such a quote reply to the one before. Pointer jumping over the reply links
gives each message its thread and depth, and threads are numbered in reply order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, number_in_groups

QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.DOTALL)
#: A line that announces a quote: it ends in a colon and starts or ends like a mail program's.
ATTRIBUTION = re.compile(r"(on|am|le|el)\b.*:|.*\b(wrote|writes|schrieb|écrit|escribió) ?:", re.IGNORECASE)


def levels(text: str) -> list[tuple[int, str]]:
    """Quote level and content of each line; level 0 is the writer's own."""
    out = []
    for line in text.split("\n"):
        found = QUOTE.fullmatch(line)
        out.append((found[1].count(">"), found[2].rstrip()) if found else (0, line.rstrip()))
    return out


def normal(passage: str) -> str:
    """Case and white space don't matter in a quotation."""
    return " ".join(passage.casefold().split())


def digest(passage: str) -> str | None:
    """Hash of a normalised passage; None where it is empty."""
    plain = normal(passage)
    return hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if plain else None


def passages(lines: list[str]) -> list[str]:
    """A block's distinct passages: the whole, its paragraphs and its lines."""
    found, paragraph = ["\n".join(lines)], []
    for line in [*lines, ""]:
        if line.strip():
            found.append(line)
            paragraph.append(line)
        elif paragraph:
            found.append("\n".join(paragraph))
            paragraph = []
    return list(dict.fromkeys(found))


def parse(text: str | None) -> tuple[str, list[tuple[int, str, int]]]:
    """The writer's own text, and (level, hash, characters) of all passages, level 0 being own ones."""
    rows = levels(text or "")
    for i in range(len(rows) - 1):
        if rows[i][0] < rows[i + 1][0] and ATTRIBUTION.fullmatch(rows[i][1].strip()):
            rows[i] = (rows[i][0], "")
    own = "\n".join(line for level, line in rows if level == 0).strip()
    blocks: list[tuple[int, list[str]]] = []
    for level, line in rows:
        if level and blocks and blocks[-1][0] == level:
            blocks[-1][1].append(line)
        elif level:
            blocks.append((level, [line]))
        elif blocks and blocks[-1][0]:
            blocks.append((0, []))
    found: dict[tuple[int, str], int] = {}
    for level, lines in [*((b for b in blocks if b[0])), (0, own.split("\n"))]:
        for p in passages(lines):
            h = digest(p)
            if h is not None:
                found[level, h] = len(normal(p))
    return re.sub(r"\n{3,}", "\n\n", own), [(level, h, n) for (level, h), n in found.items()]


def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in (whole.iloc[lo : lo + 1000].copy() for whole in frames for lo in range(0, len(whole), 1000)):
        parsed = [parse(t if isinstance(t, str) else None) for t in f["text"]]
        f["own"] = [p[0] for p in parsed]
        f["found"] = [[{"level": a, "hash": b, "chars": c} for a, b, c in p[1]] for p in parsed]
        yield f.drop(columns="text")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", keep_text: bool = False, stretch: int = 4096) -> DataFrame:
    """Link quotations and order each conversation by replies; one row per row of messages.

    Columns: the conversation, turn and role, parent_turn (null: none), link ("quote", "order" or "start"), thread_turn
    (turn of the thread's first message), depth in the thread, position (gapless from 0 in the thread, a reply after what
    it replies to), n_quotes (quoted passages), own_chars and own_sha256 of the text without quotes, and with keep_text
    also own_text and rendered (the role's header and the own text).

    A quote's origin is the latest message of the same conversation with a smaller turn that wrote the passage. The
    parent is the origin of the passages of the lowest level that have one; the longest passage decides, then the latest
    origin. Without one it is the message of the next smaller turn. Rows with the same conversation and turn are one node
    (its latest parent counts) but stay rows of their own. Null conversations form one conversation, a null turn comes
    first, a null text is empty. Empty passages link nothing. An empty table gives an empty result.
    """
    kinds = dict(messages.dtypes)
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("null"))).withColumn("at", F.coalesce("turn", F.lit(-(1 << 62))))
    schema = f"conv {kinds[conv_col]}, turn long, role {kinds[role_col]}, key string, at long, own string, found array<struct<level:int,hash:string,chars:int>>"
    parsed = cut(rows.select("conv", "turn", "role", "key", "at", "text").mapInPandas(read, schema))
    said = parsed.select("key", "at", F.explode("found").alias("p")).select("key", "at", "p.*")
    # Of each passage in a conversation, who wrote it last before a quote of it: no pair of rows is ever made.
    quoted = said.where("level > 0").select("key", "hash").distinct()
    # Turns are dealt to stretches, so that a line that a long conversation repeats is not ranked in one task: each stretch
    # gets the last writer of the stretches before it, and looks for a later one among its own.
    own_at = F.when(F.col("level") == 0, F.col("at"))
    # The quoted passages are named once for each stretch, so that the rows of a line that a long conversation repeats are
    # dealt before they meet them.
    said = said.withColumn("stretch", F.floor(F.col("at") / stretch))
    places = said.select("key", "stretch").distinct()
    quoted = quoted.join(places, "key")
    said = said.join(quoted, ["key", "hash", "stretch"], "left_semi")
    before = Window.partitionBy("key", "hash").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = said.groupBy("key", "hash", "stretch").agg(F.max(own_at).alias("last")).withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    earlier = Window.partitionBy("key", "hash", "stretch").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = said.withColumn("origin", F.last(own_at, ignorenulls=True).over(earlier)).join(carried, ["key", "hash", "stretch"])
    found = found.withColumn("origin", F.coalesce("origin", "carried")).where("level > 0 and origin is not null")
    by_quote = found.groupBy("key", "at").agg(F.max_by("origin", F.struct(-F.col("level"), "chars", "origin")).alias("parent"))
    nodes = cut(number_in_groups(parsed.select("key", "at").distinct(), ["key"], ["at"], "k"))
    before = nodes.select("key", F.col("at").alias("previous"), (F.col("k") + 1).alias("k"))
    linked = nodes.join(before, ["key", "k"], "left").join(by_quote, ["key", "at"], "left")
    kind = F.when(F.col("parent").isNotNull(), "quote").when(F.col("previous").isNotNull(), "order").otherwise("start")
    tree = cut(linked.select("key", "at", F.coalesce("parent", "previous").alias("parent"), kind.alias("link")))
    # Pointer jumping: each round doubles the distance, so a thread of n messages takes log2(n) rounds. Only messages that
    # haven't reached their thread's first one take part in a round; the others wait in the rows already settled.
    open_rows = cut(tree.select("key", "at", F.coalesce("parent", "at").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    settled, open_rows = open_rows.where("depth = 0"), open_rows.where("depth > 0")
    while open_rows.limit(1).count():
        above = settled.select("key", F.col("at").alias("top"), F.col("top").alias("higher"), F.col("depth").alias("more"), F.lit(True).alias("ended"))
        above = above.unionAll(open_rows.select("key", "at", "top", "depth", F.lit(False)))
        moved = cut(open_rows.join(above, ["key", "top"]).select("key", "at", F.col("higher").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), "ended"))
        settled = settled.unionAll(moved.where("ended").drop("ended"))
        open_rows = moved.where("not ended").drop("ended")
    climb = settled
    placed = parsed.join(tree, ["key", "at"]).join(climb.select("key", "at", "top", "depth"), ["key", "at"])
    own = placed.select(
        "conv", "turn", "role", "key", "at", "link", "depth", "top", "own", "parent",
        F.size(F.filter("found", lambda p: p["level"] > 0)).alias("n_quotes"), F.sha2("own", 256).alias("own_sha256"),
    )
    out = number_in_groups(own, ["key", "top"], ["depth", "at", "role", "own_sha256"], "position")

    def turn(c: str):
        return F.when(F.col(c) > -(1 << 62), F.col(c))

    columns = [F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), turn("parent").alias("parent_turn"), "link", turn("top").alias("thread_turn"), "depth", "position", F.col("n_quotes").cast("long").alias("n_quotes"), F.length("own").cast("long").alias("own_chars"), "own_sha256"]
    if keep_text:
        columns += [F.col("own").alias("own_text"), F.concat(F.lit("<|"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.lit("|>\n"), F.col("own"), F.lit("\n")).alias("rendered")]
    return out.select(*columns)
