"""Vector bin packing of tokenised examples into training sequences.

An example asks for a vector of resources: tokens, one segment, loss-bearing tokens. A sequence offers a vector of
limits. The next piece for a sequence is the one that fits and has the largest dot product of its demand with what the
sequence has left, each in units of the limit. Where nothing fits any more, the waiting example of which most fits is cut
so that its head fills the rest. Instruction data bears loss on answers only: here the first line of a text of several
lines is its prompt and bears none, and a sequence takes fewer loss-bearing tokens than tokens, so prompts fill it up. Each task packs its own rows from a bounded pool, so there is no shuffle and at most one
sequence a task is left short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder_of, in_groups, sliced
from .common import tokenizer_path

POOL = 768
LEAST_CUT = 32
CHUNK_CHARS = 4_000_000


class Packer:
    """Sequences under three limits. place() yields (item, start, length, loss, sequence, offset) as pieces find room."""

    def __init__(self, tokens: int, segments: int, loss: int, least_cut: int = LEAST_CUT):
        if min(tokens, segments, loss) < 1:
            raise ValueError("each limit must be 1 at least")
        self.limits = np.array([tokens, segments, loss], dtype=np.float64)
        self.least_cut = least_cut
        self.sequence, self.left, self.fill = 0, self.limits.copy(), 0

    def close(self) -> None:
        if self.fill:
            self.sequence, self.left, self.fill = self.sequence + 1, self.limits.copy(), 0

    def put(self, item: int, start: int, length: int, loss: int):
        piece = (item, start, length, loss, self.sequence, self.fill)
        self.left -= (length, 1, loss)
        self.fill += length
        if self.left.min() <= 0 and (self.left[0] <= 0 or self.left[1] <= 0):
            self.close()
        return piece

    def place(self, lengths: np.ndarray, quiet: np.ndarray):
        """Pack items of these lengths, of which the first quiet[i] tokens bear no loss. The last sequence stays open."""
        need, still = lengths.astype(np.int64), np.minimum(quiet, lengths).astype(np.int64)
        start, loss, items = np.zeros(len(need), dtype=np.int64), need - still, np.arange(len(need))
        while len(items):
            left = self.left
            score = need * (left[0] / self.limits[0] ** 2) + loss * (left[2] / self.limits[2] ** 2) + left[1] / self.limits[1] ** 2
            score[(need > left[0]) | (loss > left[2])] = -1
            at = int(score.argmax())
            if score[at] >= 0:
                yield self.put(int(items[at]), int(start[at]), int(need[at]), int(loss[at]))
            else:  # the item of which most fits, then the longest
                rooms = np.minimum(np.minimum(left[0], left[2] + still), need)
                at = int((rooms * (1 << 40) + need).argmax())
                room, calm = int(rooms[at]), int(still[at])
                if room < min(self.least_cut, self.limits[0], self.limits[2]) and self.fill:
                    self.close()
                    continue
                yield self.put(int(items[at]), int(start[at]), room, max(0, room - calm))
                start[at] += room
                need[at] -= room
                still[at] = max(0, calm - room)
                loss[at] = need[at] - still[at]
                if need[at]:
                    continue
            keep = np.ones(len(items), dtype=bool)
            keep[at] = False
            items, start, need, still, loss = items[keep], start[keep], need[keep], still[keep], loss[keep]


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = 2048, max_segments: int = 32, max_loss: int = 2016, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", quiet_col: str | None = None, quiet_line: bool = True, keep_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with end_id and pack them; one row per piece.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and with keep_ids also ids.
    quiet_col may name a column with the number of leading ids that bear no loss (null: none), such as a prompt's length.
    Without it the first line of a text of several lines is its prompt, whose ids bear no loss, unless quiet_line is false.
    A null text counts as empty: one piece with the end id alone. Null and repeated ids are packed as rows of their own.
    Sequence ids are unique: task number times 2**32, plus a count. Other columns are not read; an empty table gives none.
    """
    with open(path or tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]
    end = int(end_id).to_bytes(4, "little")
    by_line = quiet_line and quiet_col is None

    def run(batches):
        coder, packer = coder_of(spec.value), Packer(max_tokens, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 32
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            quiets = np.array([max(0, q or 0) for q in batch.column(2).to_pylist()], dtype=np.int64)
            for a, b in in_groups(texts, CHUNK_CHARS):
                ids = []
                for c, d in in_groups(texts[a:b]):
                    some = texts[a + c : a + d]
                    if by_line:  # no pre-token goes over the end of a line
                        heads = [t[: t.find("\n") + 1] for t in some]
                        heads, tails = coder.encode(heads), coder.encode([t[len(h) :] for t, h in zip(some, heads)])
                        ids += [x + y + end for x, y in zip(heads, tails)]
                        quiets[a + c : a + d] = [len(x) // 4 for x in heads]
                    else:
                        ids += [x + end for x in coder.encode(some)]
                lengths = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
                rows, out = [], []
                for lo in range(0, len(ids), POOL):
                    rows += [(lo + i, *rest) for i, *rest in packer.place(lengths[lo : lo + POOL], quiets[a + lo : a + lo + POOL][: len(lengths) - lo])]
                item, start, length, loss, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*rows))
                cut = [memoryview(ids[i])[s * 4 : (s + n) * 4] for i, s, n in zip(item.tolist(), start.tolist(), length.tolist())]
                out = [batch.column(0).slice(a, b - a).take(pa.array(item)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(lengths[item]), pa.array(seq + base), pa.array(offset), pa.array(loss)]
                if keep_ids:
                    out.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in cut], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * keep_ids
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * keep_ids
    quiet = F.col(quiet_col).cast("long") if quiet_col else F.lit(0).cast("long")
    return docs.select(id_col, text_col, quiet.alias("quiet ids")).mapInArrow(run, schema)
