"""Token counts of a unigram model by dynamic programming over a trie of distinct pre-tokens.

Words of a batch that the memo lacks are inserted in a trie: sorted, they are its depth-first walk, and each word keeps
the states of the prefix it shares with the one before. A state holds the best forward score of a prefix and the number
of tokens on that path; it is computed once per shared prefix. The terminal states give the words' counts.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import in_groups
from .common import held, tokenizer_path

#: The sign that stands before each word (fixed value of the format).
START = "▁"
MEMO_WORDS = 400_000
#: Longer words are not kept, so that the memo is bounded in bytes too.
MEMO_CHARS = 64
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces with log probabilities. The file ranks its pieces by merge order and has no probabilities of its own, so
    they are assumed to follow Zipf's law of the rank: log p = -log(rank + 1) - log(sum of 1 / (rank + 1)). Counts are thus
    those of this unigram model over the file's pieces, not those that the file's own merges would give."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(plain))))
    return [(model.id_to_piece(i), -math.log(k + 1) - total) for k, i in enumerate(plain)]


class Counter:
    """Counts tokens of words; a character that no piece covers costs its UTF-8 bytes in tokens."""

    def __init__(self, pieces: list[tuple[str, float]], memo_words: int = MEMO_WORDS):
        self.tails: dict[str, float | None] = {}  # every tail of a piece; with its score if it is a piece
        for piece, _ in pieces:
            for i in range(len(piece)):
                self.tails.setdefault(piece[i:], None)
        self.tails.update(pieces)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.memo_words = memo_words

    def walk(self, words: list[str]) -> list[int]:
        """Token counts of sorted distinct words; among paths of equal score the one with fewer tokens counts."""
        score, count, out, before, tails = [0.0], [0], [], "", self.tails
        for word in words:
            text = START + word
            keep, most = 0, min(len(text), len(before))
            while keep < most and text[keep] == before[keep]:
                keep += 1
            del score[keep + 1 :], count[keep + 1 :]
            for end in range(keep + 1, len(text) + 1):
                best, tokens = -math.inf, 0
                at = end - 1
                while at >= 0:
                    piece = text[at:end]
                    if piece not in tails:
                        break
                    own = tails[piece]
                    if own is not None:
                        s, n = score[at] + own, count[at] + 1
                        if s > best or s == best and n < tokens:
                            best, tokens = s, n
                    at -= 1
                if tails.get(text[end - 1]) is None:
                    s, n = score[end - 1] + self.unknown, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                    if s > best or s == best and n < tokens:
                        best, tokens = s, n
                score.append(best)
                count.append(tokens)
            out.append(count[-1])
            before = text
        return out

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens and words of each text."""
        if len(self.memo) > self.memo_words // 2:
            self.memo, self.old = {}, self.memo
        get, split = self.memo.get, [t.split() for t in texts]
        found = [list(map(get, words)) for words in split]
        holes = [(d, k, split[d][k]) for d, counts in enumerate(found) if None in counts for k, v in enumerate(counts) if v is None]
        if holes:
            missing = {w for _, _, w in holes}
            made = {w: self.old[w] for w in missing & self.old.keys()}
            new = sorted(missing - made.keys())
            made.update(zip(new, self.walk(new)))
            self.memo.update((w, n) for w, n in made.items() if len(w) <= MEMO_CHARS)
            for d, k, word in holes:
                found[d][k] = made[word]
        return list(map(sum, found)), list(map(len, split))


def counter_of(pieces: bytes) -> Counter:
    """The worker's counter for a vocabulary: a reused Python worker keeps its memo."""
    return held(hashlib.sha256(pieces).hexdigest(), lambda: Counter(pickle.loads(pieces)))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of each whole text under the unigram model of load_pieces; one row per row of docs.

    Columns: the id, n_tokens (of that model's best path, not of the vocabulary's own merges), n_words. Words are runs without white space, each with the start sign before it. A null
    or empty text has none. Null and repeated ids are rows of their own. Rows stay in their partition; other columns are
    not read; an empty table gives an empty result.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(pickle.dumps(load_pieces(path or tokenizer_path("piece_bpe_32k.model"))))
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        counter = counter_of(pieces.value)
        for batch in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens, words = [], []
            for a, b in in_groups(texts):
                t, w = counter.count(texts[a:b])
                tokens += t
                words += w
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], names=[id_col, "n_tokens", "n_words"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_words long")
