"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round finds, by binary search over sorted pair keys, the merge
rank of every adjacent pair, takes each word's lowest rank and merges all its occurrences from the left. Words whose
pairs are exhausted leave the array, so later rounds touch only what still changes. A bounded memo maps pre-tokens to
ids, so a frequent word is merged once per worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import SPACE, held, tokenizer_path

#: Splitting pattern of the byte-level vocabulary (fixed value of the format).
BYTE_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
#: Splitting pattern of the word vocabulary (fixed value of the format).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
#: The same patterns for texts of Latin-1 characters alone, which most texts are; the plainer engine is faster on them.
BYTE_LATIN = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9²³¹¼-¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
WORD_LATIN = re.compile(r"[a-zªµºß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
NO_RANK = np.int32(2**31 - 1)
MEMO_WORDS = 600_000
#: Longer words are not kept, so that the memo is bounded in bytes too.
MEMO_CHARS = 64
BATCH_CHARS = 500_000
#: Rows of an Arrow batch that are Python strings at a time.
SLICE_ROWS = 1000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Sorted pair keys with rank and product of each merge, and the symbols of single bytes."""

    def __init__(self, spec: str):
        doc = json.loads(spec)
        model = doc["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        if model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE without unknown token, byte fallback or prefix is supported")
        self.specials = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.specials.values()])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        signs = byte_alphabet()
        self.inner = np.array([vocab[c] for c in signs], dtype=np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in signs], dtype=np.int32)
        back = {c: b for b, c in enumerate(signs)}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token.removesuffix(self.suffix))
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the table of each pair, by binary search."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK), at.astype(np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has. No word may be empty."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        if self.suffix:
            sym[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        last = np.zeros(len(sym), dtype=bool)
        last[ends] = True
        rank = np.full(len(sym), NO_RANK, dtype=np.int32)
        at = np.zeros(len(sym), dtype=np.int32)
        pair = np.flatnonzero(~last)
        rank[pair], at[pair] = self.look_up(sym[pair], sym[pair + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
            counts = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            ended = np.repeat(least == NO_RANK, counts)
            if ended.any():
                done.append((word[ended], sym[ended]))
                go = ~ended
                sym, word, last, rank, at = sym[go], word[go], last[go], rank[go], at[go]
                counts, least = counts[least != NO_RANK], least[least != NO_RANK]
                if not len(sym):
                    break
            here = np.flatnonzero(rank == np.repeat(least, counts))
            if len(here) > 1:  # of overlapping occurrences, every second from the left
                first = np.concatenate(([True], np.diff(here) != 1))
                run = np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))
                here = here[(np.arange(len(here)) - run) % 2 == 0]
            sym[here] = self.made[at[here]]
            last[here] = last[here + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[here + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, last, rank, at = sym[keep], word[keep], last[keep], rank[keep], at[keep]
            here = place[here]
            rank[here] = NO_RANK
            stale = np.zeros(len(sym), dtype=bool)
            stale[here] = True
            stale[here[here > 0] - 1] = True
            fresh = np.flatnonzero(stale & ~last)
            rank[fresh], at[fresh] = self.look_up(sym[fresh], sym[fresh + 1])
        if not done:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(words), dtype=np.int64)
        of = np.concatenate([w for w, _ in done])
        order = np.argsort(of, kind="stable")
        return np.concatenate([s for _, s in done])[order].astype("<u4"), np.bincount(of, minlength=len(words))


class Encoder:
    """Texts to ids through a bounded memo of pre-tokens; ids are kept as little-endian unsigned 32-bit bytes."""

    def __init__(self, spec: str, memo_words: int = MEMO_WORDS):
        self.table, self.memo, self.old, self.memo_words = MergeTable(spec), {}, {}, memo_words
        self.lower = json.loads(spec).get("normalizer") is not None
        self.latin = (WORD_LATIN if self.lower else BYTE_LATIN).findall
        self.any = regex.compile(WORD_PATTERN if self.lower else BYTE_PATTERN).findall

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text, after the vocabulary's own normalisation."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.lower:
                text = unicodedata.normalize("NFC", text)
                text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
            return self.any(text)
        return self.latin(text.lower() if self.lower else text)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Merge words that the memo lacks, all in one call; it keeps all but long ones."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids, counts = self.table.merge(raw)
        data, bounds = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
        made = {w: data[a:b] for w, a, b in zip(words, [0, *bounds[:-1]], bounds)}
        self.memo.update((w, v) for w, v in made.items() if len(w) <= MEMO_CHARS)
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Strings of special tokens become their ids, as in the library."""
        special = self.table.special
        if len(self.memo) > self.memo_words // 2:  # two generations: words met again survive
            self.memo, self.old = {}, self.memo
        get, out, holes = self.memo.get, [], []
        for text in texts:
            parts = special.split(text) if special is not None and "<" in text else [text]
            ids: list = []
            for i, part in enumerate(parts):
                if i % 2:
                    ids.append(self.table.specials[part].to_bytes(4, "little"))
                    continue
                words = self.words(part)
                found = list(map(get, words))
                try:
                    ids.append(b"".join(found))
                except TypeError:  # a word that the memo lacks
                    base = len(ids)
                    holes += [(len(out), base + k, words[k]) for k, v in enumerate(found) if v is None]
                    ids += found
            out.append(ids)
        if holes:
            missing = {w for _, _, w in holes}
            made = {w: self.old[w] for w in missing & self.old.keys()}
            self.memo.update(made)
            missing -= made.keys()
            if missing:
                made |= self.learn(list(missing))
            for doc, at, word in holes:
                out[doc][at] = made[word]
        return [ids[0] if len(ids) == 1 else b"".join(ids) for ids in out]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters. Ids outside the vocabulary stand for nothing."""
        if self.lower:
            raise ValueError("the word vocabulary drops white space and can't be decoded")
        size, of = self.table.size, self.table.bytes_of
        nums = np.frombuffer(ids, dtype="<u4")
        if len(nums) and int(nums.max()) >= size:
            nums = nums[nums < size]
        return b"".join(map(of.__getitem__, nums.tolist())).decode("utf-8", "replace")


def coder_of(spec: str) -> Encoder:
    """The worker's encoder for a vocabulary: a reused Python worker keeps its table and memo."""
    return held(hashlib.sha256(spec.encode()).hexdigest(), lambda: Encoder(spec))


def sliced(batches):
    """Arrow batches in slices, so that few texts are held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def in_groups(texts: list, most_chars: int = BATCH_CHARS):
    """Slices of texts that hold about so many characters each; a longer text stands alone."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > most_chars:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again; one row per row of docs.

    Columns: the id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (array of int) and decoded.
    A null text counts as empty (no ids, the empty string). Null and repeated ids are passed through. Other columns of
    docs are not read. An empty table gives an empty result. No shuffle: rows stay in their partition.
    """
    with open(path or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        coder = coder_of(spec.value)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_sha, out_sha, ids_out, decoded = [], [], [], [], []
            for a, b in in_groups(texts):
                for ids in coder.encode(texts[a:b]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text = coder.decode(ids)
                    out_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids_out.append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                        decoded.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            if keep_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep_ids
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
