"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters: their vectors, rotated by place,
are multiplied. A text's vector bundles (adds) the vectors of its n-grams, a language's prototype bundles the unit
vectors of its sample texts, and the prediction is the prototype of largest cosine. Bundling is linear, so a batch of
texts is counted into a matrix of texts by n-grams and multiplied once with the n-gram vectors. Lower-case Latin-1 letters
have the first codes and a table; every other letter has a code and a vector of its own, made when it is met. Texts with
such letters have too many n-grams for a table: theirs are sorted, and added up text by text where a matrix is too large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .bpe import in_groups
from .common import bounded_sample, crc_mod, free_name, give_back, release

SYMBOLS = 64
#: One more than the largest code.
CODES = SYMBOLS + 0x110000
#: Largest matrix of texts by n-grams, and the n-grams whose vectors are added up at once.
MATRIX = 1 << 22
GRAMS = 1 << 12
GROUP_CHARS = 250_000
GROUP_TEXTS = 256
PIECE_CHARS = 1_000_000
#: Rows of a batch whose texts are lower-cased at a time.
SLICE_ROWS = 512
UNKNOWN = "und"


def letter_codes() -> np.ndarray:
    """Code of each code point, its own for every letter: 0 for what is no letter, under SYMBOLS for lower-case Latin-1."""
    codes = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        if chr(point).isalpha():
            codes[point] = SYMBOLS + point
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    for k, point in enumerate([*range(0xDF, 0xF7), *range(0xF8, 0x100)]):
        codes[point] = 27 + k
    return codes


_CODES: list[np.ndarray] = []


def codes() -> np.ndarray:
    if not _CODES:
        _CODES.append(letter_codes())
    return _CODES[0]


class Letters:
    """Vectors of letters by code, rotated by turn; those outside the table are drawn by seed and code."""

    def __init__(self, table: np.ndarray, turn: int, seed: int):
        self.table, self.turn, self.seed, self.shape = np.roll(table, turn, axis=1), turn, seed, table.shape
        self.made: dict[int, np.ndarray] = {}

    def one(self, code: int) -> np.ndarray:
        if code < SYMBOLS:
            return self.table[code]
        if code not in self.made:
            bits = np.random.default_rng((self.seed, code)).integers(0, 2, size=self.shape[1], dtype=np.int8)
            self.made[code] = np.roll(bits * 2 - 1, self.turn)
        return self.made[code]

    def __getitem__(self, code) -> np.ndarray:
        if np.ndim(code) == 0:
            return self.one(int(code))
        if not len(code) or code.max() < SYMBOLS:
            return self.table[code]
        distinct, at = np.unique(code, return_inverse=True)
        return np.stack([self.one(c) for c in distinct.tolist()])[at]


@dataclass(frozen=True)
class Space:
    """Letter vectors by seed; dim is the number of components."""

    dim: int = 1024
    seed: int = 7

    def letters(self) -> tuple[Letters, Letters, Letters]:
        """Vectors of the first, second and third letter of an n-gram: rotated by two, by one and not at all."""
        base = np.random.default_rng(self.seed).integers(0, 2, size=(SYMBOLS, self.dim), dtype=np.int8) * 2 - 1
        return Letters(base, 2, self.seed), Letters(base, 1, self.seed), Letters(base, 0, self.seed)


def bundle(texts: list[str | None], letters: tuple[Letters, Letters, Letters]) -> np.ndarray:
    """The bundled vector of each text; zero for texts without letters."""
    out = np.zeros((len(texts), letters[0].shape[1]), dtype=np.float32)
    for at in range(0, len(texts), SLICE_ROWS):
        bundle_slice(texts[at : at + SLICE_ROWS], letters, out[at : at + SLICE_ROWS])
    return out


def bundle_slice(texts: list[str | None], letters: tuple[Letters, Letters, Letters], out: np.ndarray) -> None:
    """Adds each text's vector to its row of out. A long text is cut into pieces that know the letters beside them."""
    pieces, owner, inner = [], [], []
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for at in range(0, len(low), PIECE_CHARS):
            left, right = int(at > 0), int(at + PIECE_CHARS < len(low))
            pieces.append(low[at - left : at + PIECE_CHARS + right])
            owner.append(i)
            inner.append((left, right))
    for a, b in in_groups(pieces, GROUP_CHARS):
        for lo in range(a, b, GROUP_TEXTS):
            part = slice(lo, min(b, lo + GROUP_TEXTS))
            np.add.at(out, owner[part], bundle_group(pieces[part], letters, inner[part]))


def bundle_group(texts: list[str], letters: tuple[Letters, Letters, Letters], inner: list[tuple[int, int]]) -> np.ndarray:
    """Vectors of pieces; inner tells of each how many characters at its ends belong to the pieces beside it."""
    joined = "\0" + "\0".join(texts) + "\0"
    code = codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    size = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    centre = code[1:-1] != 0
    for (left, right), end in zip(inner, np.cumsum(size).tolist()):
        if right:
            centre[end - 2] = False
    for (left, right), start in zip(inner, (np.cumsum(size) - size).tolist()):
        if left:
            centre[start] = False
    middle = np.flatnonzero(centre)
    if not len(middle):
        return np.zeros((len(texts), letters[0].shape[1]), dtype=np.float32)
    owner = doc[middle].astype(np.int64)
    base = SYMBOLS if code.max() < SYMBOLS else CODES
    wide = code.astype(np.int64)
    gram = (wide[middle] * base + wide[middle + 1]) * base + wide[middle + 2]
    if base == SYMBOLS:
        seen = np.flatnonzero(np.bincount(gram, minlength=SYMBOLS**3))
        column = np.zeros(SYMBOLS**3, dtype=np.int32)
        column[seen] = np.arange(len(seen))
        column = column[gram]
    else:
        seen, column = np.unique(gram, return_inverse=True)
    if len(texts) * len(seen) > MATRIX:
        return add_grams(seen, column, owner, len(texts), base, letters)
    counts = np.bincount(owner * len(seen) + column, minlength=len(texts) * len(seen))
    return counts.reshape(len(texts), len(seen)).astype(np.float32) @ gram_vectors(seen, base, letters).astype(np.float32)


def gram_vectors(grams: np.ndarray, base: int, letters: tuple[Letters, Letters, Letters]) -> np.ndarray:
    first, second, third = letters
    return first[grams // base**2] * second[grams // base % base] * third[grams % base]


def add_grams(seen: np.ndarray, column: np.ndarray, owner: np.ndarray, texts: int, base: int, letters: tuple[Letters, Letters, Letters]) -> np.ndarray:
    """Sums of n-gram vectors by text, owner being in order, without a matrix of texts by n-grams."""
    out = np.zeros((texts, letters[0].shape[1]), dtype=np.float32)
    for lo in range(0, len(owner), GRAMS):
        mine = owner[lo : lo + GRAMS]
        start = np.flatnonzero(np.diff(mine, prepend=-1))
        out[mine[start]] += np.add.reduceat(gram_vectors(seen[column[lo : lo + GRAMS]], base, letters), start, axis=0, dtype=np.int32)
    return out


@dataclass(frozen=True)
class Model:
    """Languages in order and their unit prototypes."""

    langs: list[str]
    prototypes: np.ndarray
    space: Space


def fit(docs: DataFrame, where=None, space: Space = Space(), per_lang: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn prototypes from a sample: per_lang texts at most of every language there is.

    where is a condition on rows that may be learned from. Rows with null text or language teach nothing. With no such
    row the model knows no language and every text is of unknown language.
    """
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label")).where("text is not null and label is not null")
    sample = bounded_sample(rows, per_lang)

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        letters, sums = space.letters(), {}
        for frame in frames:
            vectors = bundle(frame["text"].tolist(), letters)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
            for lang, at in frame.groupby("label").indices.items():
                sums[lang] = sums.get(lang, 0) + vectors[at].sum(axis=0, dtype=np.float64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    def add(key, table):
        rows = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        rows = rows[np.lexsort(rows.T[::-1])]  # a fixed order of summation
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "v": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    # Sums are added by language on the executors; the driver gets one vector of each language, which the model holds.
    shares = sample.select("text", F.col("label").cast("string").alias("label")).mapInPandas(add_up, "lang string, v array<double>")
    sums = {r.lang: np.array(r.v) for r in shares.groupBy("lang").applyInArrow(add, "lang string, v array<double>").collect()}
    langs = sorted(k for k, v in sums.items() if np.linalg.norm(v) > 0)
    protos = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs], dtype=np.float32).reshape(len(langs), space.dim)
    return Model(langs, protos, space)


def predict(model: Model):
    """A column function: whole text to struct(lang, score); score is the cosine, 0 at least."""

    @pandas_udf("lang string, score double")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        letters = model.space.letters()
        for texts in series:
            langs, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            for lo in range(0, len(texts) if model.langs else 0, SLICE_ROWS):
                vectors = bundle([t if isinstance(t, str) else None for t in texts.iloc[lo : lo + SLICE_ROWS]], letters)
                norms = np.linalg.norm(vectors, axis=1)
                known = np.flatnonzero(norms > 0)
                if len(known):
                    cosine = (vectors[known] / norms[known, None]) @ model.prototypes.T
                    langs[lo + known] = np.array(model.langs, dtype=object)[cosine.argmax(axis=1)]
                    score[lo + known] = np.clip(cosine.max(axis=1), 0, 1)
            yield pd.DataFrame({"lang": langs, "score": score})
        give_back()

    return of


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """Predict each whole text's language; one row per row of docs.

    Columns: the id, held_out, lang_pred, score (0 to 1), in this order. Null texts and texts without a letter are
    `und` with score 0, as are all texts if the model knows no language; among equal cosines the first language by name
    wins. Null ids aren't held out. Rows stay in their partition; other columns are not read.
    """
    got = docs.select(F.col(id_col), F.coalesce(crc_mod(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"), predict(model)(F.col(text_col)).alias("p"))
    return got.select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def fit_on_fold(docs: DataFrame, folds: int = 3, held: int = 1, **options) -> Model:
    """Learn only from rows whose id falls outside the held-out fold."""
    return fit(docs, where=crc_mod(F.col(options.get("id_col", "doc_id")), folds) != held, **options)


def keep_known(docs: DataFrame, model: Model, least: float = 0.2, text_col: str = "text") -> DataFrame:
    """Rows whose language is known with a cosine of least or more; the columns of docs are kept as they are."""
    p = predict(model)(F.col(text_col))
    name = free_name(docs, "language of row")
    return docs.withColumn(name, p).where((F.col(f"`{name}`.lang") != UNKNOWN) & (F.col(f"`{name}`.score") >= least)).drop(name)
