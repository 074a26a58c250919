"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of a text (shares of character classes, repeated words and lines, lengths) are standardised and mapped to
cosines of random projections, whose inner products approximate a Gaussian kernel. Each partition of the sample sums
its share of the normal equations; the driver adds these small matrices and solves for ridge weights. The scores of
sample rows that the ridge didn't see are calibrated to probabilities by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .bpe import in_groups
from .common import crc_mod, cut, free_name, give_back, release, smallest_hashes

#: Character classes: lower-case letter, upper-case letter, digit, space, symbol, exclamation mark, other mark.
LOWER, UPPER, DIGIT, SPACE, SYMBOL, BANG, MARK = range(7)
SYMBOL_SIGNS = "#*$%&|<>"
STATISTICS = 16
#: Tasks that share the bounded sample.
SAMPLE_TASKS = 8
#: Rows of a batch that are measured at a time.
SLICE_ROWS = 1000
GROUP_CHARS = 500_000
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    if not _CLASSES:
        of = np.full(0x110000, MARK, dtype=np.uint8)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                of[point] = UPPER if c.isupper() else LOWER
            elif c.isnumeric():
                of[point] = DIGIT
            elif c.isspace():
                of[point] = SPACE
        of[[ord(c) for c in SYMBOL_SIGNS]] = SYMBOL
        of[ord("!")] = BANG
        _CLASSES.append(of)
    return _CLASSES[0]


def statistics(texts: list[str | None]) -> np.ndarray:
    """Statistics of each whole text; a null text counts as empty, and an empty one has zeros."""
    out = np.zeros((len(texts), STATISTICS))
    plain = [t if isinstance(t, str) else "" for t in texts]
    classes = char_classes()
    for a, b in in_groups(plain, GROUP_CHARS):
        part = plain[a:b]
        points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        doc = np.repeat(np.arange(len(part), dtype=np.int64), sizes)
        counts = np.bincount(doc * 7 + classes[points], minlength=7 * len(part)).reshape(-1, 7)
        words = np.zeros((len(part), 6))
        for i, t in enumerate(part):
            w = t.split()
            if not w:
                continue
            lines = [x for x in t.split("\n") if x and not x.isspace()]
            triples = len(set(zip(w, islice(w, 1, None), islice(w, 2, None))))
            words[i] = len(w), len(set(w)), sum(map(eq, w, islice(w, 1, None))), len(lines), len(lines) - len(set(lines)), max(0, len(w) - 2 - triples)
        n, distinct, again, lines, same, loops = words.T
        chars, some = np.maximum(sizes, 1), np.maximum(n, 1)
        letters = counts[:, LOWER] + counts[:, UPPER]
        share = counts / chars[:, None]
        out[a:b] = np.column_stack([
            np.log1p(n), np.log1p(lines), letters / chars, share[:, SPACE], share[:, MARK],
            np.sqrt(share[:, SYMBOL]), np.sqrt(share[:, BANG]), np.sqrt(share[:, DIGIT]),
            np.sqrt(counts[:, UPPER] / np.maximum(letters, 1)), (sizes - counts[:, SPACE]) / some / 10,
            np.sqrt(again / some), distinct / some, np.sqrt(same / np.maximum(lines, 1)), np.log1p(n / np.maximum(lines, 1)),
            np.sqrt(loops / some), n > 0,
        ])
    return out


@dataclass(frozen=True)
class Features:
    """Standardisation and random projections; small arrays that every task gets."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.frequency + self.phase
        return np.column_stack([np.cos(z) * np.sqrt(2 / self.frequency.shape[1]), np.ones(len(x))])


@dataclass(frozen=True)
class Model:
    """score(statistics) gives calibrated probabilities; without labels they are all the same."""

    features: Features | None
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), float(self.levels[0]))
        return np.interp(self.features(x) @ self.weights, self.knots, self.levels)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean score of each block) and levels (its mean label), both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of scores, sum of labels, rows
    for s, y in zip(score[order], label[order]):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], np.clip(b[:, 1] / b[:, 2], 0, 1)


def fit(docs: DataFrame, labels: DataFrame, where=None, features: int = 384, width: float = 0.18, ridge: float = 0.3, sample: int = 12_000, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from a bounded sample of labelled rows: the `sample` ids of smallest hash among those that where allows.

    where is a condition on the labels' id column. An id labelled more than once has the mean of its labels, an id with
    more than one text is learned from its smallest one; null ids and labels teach nothing. With no labelled text every
    score is 0.5, with labels of one kind every score is that label.
    """
    known = labels if where is None else labels.where(where)
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    chosen = smallest_hashes(known.groupBy("id").agg(F.avg("label").alias("label")), sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    @pandas_udf("array<double>")
    def measured(series: pd.Series) -> pd.Series:
        return pd.Series(list(statistics(series.tolist())))

    known = cut(rows.select("id", "label", measured("text").alias("x")))
    moments = known.select("label", F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("label").alias("a"), F.max("label").alias("b")).orderBy("k").collect()
    if not moments or moments[0].a == moments[0].b:
        return Model(None, np.zeros(0), np.zeros(0), np.array([moments[0].a if moments else 0.5]))
    rng = np.random.default_rng(seed)
    scale = np.array([r.s if r.s and r.s > 1e-9 else 1.0 for r in moments])
    to = Features(np.array([r.m for r in moments]), scale, rng.normal(0, width, size=(STATISTICS, features)), rng.uniform(0, 2 * np.pi, features))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the partition's share of (Z'Z, Z'y)."""
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            if batch.num_rows:
                z = to(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                total += z.T @ np.column_stack([z, batch.column(0).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g"])

    def add(key, table):
        rows = table.column("g").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        rows = rows[np.lexsort(rows.T[::-1])]  # a fixed order of summation
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    held = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(4)) == 0
    # Shares are added by row on the executors, so that the driver receives one system whatever the partitions.
    shares = known.where(~held).select("label", "x").coalesce(SAMPLE_TASKS).mapInArrow(equations, "i int, g array<double>")
    system = np.array([r.g for r in sorted(shares.groupBy("i").applyInArrow(add, "i int, g array<double>").collect())])
    a, b = system[:, :-1], system[:, -1]
    penalty = np.full(features + 1, ridge)
    penalty[-1] = 1e-6
    weights = np.linalg.solve(a + np.diag(penalty), b)
    rest = known.where(held).select("label", "x").toPandas()
    if rest.empty:
        rest = known.select("label", "x").toPandas()
    knots, levels = isotonic(to(np.array(rest["x"].tolist())) @ weights, rest["label"].to_numpy())
    return Model(to, weights, knots, levels)


def scorer(model: Model):
    """A column function: whole text to score."""

    @pandas_udf("double")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        for texts in series:
            parts = [statistics(texts.iloc[lo : lo + SLICE_ROWS].tolist()) for lo in range(0, len(texts), SLICE_ROWS)]
            yield pd.Series(model.score(np.concatenate(parts)) if parts else [], dtype="float64")
        give_back()

    return of


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each whole text; one row per row of docs.

    Columns: the id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from threshold on). A null text is
    scored as the empty one. Null ids aren't held out. Rows stay in their partition; other columns are not read.
    """
    got = docs.select(F.col(id_col), F.coalesce(crc_mod(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"), scorer(model)(F.col(text_col)).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_on_fold(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **options) -> Model:
    """Learn only from labels whose id falls outside the held-out fold."""
    return fit(docs, labels, where=crc_mod(F.col(options.get("id_col", "doc_id")), folds) != held, **options)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows that score threshold or more; the columns of docs are kept as they are."""
    name = free_name(docs, "score of row")
    return docs.withColumn(name, scorer(model)(F.col(text_col))).where(F.col(f"`{name}`") >= threshold).drop(name)
