"""Quality by ordinal cumulative-link regression on graded ratings.

A text has hashed features, each the square root of relative frequencies: 4-grams of character shapes (upper case,
lower case, digit, white space, each mark by itself), words, and words that repeat the one before. All grades share one weight vector w;
ordered thresholds t_1 < t_2 < ... part them: P(grade <= j) = sigmoid(t_j - w x). From these follow the expected
grade and, for selection, the tail probability P(grade >= j).

Grades are whole numbers. `graded` makes them of the table `labels`: 0 junk (quality 0), 1 fit but toxic, 2 fit and
clean.

Defined results: a null or empty text has no features, so the thresholds alone decide; with no labelled text the grades are {0} and
every expected grade is 0; with one grade, it is everyone's; repeated rows are each answered; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.sampling import fold, labelled_sample
from tidemark.llm.textkit import MULTIPLIER, Words, scan, words_of

SHAPE_BITS, WORD_BITS = 9, 10
WIDTH = (1 << SHAPE_BITS) + (1 << WORD_BITS) + 1
FIELDS = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.ArrayType(T.DoubleType()))]

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B], SHAPE[0x61:0x7B], SHAPE[0x30:0x3A], SHAPE[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")
SHAPE[[0x09, 0x0B, 0x0C, 0x0D]] = ord(" ")


def features(words: Words) -> np.ndarray:
    """rows x WIDTH, the blocks of shapes and words of unit length."""
    rows, shape = words.rows, SHAPE[words.data].astype(np.uint64)
    out = np.zeros((rows, WIDTH), np.float32)
    if len(shape) >= 4:
        code = shape[:-3] << np.uint64(24) | shape[1:-2] << np.uint64(16) | shape[2:-1] << np.uint64(8) | shape[3:]
        bucket = (code * np.uint64(MULTIPLIER) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)
        row = np.repeat(np.arange(rows), np.diff(words.offs))
        inside = row[:-3] == row[3:]
        counts = np.bincount((row[:-3] << SHAPE_BITS | bucket)[inside], minlength=rows << SHAPE_BITS).reshape(rows, -1)
        out[:, : 1 << SHAPE_BITS] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    counts = np.bincount(words.row << WORD_BITS | (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=rows << WORD_BITS).reshape(rows, -1)
    total = np.maximum(counts.sum(1), 1)
    out[:, 1 << SHAPE_BITS : -1] = np.sqrt(counts / total[:, None])
    again = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    out[:, -1] = np.sqrt(np.bincount(words.row[1:][again], minlength=rows) / total)
    return out


def _blocks(column: pa.Array):
    """Features of at most a few hundred rows at a time."""
    for _, _, words in words_of(column, limit=1 << 19):
        for i in range(0, words.rows, 512):
            j = min(words.rows, i + 512)
            if (i, j) == (0, words.rows):
                yield features(words)
            else:
                yield features(Words(words.data[words.offs[i] : words.offs[j]], words.offs[i : j + 1] - words.offs[i]))


class Scale:
    """Grades, shared weights and ordered thresholds."""

    def __init__(self, grades: np.ndarray, weight: np.ndarray, cuts: np.ndarray):
        self.grades, self.weight, self.cuts = grades, weight, cuts

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= each grade but the lowest)."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - (x @ self.weight)[:, None], -50, 50)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(x: np.ndarray, grade: np.ndarray, *, rounds: int = 300, rate: float = 0.1, decay: float = 2e-4) -> Scale:
    """Full-batch Adam on the likelihood; thresholds are a first one and positive steps."""
    grades = np.unique(grade).astype(float) if len(grade) else np.zeros(1)
    if len(grades) < 2:
        return Scale(grades, np.zeros(WIDTH, np.float32), np.zeros(0))
    n, k = len(grade), np.searchsorted(grades, grade)
    share = np.array([(k <= j).mean() for j in range(len(grades) - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    first, steps = cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))
    values = [np.zeros(x.shape[1], np.float32), first, steps]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, rounds + 1):
        weight, first, steps = values
        cuts = np.concatenate([first, first + np.cumsum(np.exp(steps))])
        eta = x @ weight
        upper = np.where(k < len(cuts), sigma(cuts[np.minimum(k, len(cuts) - 1)] - eta), 1.0)
        lower = np.where(k > 0, sigma(cuts[np.maximum(k - 1, 0)] - eta), 0.0)
        mass = np.maximum(upper - lower, 1e-9)
        d_up, d_low = upper * (1 - upper) / mass / n, lower * (1 - lower) / mass / n
        g_cuts = -np.bincount(k, d_up, len(grades))[:-1] + np.bincount(k, d_low, len(grades))[1:]
        g_steps = np.cumsum(g_cuts[::-1])[::-1][1:] * np.exp(steps)
        grads = [(x.T @ (d_up - d_low).astype(np.float32)) + decay * weight, np.array([g_cuts.sum()]), g_steps]
        for i, g in enumerate(grads):
            m = 0.9 * moments[i][0] + 0.1 * g
            v = 0.999 * moments[i][1] + 0.001 * g * g
            moments[i] = (m, v)
            values[i] = (values[i] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(values[i].dtype)
    weight, first, steps = values
    return Scale(grades, weight, np.concatenate([first, first + np.cumsum(np.exp(steps))]))


def _vectors() -> Callable:
    def work(column: pa.Array) -> list[pa.Array]:
        return [pa.array([row.tobytes() for x in _blocks(column) for row in x.astype(np.float16)], pa.binary())]

    return work


def graded(labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, grade) of the table labels."""
    return labels.select(key, F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, *, key: str = "doc_id", text: str = "text", grade: str = "grade", max_rows: int = 8_000, **options) -> Scale:
    """The scale of at most max_rows rated texts."""
    sample = labelled_sample(docs, ratings, key=key, text=text, label=grade, max_rows=max_rows)
    found = scan(sample, "text", lambda: _vectors(), [T.StructField("x", T.BinaryType())], ["label"]).toArrow()
    rows = sorted(zip(found["x"].to_pylist(), found["label"].to_pylist()))  # rows arrive in any order
    x = np.frombuffer(b"".join(v for v, _ in rows), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return fit(x, np.array([g for _, g in rows], float), **options)


def _worker(shared) -> Callable:
    def make() -> Callable:
        scale: Scale = shared.value

        def work(column: pa.Array) -> list[pa.Array]:
            tails = [scale.tails(x) for x in _blocks(column)]
            all_tails = np.concatenate(tails) if tails else np.zeros((0, len(scale.cuts)))
            return [pa.array(scale.expected(all_tails)), pa.array(list(all_tails), pa.list_(pa.float64()))]

        return work

    return make


def rate(docs: DataFrame, scale: Scale, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns unless given) with expected_grade and tail: P(grade >= g) for each grade above the lowest."""
    shared = docs.sparkSession.sparkContext.broadcast(scale)
    return scan(docs, text, _worker(shared), FIELDS, docs.columns if keep is None else keep)


def select(docs: DataFrame, scale: Scale, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with their own columns, whose chance to be above the lowest grade is at least `least`; all, if there is one grade."""
    if len(scale.grades) < 2:
        return docs
    own = {c: f"__own{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col("`" + c + "`").alias(x) for c, x in own.items()))
    rated = rate(renamed, scale, text=own[text])
    return rated.where(F.col("tail")[0] >= least).select(*(F.col(x).alias(c) for c, x in own.items()))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scale = train(docs, graded(labels.where(~fold("doc_id", 5, 0))))
    rated = rate(docs, scale, keep=["doc_id"])
    tail = lambda k: F.coalesce(F.get("tail", F.lit(k)), F.lit(0.0))
    return rated.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "expected_grade", tail(0).alias("p_fit"), tail(1).alias("p_clean"), (tail(0) >= 0.5).alias("selected"))
