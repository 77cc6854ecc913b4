"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and of the beginnings (`START` bytes) of longer ones, hashed into 2 ** `bits` buckets. The inputs x are the `terms` buckets that part the labels of a bounded training
sample best (chi-square of presence, in at least `min_docs` texts), and those of the `pool` most frequent others that do so in a pair, by what presence of both tells beyond
that of each, if chance would hardly do it among so many pairs:

    score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),

so that pairs of terms, such as an insult with the mention of a group, weigh beyond their single weights. Presence is
not divided by length: one insult in a very long text counts as in a short one.

Defined results: a null, empty or wordless text has the score of the bias alone; with no labelled text, or one label only, every score is
the smoothed share of label 1; repeated rows are each answered; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.sampling import fold, labelled_sample
from tidemark.llm.textkit import Words, scan, words_of

FIELDS = [T.StructField("score", T.DoubleType())]
START = 5


def terms_of(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term."""
    row, hashes = words.beginnings(START)
    rows, all_ = np.concatenate([words.row, row]), np.concatenate([words.hash, hashes])
    return rows, (all_ & np.uint64((1 << bits) - 1)).astype(np.int64)


class Machine:
    """Chosen buckets, weights and factors."""

    def __init__(self, bits: int, chosen: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bits, self.chosen, self.bias, self.weight, self.factor = bits, chosen, bias, weight, factor

    def margin(self, x: np.ndarray) -> np.ndarray:
        mixed = x @ self.factor
        return self.bias + x @ self.weight + 0.5 * (mixed**2 - (x * x) @ self.factor**2).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def _buckets(bits: int) -> Callable:
    def make() -> Callable:
        def work(column: pa.Array) -> list[pa.Array]:
            lists: list[np.ndarray] = []
            for _, _, words in words_of(column):
                row, bucket = terms_of(words, bits)
                key = np.unique(row.astype(np.int64) << bits | bucket)
                cuts = np.searchsorted(key >> bits, np.arange(words.rows + 1))
                own = (key & ((1 << bits) - 1)).astype(np.int32)
                lists += [own[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            return [pa.array(lists, pa.list_(pa.int32()))]

        return work

    return make


def paired(lists: list[np.ndarray], label: np.ndarray, buckets: np.ndarray, bits: int, chance: float = 0.01) -> np.ndarray:
    """Those of the buckets that are in a pair whose joint presence tells of the label what the two alone do not.

    Of texts with both, the share of label 1 is held against what a model without their interaction gives: the log-odds of each alone, added.
    A pair counts if its chi-square is beyond what `chance` leaves for the best of all pairs.
    """
    place = np.full(1 << bits, -1)
    place[buckets] = np.arange(len(buckets))
    flat, doc = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = place[flat]
    x = np.zeros((len(lists), len(buckets)), np.float32)
    x[doc[at >= 0], at[at >= 0]] = 1
    n, ones = len(label), float(label.sum())
    seen, hits = x.sum(0, dtype=np.float64), label.astype(np.float32) @ x
    both, joint = (x.T @ x).astype(np.float64), ((x * label[:, None].astype(np.float32)).T @ x).astype(np.float64)
    cells = {(1, 1): (both, joint), (1, 0): (seen[:, None] - both, hits[:, None] - joint), (0, 1): (seen[None, :] - both, hits[None, :] - joint), (0, 0): (n - seen[:, None] - seen[None, :] + both, ones - hits[:, None] - hits[None, :] + joint)}
    odds = {k: np.log((h + 0.5) / (np.maximum(m - h, 0) + 0.5)) for k, (m, h) in cells.items()}
    spread = sum(1 / (h + 0.5) + 1 / (np.maximum(m - h, 0) + 0.5) for m, h in cells.values())
    beyond = (odds[1, 1] - odds[1, 0] - odds[0, 1] + odds[0, 0]) ** 2 / spread
    np.fill_diagonal(beyond, 0)
    pairs = max(1, len(buckets) * (len(buckets) - 1) // 2)
    least = 2 * math.log(pairs / chance)  # the tail of a chi-square of one degree is below exp(-x / 2)
    return buckets[beyond.max(1, initial=0) > least]


def fit(lists: list[np.ndarray], label: np.ndarray, *, bits: int = 18, terms: int = 512, pool: int = 1_024, factors: int = 4, min_docs: int = 3, rounds: int = 120, rate: float = 0.1, decay: float = 5e-4, thin: float = 0.8, seed: int = 7) -> Machine:
    """Chi-square choice of terms, then full-batch Adam on the logistic loss.

    In each round a text of label 1 shows that share of its terms, drawn at random, so that few of them suffice.
    """
    n, share = len(label), (label.sum() + 0.5) / (len(label) + 1)
    none = Machine(bits, np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    if n == 0 or label.min() == label.max():
        return none
    flat = np.concatenate([*lists, np.zeros(0, np.int32)])
    doc = np.repeat(np.arange(n), [len(x) for x in lists])
    seen = np.bincount(flat, minlength=1 << bits).astype(float)
    hits = np.bincount(flat, label[doc], 1 << bits)
    gain = n * (hits - seen * label.mean()) ** 2 / np.maximum(seen * (n - seen) * label.mean() * (1 - label.mean()), 1e-9)
    gain[(seen < min_docs) | (seen == n)] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[:terms])
    chosen = chosen[gain[chosen] > 0]
    often = np.where((seen >= min_docs) & (seen < n), seen, 0)
    often = np.sort(np.argsort(-often, kind="stable")[: min(pool, int((often > 0).sum()))])
    chosen = np.union1d(chosen, paired(lists, label, often, bits)) if len(often) > 1 else chosen
    if not len(chosen):
        return none
    place = np.full(1 << bits, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    at = place[flat]
    x[doc[at >= 0], at[at >= 0]] = 1
    rng = np.random.default_rng(seed)
    machine = Machine(bits, chosen, none.bias, np.zeros(len(chosen), np.float32), rng.normal(0, 0.05, (len(chosen), factors)).astype(np.float32))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (np.zeros(1), machine.weight, machine.factor)]
    ones, full = np.flatnonzero(label == 1), x[label == 1].copy()
    for step in range(1, rounds + 1):
        x[ones] = full * (rng.random(full.shape, np.float32) < thin)
        miss = (machine.score(x) - label).astype(np.float32) / n
        mixed = x @ machine.factor
        grads = [np.array([miss.sum()]), x.T @ miss + decay * machine.weight, x.T @ (miss[:, None] * mixed) - (x.T @ miss)[:, None] * machine.factor + decay * machine.factor]
        values = [np.array([machine.bias]), machine.weight, machine.factor]
        for k, (p, g) in enumerate(zip(values, grads)):
            m = 0.9 * moments[k][0] + 0.1 * g
            v = 0.999 * moments[k][1] + 0.001 * g * g
            moments[k] = (m, v)
            values[k] = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        machine.bias, machine.weight, machine.factor = float(values[0][0]), values[1].astype(np.float32), values[2].astype(np.float32)
    return machine


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, bits: int = 18, **options) -> Machine:
    """The machine of at most max_rows labelled texts."""
    sample = labelled_sample(docs, labels, key=key, text=text, label=label, max_rows=max_rows)
    found = scan(sample, "text", _buckets(bits), [T.StructField("terms", T.ArrayType(T.IntegerType()))], ["label"]).toArrow()
    lists = [x.values.to_numpy() if x.values is not None else np.zeros(0, np.int32) for x in found["terms"]]
    order = sorted(range(len(lists)), key=lambda k: (len(lists[k]), lists[k].tobytes()))  # rows arrive in any order
    return fit([lists[k] for k in order], np.array(found["label"].to_pylist(), float)[order] if order else np.zeros(0), bits=bits, **options)


def _worker(shared) -> Callable:
    def make() -> Callable:
        machine: Machine = shared.value
        place = np.full(1 << machine.bits, -1, np.int32)
        place[machine.chosen] = np.arange(len(machine.chosen))

        def work(column: pa.Array) -> list[pa.Array]:
            parts: Iterator = words_of(column)
            scores = []
            for _, _, words in parts:
                row, bucket = terms_of(words, machine.bits)
                at = place[bucket]
                row, at = row[at >= 0], at[at >= 0]
                rows = np.flatnonzero(np.bincount(row, minlength=words.rows))
                score = np.full(words.rows, machine.score(np.zeros((1, len(machine.chosen))))[0])
                for some in np.array_split(rows, max(1, len(rows) // 2048)):
                    x = np.zeros((len(some), len(machine.chosen)), np.float32)
                    line = np.searchsorted(some, row)
                    ok = line < len(some)
                    ok[ok] &= some[line[ok]] == row[ok]
                    x[line[ok], at[ok]] = 1
                    score[some] = machine.score(x)
                scores.append(score)
            return [pa.array(np.concatenate(scores) if scores else np.zeros(0))]

        return work

    return make


def score(docs: DataFrame, machine: Machine, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns unless given) with the score."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return scan(docs, text, _worker(shared), FIELDS, docs.columns if keep is None else keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = train(docs, labels.where(~fold("doc_id", 5, 0)))
    scored = score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
