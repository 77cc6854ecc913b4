"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to 3 is counted over a bounded sample of labelled texts and then
frozen. A byte's probability in a context that was followed by it c times of n, by q different bytes, is
c / (n + q); otherwise the escape q / (n + q) is paid and the next shorter context is asked, down to 1/256.
A context that a language never saw is skipped at no cost. The exact code length of the whole text is summed for
every language; the shortest wins and its share of the probability is the score.

The frozen trees are flattened into code lengths by (context, byte, language): all of them for orders 0 and 1, for orders 2 and 3
those of the bytes that some language saw in the context, and the escapes of each context for the rest. Every counted context
stays, and memory grows with what was seen only. `max_bytes` bounds the expected bytes of training text of one language.

Defined results: a text that is null or has no letter is `und` with score 0, as is every text when nothing can be learned; rows with a null
language or text teach nothing; equal code lengths go to the language first in order; repeated rows are each answered; an empty table
gives an empty result; other columns are carried along, and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.sampling import fold
from tidemark.llm.textkit import arrow_limits, buffers, held, scan, slices
from tidemark.shipping import ship

PAD = 0x0A
LETTER = regex.compile(r"\p{L}")
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]


def contexts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The three bytes before each byte, as a number; bytes before a text count as line feeds."""
    code, last = np.zeros(len(data), np.uint32), data
    for k in range(3):
        before = np.empty_like(last)
        before[1:] = last[:-1]
        before[starts] = PAD
        code |= before.astype(np.uint32) << np.uint32(8 * k)
        last = before
    return code


def _text_starts(offs: np.ndarray) -> np.ndarray:
    return offs[:-1][np.diff(offs) > 0]


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, code, n), code being a byte after the three before it."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            data, offs = buffers(batch.column(1).filter(pa.array(langs == lang)))
            for i, j in slices(offs):
                part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                if len(part):
                    code, n = np.unique(contexts(part, _text_starts(own)).astype(np.int64) << 8 | part, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


class Slots:
    """Places of 32-bit numbers in a sorted array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        h, left = self._hash(self.keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = left[self.slot[h[left]] < 0]
            self.slot[h[free]] = free
            left = left[self.slot[h[left]] != left]
            h[left] = (h[left] + 1) & (len(self.slot) - 1)

    def _hash(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int32)

    def find(self, code: np.ndarray) -> np.ndarray:
        """The place of each code, -1 if it has none."""
        h = self._hash(code)
        at = self.slot[h]
        other = np.flatnonzero((at >= 0) & (self.keys[at] != code)) if len(self.keys) else ()
        while len(other):
            h[other] = (h[other] + 1) & (len(self.slot) - 1)
            at[other] = here = self.slot[h[other]]
            other = other[(here >= 0) & (self.keys[here] != code[other])]
        return at


class Tables:
    """Code lengths of (context, byte) by language: of orders 0 and 1 in full, of 2 and 3 for the bytes seen in a context."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        size = len(counts)
        self.seen: list[tuple[Slots, np.ndarray, Slots, np.ndarray]] = []
        self.short = np.full((1, size), 8.0, np.float32)
        for order in range(4):
            low = (1 << 8 * (order + 1)) - 1
            each = [np.unique(code & low, return_inverse=True) for code, _ in counts]
            keys = np.unique(np.concatenate([here for here, _ in each])) if order > 1 else np.arange(low + 1)
            ctx = np.unique(keys >> 8)
            escape = np.zeros((len(ctx) + 1, size), np.float32)  # the last row is that of contexts that no language saw
            of = np.searchsorted(ctx, keys >> 8)
            cost = self.cost(keys.astype(np.uint32), order - 1)
            for lang, ((here, where), (_, n)) in enumerate(zip(each, counts)):
                count = np.bincount(where, n)
                own = np.searchsorted(ctx, here >> 8)
                total, kinds = np.bincount(own, count, len(ctx)), np.bincount(own, minlength=len(ctx))
                escape[:-1, lang] = np.where(kinds > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)
                cost[:, lang] += escape[of, lang]
                cost[np.searchsorted(keys, here), lang] = np.log2((total + kinds)[own] / count)
            if order > 1:
                self.seen.append((Slots(keys), cost, Slots(ctx), escape))
            else:
                self.short = cost

    def cost(self, code: np.ndarray, order: int = 3) -> np.ndarray:
        """Code lengths by language of bytes after contexts of that order."""
        if order < 2:
            return self.short[code & np.uint32(len(self.short) - 1)]
        code = code & np.uint32((1 << 8 * (order + 1)) - 1)
        keys, cost, ctx, escape = self.seen[order - 2]
        at = keys.find(code)
        out = cost[at]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            out[rest] = self.cost(code[rest], order - 1) + escape[ctx.find(code[rest] >> np.uint32(8))]
        return out


class Model:
    """Counts of (context, byte) by language; tables() flattens them."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.counts = counts
        self.id = hash((tuple(langs), *(int(n.sum()) for _, n in counts), *(int((c % 1000003 * n).sum()) for c, n in counts)))

    def tables(self) -> Tables:
        return Tables(self.counts)

    def bits(self, data: np.ndarray, offs: np.ndarray, tables: Tables) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        if len(data):
            starts = _text_starts(offs)
            cost = tables.cost(contexts(data, starts) << np.uint32(8) | data)
            out[np.diff(offs) > 0] = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", where: Column | None = None, key: str = "doc_id", max_bytes: int = 6_000_000) -> Model | None:
    """The model of the rows with text and language (and where holds); None if there are none."""
    spark = docs.sparkSession
    arrow_limits(spark)
    ship(spark)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if where is None else rows.where(where)
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r["n"]}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(x) for kind, n in sizes.items() for x in (kind, max_bytes / n)))
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000).select("lang", "text")
    counted = sample.mapInArrow(count_contexts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    found = np.array(counted["lang"].to_pylist(), object)
    code, n = counted["code"].to_numpy(), counted["n"].to_numpy()
    langs = sorted(set(found))
    if not langs:
        return None
    return Model(langs, [(code[found == x], n[found == x]) for x in langs])


def _worker(shared) -> Callable:
    def make() -> Callable:
        model = shared.value
        tables = held(("langid", model.id), model.tables) if model is not None else None

        def work(column: pa.Array) -> list[pa.Array]:
            data, offs = buffers(column)
            n = len(offs) - 1
            pred, score, rate = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan)
            for i, j in slices(offs, 1 << 19) if model is not None else ():
                part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                bits = model.bits(part, own, tables)
                best = bits.argmin(1)
                low = bits[np.arange(j - i), best]
                pred[i:j] = np.array(model.langs, object)[best]
                score[i:j] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                rate[i:j] = low / np.maximum(np.diff(own), 1)
            for k, text in enumerate(column.to_pylist()):
                if text is None or not LETTER.search(text):
                    pred[k], score[k] = "und", 0.0
            return [pa.array(pred, pa.string()), pa.array(score), pa.array(rate, from_pandas=True)]

        return work

    return make


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns unless given) with lang_pred, score and bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scan(docs, text, _worker(shared), FIELDS, docs.columns if keep is None else keep)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, where=F.col("doc_id").isNotNull() & ~fold("doc_id", 3, 1))
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")
