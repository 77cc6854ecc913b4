"""Benchmark decontamination: a hash set of normalised test n-grams is broadcast and every training token window is looked up in it.

Words are the runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Each window of
`n` words of an item, or all words of a shorter item, is a pattern; a document word inside any occurrence of a
pattern is hit. A hash match is a candidate only: the words themselves are compared before it counts.

Only blocks of the benchmark of at most `block_bytes` of text are broadcast, which take about ten times as much when they are built. A larger benchmark is split by
item into such blocks and the documents pass through one scan for each, without a shuffle.

Defined results: a null or wordless text has no words, hits or items; a null or wordless item has no patterns; an
item with a null id marks words but is not listed; repeated rows are each answered; empty tables give empty
results or no hits; other columns are carried along, and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textkit import Words, scan, words_of

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Patterns:
    """The windows of some items, in flat arrays: by length, sorted hashes, the place of each pattern's words in one buffer, and its items.

    Patterns are equal if their words are; the hash only leads to them. Built, they take about 50 bytes a window besides the words themselves.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.names = [None if name is None else str(name) for name, _ in items]
        found: dict[int, list[tuple]] = {}
        text, end = [], 0
        for i, _, words in words_of(pa.array([t or "" for _, t in items], pa.large_string())):
            counts = words.counts()
            low = [words.text(int(words.first[r]), int(words.first[r + 1])) if counts[r] else b"" for r in range(words.rows)]
            base = end + np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int64)
            text += low
            end = int(base[-1])
            # Where each word begins in the buffer of words with one blank between.
            length = words.ends - words.starts
            begins = np.concatenate(([0], np.cumsum(length + 1)))[:-1] if len(words) else np.zeros(0, np.int64)
            begins = begins - begins[np.minimum(words.first[:-1], max(len(words) - 1, 0))][words.row] + base[:-1][words.row] if len(words) else begins
            for size in sorted({min(n, int(c)) for c in counts if c}):
                grams, whole = words.grams(size), words.whole(size)
                at = np.flatnonzero(whole)
                at = at[np.minimum(n, counts[words.row[at]]) == size]
                stop = at + size - 1
                found.setdefault(size, []).append((grams[at], begins[at], begins[stop] + length[stop], i + words.row[at]))
        self.text = b"".join(text)
        self.by_size = {size: self._sorted(*(np.concatenate(x) for x in zip(*parts))) for size, parts in found.items()}

    def _sorted(self, grams: np.ndarray, start: np.ndarray, stop: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hash, start, end, items from, items) of distinct patterns; of equal hashes with other words each is one."""
        order = np.lexsort((item, grams))
        grams, start, stop, item = grams[order], start[order], stop[order], item[order]
        first = np.ones(len(grams), bool)
        first[1:] = grams[1:] != grams[:-1]
        heads = np.flatnonzero(first)
        words = lambda k: self.text[start[k] : stop[k]]
        mixed = False
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(grams)).tolist()):
            if b - a > 1 and any(words(k) != words(a) for k in range(a + 1, b)):
                again = sorted(range(a, b), key=lambda k: (words(k), item[k]))
                grams[a:b], start[a:b], stop[a:b], item[a:b] = grams[again], start[again], stop[again], item[again]
                first[a:b] = [k == a or words(k) != words(k - 1) for k in range(a, b)]
                mixed = True
        heads = np.flatnonzero(first) if mixed else heads
        return grams[heads], start[heads], (stop - start)[heads].astype(np.int32), np.append(heads, len(grams)), item.astype(np.int32)

    def nbytes(self) -> int:
        """What is broadcast, without the items' names."""
        return len(self.text) + sum(x.nbytes for arrays in self.by_size.values() for x in arrays)

    def scanner(self) -> Callable[[Words], Iterator[tuple[int, int, set]]]:
        """Yields (first word, number of words, items) of every verified occurrence."""
        sieves = {}
        for size, (hashes, *_) in self.by_size.items():
            bits = min(22, max(10, 3 + len(hashes).bit_length()))
            sieves[size] = np.zeros(1 << bits, bool)
            sieves[size][hashes & np.uint64(sieves[size].size - 1)] = True

        def run(words: Words) -> Iterator[tuple[int, int, set]]:
            for size, (hashes, start, length, bounds, item) in self.by_size.items():
                grams, sieve = words.grams(size), sieves[size]
                if not len(grams):
                    continue
                near = np.flatnonzero(sieve[grams & np.uint64(sieve.size - 1)])
                near = near[words.row[near] == words.row[near + size - 1]]
                at = np.searchsorted(hashes, grams[near])
                sure = at < len(hashes)
                sure[sure] &= hashes[at[sure]] == grams[near[sure]]
                for k, e in zip(near[sure].tolist(), at[sure].tolist()):
                    said = words.text(k, k + size)
                    while e < len(hashes) and hashes[e] == grams[k]:  # other words of the same hash stand beside
                        if self.text[start[e] : start[e] + length[e]] == said:
                            yield k, size, {self.names[x] for x in item[bounds[e] : bounds[e + 1]].tolist()}
                        e += 1

        return run


def _merged(marks: np.ndarray) -> tuple[list[int], list[int]]:
    steps = np.diff(np.concatenate(([0], marks.view(np.int8), [0])))
    return np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()


def _worker(shared, remove: bool) -> Callable:
    def make() -> Callable:
        find = shared.value.scanner()

        def work(column: pa.Array, before: pa.Array | None = None, listed: pa.Array | None = None) -> list[pa.Array]:
            n_words, n_hit, spans, items, texts = [], [], [], [], []
            for i, j, words in words_of(column):
                marks = np.zeros(len(words), bool)
                own: dict[int, set] = {}
                for k, size, ids in find(words):
                    marks[k : k + size] = True
                    own.setdefault(int(words.row[k]), set()).update(ids)
                if before is not None:
                    for row in range(words.rows):
                        at = int(words.first[row])
                        for s in before[i + row].as_py() or ():
                            marks[at + s["start"] : at + s["end"]] = True
                        own.setdefault(row, set()).update(listed[i + row].as_py() or ())
                hit = np.concatenate(([0], np.cumsum(marks)))
                counts = hit[words.first[1:]] - hit[words.first[:-1]]
                n_words.append(words.counts())
                n_hit.append(counts)
                for row, c in enumerate(counts.tolist()):
                    at, to = int(words.first[row]), int(words.first[row + 1])
                    starts, ends = _merged(marks[at:to]) if c else ([], [])
                    spans.append([{"start": s, "end": e} for s, e in zip(starts, ends)])
                    items.append(sorted({x for x in own.get(row, ()) if x is not None}))
                    if remove:
                        body = words.data[words.offs[row] : words.offs[row + 1]].tobytes()
                        for s, e in zip(reversed(starts), reversed(ends)):
                            body = body[: words.starts[at + s] - words.offs[row]] + body[words.ends[at + e - 1] - words.offs[row] :]
                        texts.append(body.decode("utf-8", "replace") if column[i + row].is_valid else None)
            join = lambda parts: pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
            made = [join(n_words), join(n_hit), pa.array(spans, SPANS_ARROW), pa.array(items, pa.list_(pa.string()))]
            return [*made, pa.array(texts, pa.string())] if remove else made

        return work

    return make


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, n: int = 10, clean_text: str | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """keep (by default all columns) of docs with n_words, n_hit, spans (of words, from 0) and items; clean_text names a further column, the text without the spans."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("body")).where("body is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("body") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    split = bench.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(blocks)))
    out, more = docs, []
    for k in range(blocks):
        rows = [(r["item"], r["body"]) for r in split.where(F.col("block") == k).select("item", "body").collect()]  # bounded by block_bytes
        shared = spark.sparkContext.broadcast(Patterns(rows, n))
        last = k == blocks - 1
        fields = FIELDS + ([T.StructField(clean_text, T.StringType())] if last and clean_text else [])
        kept = [*keep, *([] if last or text in keep else [text])]
        out = scan(out, text, _worker(shared, bool(last and clean_text)), fields, kept, more=more)
        more = ["spans", "items"]
    return out


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with every hit span of words cut out of the text."""
    cols = docs.columns
    found = find_contamination(docs, benchmark, text=text, clean_text="__clean", keep=cols, **options)
    return found.select(*(F.col("__clean").alias(c) if c == text else F.col(c) for c in cols))


def drop_documents(docs: DataFrame, benchmark: DataFrame, *, max_hit_share: float = 0.0, **options) -> DataFrame:
    """The documents of which at most that share of words is hit, with their own columns."""
    own = {c: f"__own{k}" for k, c in enumerate(docs.columns)}
    text = options.pop("text", "text")
    renamed = docs.select(*(F.col("`" + c + "`").alias(x) for c, x in own.items()))
    found = find_contamination(renamed, benchmark, text=own[text], keep=list(own.values()), **options)
    return found.where(F.col("n_hit") <= F.col("n_words") * F.lit(max_hit_share)).select(*(F.col(x).alias(c) for c, x in own.items()))


def query(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, bench, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
pat as (
  select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') as g
  from (select item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i from b where len(ws) > 0)),
sizes as (select distinct n from pat),
win as (
  select doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') as g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, sizes)),
hit as (select distinct doc_id, i, win.n, item_id from win join pat on win.g = pat.g and win.n = pat.n),
words_hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by 1)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join words_hit using (doc_id) left join items using (doc_id)
"""
