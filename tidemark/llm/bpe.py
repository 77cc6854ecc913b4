"""Byte-level BPE encoding and decoding with a given rank file.

The pieces that the pattern cuts a text into are encoded separately. Distinct pieces not met before are put into
matrices by length: one row a piece, padded. In each round every row looks up the merge of all its neighbouring
pairs in a hash table, merges the leftmost pair of the smallest rank, and closes the gap; rows in which nothing
merges leave the matrix. Pieces of more than `MATRIX` bytes, of which a matrix would take time by the square of their length, go
through a heap of pairs in the same order of merges.

Decoding looks up the bytes of each id. Defined results: a null or empty text has no ids; very long texts are taken one at a time; repeated rows are each answered; an
empty table gives an empty result; other columns are carried along, and those named like a result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textkit import held, scan

MATRIX = 256
#: Pieces kept between batches, and bytes of text taken together.
KNOWN, TOGETHER = 100_000, 1 << 20
NONE = np.int32(2**31 - 1)


class Merges:
    """Vocabulary of a rank file, and a hash table from a pair of ids to the id of the two together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            self.words[rank] = word
        self.byte = np.full(256, NONE, np.int32)
        for b in range(256):
            self.byte[b] = ranks.get(bytes([b]), NONE)
        left, right, made = [], [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                if (a := ranks.get(word[:cut])) is not None and (b := ranks.get(word[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(4, int(len(key) * 4).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.made = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):  # the first of those that want an empty slot gets it, others move on
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]] = key[todo[won]]
            self.made[slot[won]] = np.array(made, np.int32)[todo[won]]
            left_over = np.ones(len(todo), bool)
            left_over[won] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(todo))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the pair merged, or NONE; ids below 0 are padding."""
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).astype(np.uint64)
        slot, out = self._slot(key), np.full(key.shape, NONE, np.int32)
        open_ = (left >= 0) & (right >= 0)
        at = np.nonzero(open_)
        key, slot = key[at], slot[at]
        found = np.full(len(key), NONE, np.int32)
        live = np.arange(len(key))
        for _ in range(self.probes):
            here = self.keys[slot[live]]
            hit = here == key[live]
            found[live[hit]] = self.made[slot[live[hit]]]
            live = live[~hit & (here != np.uint64(2**64 - 1))]
            if not len(live):
                break
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
        out[at] = found
        return out

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Final ids of each row; ids < 0 pad at the right."""
        out: list = [None] * len(ids)
        rows = np.arange(len(ids))
        ids = ids.copy()
        rank = self.rank(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 0), NONE, np.int32)
        while len(rows):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    row = ids[k]
                    out[rows[k]] = row[row >= 0]
                ids, rank, rows, best, least = ids[~done], rank[~done], rows[~done], best[~done], least[~done]
                if not len(rows):
                    break
            lines = np.arange(len(rows))
            place = np.arange(ids.shape[1] - 1)[None, :]
            moved = np.where(place > best[:, None], ids[:, 1:], ids[:, :-1])  # the gap closes to the left
            moved[lines, best] = least
            shifted = np.full_like(rank, NONE)
            shifted[:, :-1] = np.where(place[:, :-1] > best[:, None], rank[:, 1:], rank[:, :-1])
            ids, rank = moved, shifted[:, :-1]
            if ids.shape[1] > 1:
                before = np.maximum(best - 1, 0)
                rank[lines, before] = np.where(best > 0, self.rank(ids[lines, before], ids[lines, before + 1]), rank[lines, before])
                after = np.minimum(best, ids.shape[1] - 2)
                fresh = self.rank(ids[lines, after], ids[lines, after + 1])
                rank[lines, after] = np.where(best < ids.shape[1] - 1, fresh, rank[lines, after])
                width = int((ids >= 0).sum(1).max())
                ids, rank = ids[:, : max(width, 1)], rank[:, : max(width - 1, 0)]
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges of one long piece, by a heap of (rank, place)."""
        n = len(ids)
        met: dict[tuple[int, int], int | None] = {}

        def pair(a: int, b: int) -> int | None:
            if (a, b) not in met:
                r = int(self.rank(np.array([a], np.int32), np.array([b], np.int32))[0])
                met[a, b] = None if r == NONE else r
            return met[a, b]

        after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        ask = lambda i: pair(ids[i], ids[after[i]]) if after[i] < n else None
        heap = [(r, i, 0) for i in range(n) if (r := ask(i)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, v = heapq.heappop(heap)
            if not alive[i] or version[i] != v:
                continue
            gone = after[i]
            ids[i], after[i], alive[gone] = r, after[gone], False
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    version[k] += 1
                    if (q := ask(k)) is not None:
                        heapq.heappush(heap, (q, k, version[k]))
        return [x for x, ok in zip(ids, alive) if ok]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for b in np.unique(bucket[lengths <= MATRIX]):
            group = np.flatnonzero((bucket == b) & (lengths <= MATRIX))
            for at in np.array_split(group, -(-len(group) // 8192)):
                width = int(lengths[at].max())
                flat = self.byte[np.frombuffer(b"".join(pieces[k] for k in at), np.uint8)]
                ids = np.full((len(at), max(width, 1)), -1, np.int32)
                ids[np.arange(ids.shape[1])[None, :] < lengths[at][:, None]] = flat
                for k, row in zip(at.tolist(), self.merge_rows(ids)):
                    out[k] = row.tolist()
        for k in np.flatnonzero(lengths > MATRIX).tolist():
            out[k] = self.merge_long(self.byte[np.frombuffer(pieces[k], np.uint8)].tolist())
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


class Codec:
    """Encodes and decodes texts; what distinct pieces become is kept between calls."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.pattern, self.known = merges, regex.compile(pattern), {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pattern.findall(t) for t in texts]
        fresh = list(set(chain.from_iterable(cut)).difference(self.known))
        if len(self.known) + len(fresh) > KNOWN:
            self.known = {}
            fresh = list(set(chain.from_iterable(cut)))
        self.known.update(zip(fresh, self.merges.encode([p.encode() for p in fresh])))
        known = self.known.__getitem__
        return [list(chain.from_iterable(map(known, pieces))) for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.words.__getitem__, ids))


class _Shared:
    """The merges of a rank file, broadcast (their size is that of the vocabulary), and a name for them."""

    def __init__(self, spark, path: str):
        ranks = read_ranks(path)
        self.id = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
        self.merges = spark.sparkContext.broadcast(Merges(ranks))

    def codec(self, pattern: str) -> Codec:
        return held(("bpe", self.id, pattern), lambda: Codec(self.merges.value, pattern))


def _together(column: pa.Array):
    part, size = [], 0
    for text in column:
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns unless given) with ids."""
    shared = _Shared(docs.sparkSession, path)

    def make() -> Callable:
        codec = shared.codec(pattern)
        return lambda column: [pa.array([ids for part in _together(column) for ids in codec.encode(part)], pa.list_(pa.int32()))]

    return scan(docs, text, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))], docs.columns if keep is None else keep)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", to: str = "text") -> DataFrame:
    """The column ids replaced by the decoded text (bytes that are not UTF-8 become U+FFFD)."""
    shared = _Shared(encoded.sparkSession, path)
    keep = [c for c in encoded.columns if c != ids]
    own = encoded.select(*(F.col("`" + c + "`") for c in keep), F.col(ids).alias("__ids"))
    schema = T.StructType([own.schema[c] for c in keep if c != to] + [T.StructField(to, T.StringType())])
    own = own.select(*(F.col("`" + c + "`") for c in keep if c != to), "__ids")

    def run(batches):
        codec = shared.codec("")
        for batch in batches:
            texts = [codec.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return own.mapInArrow(run, schema)


DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """keep with the number of ids, digests of the ids and of the bytes decoded from them, and the ids themselves if wanted."""
    shared = _Shared(docs.sparkSession, path)

    def make() -> Callable:
        codec = shared.codec(pattern)
        names = [str(k) for k in range(len(codec.merges.words))]

        def work(column: pa.Array) -> list[pa.Array]:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for part in _together(column):
                for ids in codec.encode(part):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, np.int32))
            made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            return [*made, pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else made

        return work

    return scan(docs, text, make, DIGEST + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []), docs.columns if keep is None else keep)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
