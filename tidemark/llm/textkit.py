"""Vectorised text scanning shared by the operators of this subpackage.

Every scanner works on the raw UTF-8 buffer of an Arrow string column, in slices of a bounded
number of bytes, so that memory follows the slice (or the one longest text), not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shipping import ship

SLICE_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

#: Bytes of a word once A-Z is lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of a word between white space: [^\x20\x09-\x0D].
GRAPHIC = np.ones(256, bool)
GRAPHIC[0x20] = GRAPHIC[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; a table of one slice is kept, longer ones are not."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.empty(max(n, SLICE_BYTES + 64), np.uint64)
        table[0] = 1
        done, step = 1, base
        while done < len(table):  # doubles the known part each time
            more = min(done, len(table) - done)
            np.multiply(table[:more], np.uint64(step), out=table[done : done + more])
            step = step * step % (1 << 64)
            done += more
        if len(table) <= 2 * SLICE_BYTES:
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a slice: starts and ends in its bytes, row of each, and 64-bit hashes of lower-cased bytes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray = ALNUM, hashes: bool = True):
        n = len(data)
        self.data, self.offs, self.rows = data, offs, len(offs) - 1
        inside = table[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offs, self.starts, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        if hashes:
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, n)[:n], out=sums[1:])
            self._sums = sums
            self.hash = self._hash(self.ends) if n else np.zeros(0, np.uint64)

    def _hash(self, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[self.starts]) * powers(INVERSE, len(self.data))[self.starts])

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the first n bytes of each longer word."""
        if not len(self):
            return self.row, self.hash
        longer = self.ends - self.starts > n
        hashes = mix(self._hash(np.minimum(self.ends, self.starts + n)) ^ np.uint64(n))
        return self.row[longer], hashes[longer]

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, lower-cased, one blank between."""
        low = LOWER[self.data[self.starts[i] : self.ends[j - 1]]].tobytes()
        at = self.starts[i]
        return b" ".join(low[s - at : e - at] for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist()))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that would leave the text are meaningless."""
        if len(self) < n:
            return np.zeros(0, np.uint64)
        last = len(self) - n + 1
        acc = self.hash[:last].copy()
        for k in range(1, n):
            acc *= np.uint64(MULTIPLIER)
            acc += self.hash[k : k + last]
        return mix(acc)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one text."""
        last = max(0, len(self) - n + 1)
        return self.row[:last] == self.row[n - 1 : n - 1 + last]


def words_of(column: pa.Array, table: np.ndarray = ALNUM, limit: int = SLICE_BYTES, hashes: bool = True) -> Iterator[tuple[int, int, Words]]:
    data, offs = buffers(column)
    for i, j in slices(offs, limit):
        yield i, j, Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], table, hashes)


_held: dict = {}


def held(key, build: Callable):
    """What build() makes, kept between the tasks of a Python worker until something else is wanted: one thing at a time, so that a worker that serves many stages stays small."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Hand memory that a task has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_limits(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, unless the session says otherwise."""
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(8 << 20))):
        try:
            if usual is None or spark.conf.get(key) == usual:
                spark.conf.set(key, value)
        except Exception as e:  # a Spark without that setting
            if "CONFIG_NOT_AVAILABLE" not in str(e) and "SQL_CONF_NOT_FOUND" not in str(e):
                raise


def scan(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: list[T.StructField], keep: list[str], *, more: list[str] = ()) -> DataFrame:
    """The columns keep of df, and fields that a function makes from the text column (and from the columns more) batch by batch.

    make() is called once in each task. A kept column whose name a field has is replaced by it.
    """
    names = {f.name for f in fields}
    kept = [c for c in dict.fromkeys(keep) if c not in names]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    source = df.select(*(quoted(c) for c in kept), quoted(text).cast("string").alias("__text"), *(quoted(c).alias(f"__more{k}") for k, c in enumerate(more)))
    schema = T.StructType([source.schema[c] for c in kept] + list(fields))
    n = len(kept)
    arrow_limits(df.sparkSession)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            made = work(batch.column(n), *(batch.column(k) for k in range(n + 1, n + 1 + len(more))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *made], names=[f.name for f in schema])
            del batch, made
        release()

    return source.mapInArrow(run, schema)
