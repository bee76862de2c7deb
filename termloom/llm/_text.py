"""Vectorised scanning of string columns: words, lines and rolling hashes.

All functions work on the raw UTF-8 buffer of an Arrow string column, so no
Python object is made for a word.  Separators are ASCII bytes, which never
occur inside a multi-byte character.

Hashes are polynomials over uint64 with fixed random coefficients, finished by
a mixing step; hashing a range costs two lookups in a prefix sum.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes handled at a time; a longer document is handled alone.
CHUNK = 512 << 10


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, 1 << 63, dtype=np.uint64)) & ~7 | 5


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Poly:
    """Range hashes of one sequence after another.

    Powers come from two small tables, of low and of high exponents, so their
    memory does not depend on the length of a sequence.
    """

    STEP = 1 << 16

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers, self.inverses = (self._table(x, self.STEP) for x in (self.base, self.inverse))
        self.high, self.high_inverses = self._highs(16)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        x = np.full(n, base, U64)
        x[0] = 1
        return np.cumprod(x, dtype=U64)

    def _highs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self._table(pow(x, self.STEP, 1 << 64), n) for x in (self.base, self.inverse))

    def _reach(self, n: int) -> None:
        if n // self.STEP >= len(self.high):
            self.high, self.high_inverses = self._highs(2 * (n // self.STEP + 1))

    def _times(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The values, each times the power of its place."""
        out = np.empty(len(values), U64)
        for k, lo in enumerate(range(0, len(values), self.STEP)):
            part = values[lo : lo + self.STEP]
            np.multiply(part, low[: len(part)], out=out[lo : lo + self.STEP])
            if k:
                out[lo : lo + self.STEP] *= high[k]
        return out

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._reach(len(values))
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(self._times(values, self.powers, self.high), out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._reach(len(prefix))
        out = (prefix[end] - prefix[start]) * self.inverses[start & (self.STEP - 1)]
        if len(prefix) > self.STEP:
            out *= self.high_inverses[start >> 16]
        return mix(out)

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all k consecutive values."""
        self._reach(len(prefix))
        n = max(0, len(prefix) - k)
        return mix(self._times(prefix[k:] - prefix[:-k], self.inverses, self.high_inverses)) if n else np.zeros(0, U64)


_BYTES = np.random.default_rng(20240517).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]
byte_poly, word_poly, word_poly2 = Poly(11), Poly(12), Poly(13)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    raw, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(raw: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row."""
    inside = ~separator[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(raw))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs, "left")


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    prefix = byte_poly.prefix((_BYTES_LOWER if lower else _BYTES)[raw])
    return byte_poly.ranges(prefix, start, end)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def extended(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` followed by the columns of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def release() -> None:
    """Give memory that a worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of rows that are sent to a worker at a time, a single longer row aside, and rows that a reader decodes at a time.
BATCH, READ_ROWS = 4 << 20, 512
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` by workers that give their memory back, as they live on for other stages.

    Lowers the session's limit of the bytes of a batch to ``BATCH``, if it is
    higher: with the usual 10,000 rows, long texts would fill both sides' memory.
    Readers decode ``READ_ROWS`` rows at a time for the same reason.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_READ)) > READ_ROWS:
        conf.set(_READ, str(READ_ROWS))
    if not 0 < int(str(conf.get(_LIMIT)).rstrip("bB")) <= BATCH:
        conf.set(_LIMIT, str(BATCH))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)
