"""Tokenising whole Arrow text batches with numpy, a bounded chunk of rows at a time.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Word, affix and
n-gram hashes come from one prefix array of a polynomial hash modulo 2**64, so
hashing any byte range is two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ np.uint64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Chunk:
    """Rows ``first`` to ``last`` of a text column: bytes, word bounds and hashes.

    ``start``/``end`` bound each word in ``data``; ``row`` is its row within the
    chunk; ``offset`` bounds each row's bytes. Null texts have no bytes.
    """

    def __init__(self, first: int, raw: np.ndarray, offset: np.ndarray) -> None:
        self.first, self.raw, self.offset = first, raw, offset
        self.rows = len(offset) - 1
        self.data = LOWER[raw]
        inside = ~SEPARATOR[raw]
        n = len(raw)
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        edges = offset[:-1][offset[:-1] < n]
        before[edges] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        ends = offset[1:][offset[1:] > 0] - 1
        after[ends] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offset, self.start, side="right") - 1
        self._prefix: np.ndarray | None = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of lower-cased byte ranges."""
        if self._prefix is None:
            power, _ = _power_tables(len(self.data))
            self._prefix = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * power[: len(self.data)], dtype=np.uint64, out=self._prefix[1:])
        _, inverse = _power_tables(len(self.data))
        return mix((self._prefix[end] - self._prefix[start]) * inverse[start] + (end - start).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def has_digit(self) -> np.ndarray:
        count = np.concatenate(([0], np.cumsum(DIGIT[self.data])))
        return count[self.end] > count[self.start]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


def chunks(column: pa.Array | pa.ChunkedArray, budget: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``budget`` bytes, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, positions, data = column.buffers()
    at = np.frombuffer(positions, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if column.null_count:  # what a null slot's range holds is undefined
        length = np.where(np.asarray(column.is_valid()), np.diff(at), 0)
        if not np.array_equal(length, np.diff(at)):
            column = column.fill_null("")
            yield from chunks(column, budget)
            return
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + budget, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Chunk(first, bytes_[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def rows_of(column: pa.Array, first: int, rows: int) -> Chunk:
    """The given rows of a string column as one chunk."""
    c = next(chunks(column.slice(first, rows), 2**62))
    return Chunk(first, c.raw, c.offset)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
