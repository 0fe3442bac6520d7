"""Numpy views of Arrow text: words, their hashes and n-grams, whole batches at a time.

All functions here run inside Spark tasks. A batch is handled in slices of a quarter of a
megabyte of text, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.array([0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7,
                  0xDB4F0B9175AE2165, 0xBBE0563303A4615F], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
_C = ctypes.CDLL(None)
if not hasattr(_C, "malloc_trim"):  # of glibc alone
    _C = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators) -> np.ndarray:
    """Maps A-Z to a-z, the separators to 0 and other bytes to themselves."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[x for x in separators]] = 0
    return table


SPACES = byte_table([0x20, *range(0x09, 0x0E)])


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of about ``most`` bytes of text, one row at least."""
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop
    give_back()


def give_back() -> None:
    """Memory that is free goes back to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _C is not None:
        _C.malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more at the end); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 19), base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[name] = np.cumprod(factors, dtype=np.uint64)
        if n > 16 * SLICE_BYTES:  # one very long text does not keep its table
            _powers.pop(name)
    return have[:n]


class Lookup:
    """A set of 64-bit hashes that many others are looked up in.

    The values are spread evenly, so their first bits say nearly where in their order a hash would be.
    """

    def __init__(self, values: np.ndarray):
        self.values = np.unique(np.asarray(values, dtype=np.uint64))
        size = int(len(self.values)).bit_length()
        self.bits, self.near = max(10, size + 5), max(8, size + 1)
        self.marks = np.zeros(1 << self.bits, bool)
        self.marks[self.values >> np.uint64(64 - self.bits)] = True
        counts = np.bincount((self.values >> np.uint64(64 - self.near)).astype(np.int64), minlength=1 << self.near)
        self.start = (np.cumsum(counts) - counts).astype(np.int32)
        self.steps = int(counts.max(initial=0))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes are in the set, and which of its values they are."""
        at = np.flatnonzero(self.marks[hashes >> np.uint64(64 - self.bits)])
        if not len(at):
            return at, at
        hash_, last = hashes[at], len(self.values) - 1
        value = self.start[hash_ >> np.uint64(64 - self.near)].astype(np.int64)
        for _ in range(self.steps - 1):
            value += (self.values[np.minimum(value, last)] < hash_) & (value < last)
        ok = self.values[value] == hash_
        return at[ok], value[ok]


class Words:
    """The words of a slice: ``doc`` (row of each), ``start``, ``end`` (bytes) and ``n`` per row."""

    def __init__(self, column: pa.Array, table: np.ndarray = SPACES):
        raw, self.at = utf8(column)
        self.bytes = table[raw]
        self._sums = None
        inside = self.bytes != 0
        first, last = inside.copy(), inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            border = self.at[(self.at > 0) & (self.at < len(raw))]
            first[border] = inside[border]
            last[border - 1] = inside[border - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = len(self.at) - 1
        before = np.searchsorted(self.start, self.at)
        self.first, self.n = before[:-1], np.diff(before)
        self.doc = np.repeat(np.arange(self.rows), self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes, the same on every machine."""
        return self._hash(self.start, self.end)

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``size`` bytes of the words that are longer, and those words."""
        at = np.flatnonzero(self.end - self.start > size)
        return self._hash(self.start[at], self.start[at] + size) ^ _GRAM[1], at

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.empty(0, np.uint64)
        size = len(self.bytes)
        if self._sums is None:
            terms = (self.bytes.astype(np.uint64) + np.uint64(1)) * _power("up", _PRIME, size)
            self._sums = np.zeros(size + 1, np.uint64)
            np.cumsum(terms, out=self._sums[1:])
        length = (end - start).astype(np.uint64)
        sums = self._sums[end] - self._sums[start]
        return mix(sums * _power("down", _INVERSE, size)[start] + length * _GRAM[0])

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside a row, and the word each begins with."""
        if len(hashes) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        count = len(hashes) - n + 1
        sums = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            sums += hashes[k:k + count] * _GRAM[k]
        inside = self.doc[:count] == self.doc[n - 1:]
        at = np.flatnonzero(inside)
        return mix(sums[at]), at
