"""Array-at-a-time text primitives shared by the operators: no Python object per word or byte.

Texts arrive as Arrow columns; :func:`chunks` hands out runs of whole texts as one byte buffer
with offsets, so temporaries stay a small multiple of ``CHUNK_BYTES`` (or of one long text).
Hashes are polynomial in 64-bit arithmetic with a random byte table, from prefix sums, so that the
hash of any slice costs O(1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads each bit of ``x`` over the whole word."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept and grown by doubling)."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 12)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        grown = []
        with np.errstate(over="ignore"):
            for base in (_BASE, inverse):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                grown.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (grown[0], grown[1])
    return _powers[0][:n], _powers[1][:n]


class Slices:
    """Hashes of slices of a token array (bytes or word hashes)."""

    def __init__(self, tokens: np.ndarray):
        values = _TABLE[tokens] if tokens.dtype == np.uint8 else tokens
        up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * up[:-1], dtype=np.uint64, out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._sums[end] - self._sums[start]) * self._down[start]

    def grams(self, width: int) -> np.ndarray:
        """Raw hashes of all slices of ``width`` tokens, in order of their start."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self._sums[width:] - self._sums[:n]) * self._down[:n]


def slice_hash(slices: Slices, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes that also tell slices of different lengths apart."""
    with np.errstate(over="ignore"):
        return mix(slices.raw(start, end) ^ ((end - start).astype(np.uint64) * _GOLD))


@dataclass
class Chunk:
    """Rows [first, last) of a batch: their bytes joined without separators, and offsets."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def binary(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls are empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return bounds, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    bounds, data = binary(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield Chunk(first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text of a chunk."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_IS_SPACE[data]
    joined = solid[1:] & solid[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    joined[inner - 1] = False
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~joined
    stops[:-1] &= ~joined
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def words(chunk: Chunk, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word bounds per text, starts and ends in bytes."""
    data = _LOWER[chunk.data] if lower else chunk.data
    starts, ends = edges(data, chunk.bounds)
    hashes = slice_hash(Slices(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, chunk.bounds), starts, ends


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def ids(column) -> np.ndarray:
    """An id column as int64; a null id is the smallest long (see ``NULL_ID``)."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(column.cast(pa.int64()), NULL_ID))


NULL_ID = -(1 << 63)


def ids_back(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NULL_ID)
