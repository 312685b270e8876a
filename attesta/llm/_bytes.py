"""Vectorised words and word hashes over Arrow text columns.

Everything works on the UTF-8 bytes of a whole batch, so no Python object is
made for a word. A word's hash is a polynomial over a random table of byte
values, taken mod 2**64 from prefix sums and then mixed.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; only a single longer word goes beyond.
_CHUNK = 1 << 20


def trim() -> None:
    """Give freed memory back to the machine; a worker lives for many tasks."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if give:
        give(0)


def task(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over a task's batches that leaves no freed memory behind."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POW = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        size = max(n, _CHUNK + 1)
        _POW.update(n=size, up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    return _POW["up"], _POW["down"]


_RANDOM = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32

#: Which bytes belong to words: all but white space, or all but ASCII signs.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass(frozen=True)
class Words:
    """Words of a batch: byte ranges, hashes, and where each row's words begin."""

    data: np.ndarray
    bounds: np.ndarray  # rows + 1 byte offsets into data
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # rows + 1 offsets into start

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its rows + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(column: pa.Array, within: np.ndarray = SPACED, lower: bool = True) -> Words:
    data, bounds = utf8(column)
    inside = within[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = bounds[:-1][bounds[:-1] < len(data)]
    opens = before[:-1].copy()
    opens[edge] = False
    start = np.flatnonzero(inside & ~opens)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    closes = after[1:].copy()
    closes[edge[edge > 0] - 1] = False
    end = np.flatnonzero(inside & ~closes) + 1
    return Words(data, bounds, start, end, _hashes(data, start, end, lower), np.searchsorted(start, bounds))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    table = _RANDOM[_LOWER] if lower else _RANDOM
    out = np.empty(len(start), _U)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(end, base + _CHUNK, "right")))
        s, e = start[at:to] - base, end[at:to] - base
        up, down = _tables(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, _U)
        np.cumsum(table[data[base : base + e[-1]]] * up[: e[-1]], out=sums[1:])
        out[at:to] = (sums[e] - sums[s]) * down[s]
        out[at:to] += (e - s).astype(_U) * _U(0xA0761D6478BD642F)
        at = to
    return mix(out)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words of the whole batch, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for i in range(k):
        out *= _U(0xE7037ED1A0B428DB)
        out += hashes[i : i + n]
    return mix(out)


def sliced(batch: pa.RecordBatch, text: str, limit: int = 8 << 20):
    """The batch in runs of rows with at most ``limit`` bytes of text each, a longer row alone."""
    _, bounds = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
