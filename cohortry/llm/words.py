"""Words and hashes of whole texts, computed on the UTF-8 bytes of an Arrow batch.

A word is a run of bytes other than space, tab, LF, VT, FF and CR. All functions work on a slice of
documents at a time, so the arrays stay small whatever the size of the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _give_back() -> None:
    """Return freed memory to the machine: a worker waits for its next task beside others that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(step: Callable) -> Callable:
    """A step over Arrow batches or tables that leaves no freed memory with the worker."""

    @functools.wraps(step)
    def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        _give_back()

    @functools.wraps(step)
    def over_one(table: pa.Table) -> pa.Table:
        out = step(table)
        _give_back()
        return out

    @functools.wraps(step)
    def over_two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = step(left, right)
        _give_back()
        return out

    names = step.__code__.co_varnames[: step.__code__.co_argcount]
    return over_batches if names == ("batches",) else over_one if len(names) == 1 else over_two


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    start = np.uint64((seed * 0xD1342543DE82EF95 + 1) & _MASK)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = _BASE, pow(_BASE, -1, 1 << 64)
    up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    return _powers(max(SLICE_BYTES, 1 << (n - 1).bit_length() if n > 1 else 1))


_BYTE = constants(7, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[where[0] : where[-1]] if len(where) else raw[:0], where - where[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of some documents: where each starts and ends, its hash, and the first word of each document."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n + 1: words of document d are first[d] to first[d + 1]
    total: np.ndarray  # running hash over the bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """For each word the number of its document."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, *, lower: bool = False, letters: np.ndarray | None = None) -> Words:
    """Words of the documents whose bytes are ``data`` with ``offsets`` (starting at 0).

    ``letters`` marks the bytes that words are made of, where that is not every byte but white space.
    """
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data] if letters is None else letters[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] |= inside[edges]
    ends = inside[:n] & ~inside[1:]
    ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    return Words(start, end, hashed, np.searchsorted(start, offsets), total)


def prefixes(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first ``size`` bytes of every longer word, and the index of the word."""
    at = np.flatnonzero(found.end - found.start > size)
    start = found.start[at]
    _, down = powers(len(found.total))
    return mix((found.total[start + size] - found.total[start]) * down[start] + np.uint64(size)), at


def windows(found: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within one document, and the index of its first word."""
    n = len(found.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    scale = constants(11 + seed, size)
    acc = found.hash[:n] * scale[0]
    for k in range(1, size):
        acc += found.hash[k : k + n] * scale[k]
    last = np.repeat(found.first[1:], found.counts)[:n]
    at = np.flatnonzero(np.arange(n) + size <= last)
    return mix(acc[at]), at
