"""Spelling of words found by ``words``, and keys of whole texts' groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes from each start to its end as strings, A-Z in lower case."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[at]])).cast(pa.string())


def codes(seen: dict[tuple, int], *columns: pa.Array) -> np.ndarray:
    """Which distinct row of some columns each row is; ``seen`` numbers those met so far and grows."""
    return np.array([seen.setdefault(r, len(seen)) for r in zip(*(c.to_pylist() for c in columns), strict=True)], np.int64)


def number_of(text: str) -> int:
    """A fixed 64-bit number for a text."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
