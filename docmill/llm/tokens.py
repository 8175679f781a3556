"""Words of UTF-8 bytes as 64-bit hashes, with NumPy: no Python object for each word."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

WHITE_BYTES = np.zeros(256, bool)
WHITE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and the bytes of other characters.
OUTSIDE_WORDS = np.array([not (chr(b).isalnum() or b >= 0x80) if b < 0x80 else False for b in range(256)])

_RANDOM = np.random.default_rng(20)


def odd(n: int) -> np.ndarray:
    """``n`` fixed random odd numbers."""
    return _RANDOM.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_NEAR, _FAR = odd(4096), odd(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of a well-known public hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values.  By sorting: NumPy's own way may hash, at ten times the time and memory for millions of keys."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))]


def bounds(raw: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that ``outside`` does not mark."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = outside[raw]
    change = np.flatnonzero(gap[1:] != gap[:-1])
    return change[::2], change[1::2]


def _values(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of all words in a row: their keyed values, their places in their words, and where each word begins."""
    sizes = ends - begins
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    value = (raw[at + np.repeat(begins, sizes)].astype(np.uint64) + np.uint64(1)) * _NEAR[at & 4095]
    if len(at) and at.max() > 4095:
        value *= _FAR[(at >> 12) & 4095]
    return value, at, first


def hashed_words(data: bytes, outside: np.ndarray, stem: int | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """A hash for each word; with ``stem`` also one for its first so many bytes."""
    raw = np.frombuffer(data, np.uint8)
    begins, ends = bounds(raw, outside)
    if not len(begins):
        none = np.empty(0, np.uint64)
        return none if stem is None else (none, none)
    value, at, first = _values(raw, begins, ends)
    whole = mix(np.add.reduceat(value, first) ^ (ends - begins).astype(np.uint64))
    if stem is None:
        return whole
    value[at >= stem] = 0
    return whole, mix(np.add.reduceat(value, first))


def hashed_texts(texts: list[bytes], outside: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, stems, first): hashes of all words of ``texts`` in a row, and where each text begins (one more than there are texts)."""
    words, stems = hashed_words(b"\0".join(texts), outside, stem)
    raw = np.frombuffer(b"\0".join(texts), np.uint8)
    begins, _ = bounds(raw, outside)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, stems, np.searchsorted(begins, at)
