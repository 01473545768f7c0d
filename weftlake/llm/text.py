"""Words, word hashes and n-gram hashes of whole Arrow batches, in numpy.

A word is a run of ASCII letters and digits and of bytes from 0x80 on, after lower-casing; everything else separates.
All functions work on the UTF-8 bytes of many texts at once, in blocks of bounded size, so a text of any length costs
memory in proportion to its own words only.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.r_[U64(1), np.full(size, b, U64)]) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def buffers(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, and where each begins and ends; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the first word of each text (with the number of all at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    now, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(now[:n] & ~(before[:n] & ~cut[:n]))
    ends = np.flatnonzero(before[1:] & (~now[1:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * power[: hi - lo], out=total[1:])
        a = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[a]) * inverse[a]
        i = j
    return mix(out)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word hash, but for the last n - 1."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        out = out * U64(0xD1342543DE82EF95) + words[k : k + len(out)]
    return mix(out)


def blocks(texts: pa.Array, lower: bool = True, table: np.ndarray = WORD) -> Iterator[tuple]:
    """Consecutive texts of about BLOCK bytes: first and last+1 text, bytes,
    offsets, starts, ends, first word of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    size = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + BLOCK, "right")) - 1)
        data, off = buffers(texts.slice(i, j - i), lower)
        yield (i, j, data, off, *spans(data, off, table))
        i = j
    trim()


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


def trim() -> None:
    """Give freed memory back to the system, where that can be asked for: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)
