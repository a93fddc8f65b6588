"""Vectorised word splitting and hashing over Arrow string batches.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D).  As
UTF-8 never uses those bytes inside a character, working on bytes gives exactly
the words of ``[^\\x20\\x09-\\x0D]+``.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handled in blocks of about so many bytes; one longer text is a block of its own.
BLOCK_BYTES = 1 << 18

_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
WORD_BASE_2 = 0xA0761D6478BD642F
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


@dataclass
class Words:
    """The words of a block of texts: byte spans, and each text's range of words."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@cache
def _power_table(base: int, size: int) -> np.ndarray:
    p = np.full(size, base, dtype=_U)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1).  Tables up to that of a block are kept; a longer text's is made for it alone."""
    size = 1 << max(16, int(n - 1).bit_length())
    return (_power_table if size <= 2 * BLOCK_BYTES else _power_table.__wrapped__)(base, size)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past, bytes, offsets) of runs of texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))])
    first, n = 0, len(texts)
    while first < n:
        past = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        past = min(n, max(past, first + 1))
        # Only the block's own rows are copied, so a batch is never held twice.
        block = pc.fill_null(texts.slice(first, past - first), "").cast(pa.large_string())
        at = np.frombuffer(block.buffers()[1], dtype=np.int64)[block.offset : block.offset + past - first + 1]
        data = np.frombuffer(block.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
        yield first, past, data, at - at[0]
        first = past


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        before[inner] = True
        after[inner - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Sum of values[i] * base**(i - start) over each span, from one running sum."""
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * powers(base, len(values)), out=total[1:]) if len(values) else None
    back = powers(inverse(base), len(values) + 1)
    return (total[ends] - total[starts]) * back[starts]


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    return mix(span_hashes(_BYTE_VALUE[w.data], w.starts, w.ends, _BYTE_BASE) + (w.ends - w.starts).astype(_U))


def rolling_hashes(h: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hashes of all runs of n values; len(h) - n + 1 of them."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=_U)
    at = np.arange(count)
    return mix(span_hashes(h, at, at + n, base))


def sequence_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's whole sequence of words."""
    n = np.diff(bounds).astype(_U)
    one = mix(span_hashes(h, bounds[:-1], bounds[1:], WORD_BASE) + n)
    two = mix(span_hashes(mix(h), bounds[:-1], bounds[1:], WORD_BASE_2) + n)
    return one, two


def inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 runs of n words lie within one text."""
    count = total - n + 1
    if count <= 0:
        return np.zeros(0, dtype=bool)
    ok = np.ones(count, dtype=bool)
    for b in bounds[1:-1]:
        ok[max(0, b - n + 1) : b] = False
    return ok


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
