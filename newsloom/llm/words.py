"""Vectorised word hashing over Arrow string columns.

The text of a batch is one byte buffer plus offsets. Words, their 64-bit hashes and the hashes of
consecutive words come from array operations over that buffer, so no Python object is made per word.
Equal words have equal hashes; two different words collide with probability 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POW[0]) < n:
        size = max(n, 2 * len(_POW[0]), CHUNK_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a fixed bijection, so no new collisions)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Separators of the shingle words, and of the benchmark words (all ASCII but digits and letters).
BLANKS = byte_class(bytes([32, *range(9, 14)]))
NON_WORD = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]


@dataclass
class Words:
    """Words of consecutive rows: row ``i`` owns words ``first[i]:first[i + 1]``."""

    rows: slice
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    total: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefix(self, k: int) -> np.ndarray:
        """Hash of the first ``k`` bytes of each word, 0 where the word is not longer."""
        end = np.minimum(self.start + k, self.end)
        h = mix((self.total[end] - self.total[self.start]) * _POW[1][self.start] + np.uint64(k))
        return np.where(self.end - self.start > k, h, np.uint64(0))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def row_chunks(offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of whole rows of about ``chunk_bytes`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk_bytes, "right")) - 1)
        yield slice(i, min(j, n))
        i = j


def words_of(col: pa.Array, separators: np.ndarray = BLANKS, lower: bool = True) -> Iterator[Words]:
    """Words of every row, some rows at a time; nothing is cut."""
    data, offsets = column_bytes(col)
    table = _LOWER_BYTE if lower else _BYTE
    for rows in row_chunks(offsets):
        lo, hi = int(offsets[rows.start]), int(offsets[rows.stop])
        part = data[lo:hi]
        bounds = offsets[rows.start:rows.stop + 1] - lo
        n = hi - lo
        inner = np.zeros(n + 2, bool)
        inner[1:-1] = ~separators[part]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        start = np.flatnonzero(inner[1:-1] & (~inner[:-2] | cut[:-1]))
        end = np.flatnonzero(inner[1:-1] & (~inner[2:] | cut[1:])) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[part] * power[:n], out=total[1:])
        yield Words(rows, np.searchsorted(start, bounds), start, end,
                    mix((total[end] - total[start]) * inverse[start]), part, total)


def ngram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values, also across rows (the caller drops those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j:j + n] * _STEP[j]
    return mix(out + np.uint64(k))


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, equal to ``ngram_hash`` of that length."""
    return ngram_hash(h, len(h))[0]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return x.view(np.int64)
