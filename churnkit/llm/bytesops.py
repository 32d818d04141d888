"""NumPy helpers over the UTF-8 bytes of an Arrow text column.

A batch's texts lie one after the other in one byte buffer, so hashes of all
words or k-grams of many documents come from a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240501)
#: One random number per byte value, and an odd base with its inverse modulo 2**64.
BYTE_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).view(U64) * U64(2) + U64(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
#: True for bytes of words: everything but space and \t \n \v \f \r.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, U64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x ^ U64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as doubles in [0, 1)."""
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string or binary array without nulls, no copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def blocks(offsets: np.ndarray, target: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``target`` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix_sums(data: np.ndarray, table: np.ndarray = BYTE_TABLE) -> np.ndarray:
    """P with P[e] - P[s] = sum of table[data[t]] * BASE**t over s <= t < e."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair, equal for equal bytes wherever they lie."""
    inv = powers(BASE_INV, len(sums))
    return mix((sums[end] - sums[start]) * inv[start])


def word_spans(data: np.ndarray, doc_offsets: np.ndarray, is_word: np.ndarray = WORD_BYTE):
    """Start, end (bytes) of every word and the index of its document."""
    inside = is_word[data]
    n = len(data)
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    if n:
        before[0] = False
        before[doc_offsets[:-1][doc_offsets[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    if n:
        after[-1] = False
        ends = doc_offsets[1:]
        after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(doc_offsets, start, side="right") - 1
    return start, end, doc


def runs(values: np.ndarray) -> np.ndarray:
    """First index of every run of equal neighbours."""
    if len(values) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
