"""Texts as flat byte arrays: word boundaries, word hashes and shingle hashes without a Python loop per word.

A block is ``(buf, offsets)``: the UTF-8 bytes of some rows, one after the other, and where each begins. Words are
runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z; in UTF-8 those are the digits, the letters
a-z and every byte from 0x80, so that byte runs and character runs are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Of a raw byte, already lower-cased; 0 where it is no part of a word.
_WORD_BYTE = np.where(IS_WORD[LOWER], _BYTE[LOWER], np.uint64(0))
_RAW_WORD = IS_WORD[LOWER]

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (at least) of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, _INVERSE):
                a = np.full(size, np.uint64(base))
                a[0] = 1
                made.append(np.cumprod(a, dtype=np.uint64))
        _powers = tuple(made)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buf, offsets) of consecutive rows of at most ``limit`` bytes, or of one longer row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): where each word begins and ends; first[i] is the number of words before row i."""
    inside = _RAW_WORD[buf]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(buf))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (lower-cased) word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_WORD_BYTE[buf] * up[: len(buf)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_words(text: str | None) -> list[bytes]:
    """The words of one text, plainly; the reference for tests and for small query sets."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = words(raw, np.array([0, len(raw)]))
    low = LOWER[raw].tobytes()
    return [low[a:b] for a, b in zip(starts, ends)]


_SHINGLE = [np.uint64(x | 1) for x in (0x8C6F2A9D1B3E5F77, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x2545F4914F6CDD1D, 0xF1357AEA2E62A9C5)]


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words; a row of fewer words, but not none, is one shingle."""
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    left = first[1:][row] - np.arange(n)  # words from here to the end of the row
    with np.errstate(over="ignore"):
        for j in range(min(size, n)):
            m = _SHINGLE[j % 5] ^ np.uint64(2 * (j // 5) << 8)
            out[: n - j] += hashes[j:] * m if j == 0 else np.where(left[: n - j] > j, hashes[j:] * m, np.uint64(0))
    short = (count < size)[row]
    keep = (left >= size) | (short & (left == count[row]))
    return mix(out[keep]), row[keep]
