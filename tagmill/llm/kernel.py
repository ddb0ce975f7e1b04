"""Array code over UTF-8 buffers that the text operators share; runs in Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that array code works on at once; a longer document is worked on in sections.
PIECE = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = seeded(256, 11)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = [np.ones(1, dtype=np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = max(1024, 1 << int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[0] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE, dtype=np.uint64))), dtype=np.uint64)
    return _POWERS[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    text = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return text, at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE):
    """Row ranges (i, j) of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def sections(text: np.ndarray, offsets: np.ndarray, limit: int | None = None):
    """(i, j, a, b, first, last): whole rows i to j and their bytes a to b, or a part of one longer row.

    Parts begin where a word begins after white space, so no word is cut (a single word
    longer than the limit stays whole); first and last: the row's first and last part.
    """
    limit = limit or PIECE
    for i, j in pieces(offsets, limit):
        a, b, first = int(offsets[i]), int(offsets[j]), True
        while b - a > limit and (cut := _word_start(text, a + limit, b)) is not None:
            yield i, j, a, cut, first, False
            a, first = cut, False
        yield i, j, a, b, first, True


def _word_start(text: np.ndarray, at: int, end: int) -> int | None:
    """The first place from at on where a word begins after white space."""
    for low in range(at, end, 1 << 16):
        space = _SPACE[text[low - 1 : min(end, low + (1 << 16))]]
        found = np.flatnonzero(space[:-1] & ~space[1:])
        if len(found):
            return low + int(found[0])
    return None


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, sorted (by a sort, which is faster here than a hash table)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def words(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words [^\\x20\\x09-\\x0D]+, and the row of each."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[text]
    cut = np.zeros(len(text) + 1, dtype=bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    letters = _LOWER[text[np.repeat(starts, lengths) + place]]
    with np.errstate(over="ignore"):
        total = np.add.reduceat(_BYTE[letters] * powers(int(lengths.max()))[place], first)
        return mix64(total + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
