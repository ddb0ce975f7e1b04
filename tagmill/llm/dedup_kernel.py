"""Shingle sets and b-bit MinHash signatures; runs in Python workers."""

from __future__ import annotations

import numpy as np

from tagmill.llm.kernel import distinct, mix64, sections, seeded, word_hashes, words

#: Minima of a signature, low bits kept of each, rows of a band.
MINIMA, BITS, ROWS = 128, 4, 5

_MUL = seeded(MINIMA, 21) | np.uint64(1)
_ADD = seeded(MINIMA, 22)
_MIX = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def shingle_sets(text: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row; a row of fewer words is one shingle."""
    n = len(offsets) - 1
    hashes, count = [np.zeros(0, np.uint64)], np.zeros(n, np.int64)
    for i, j, a, b, first, last in sections(text, offsets):
        starts, lengths, row = words(text[a:b], offsets[i : j + 1] - a if first and last else np.array([0, b - a]))
        hashes.append(word_hashes(text[a:b], starts, lengths))
        count[i:j] += np.bincount(row, minlength=j - i)
    h = np.concatenate(hashes)
    with np.errstate(over="ignore"):
        ends = np.cumsum(count)
        whole = h * _MIX[0] + np.uint64(1)
        for k in range(1, width):
            ahead = np.concatenate((h[k:], np.zeros(min(k, len(h)), np.uint64)))
            whole = mix64(whole ^ (ahead + _MIX[1])) * _MIX[2]
        out = []
        for first, last in zip((ends - count).tolist(), ends.tolist(), strict=True):
            if last - first >= width:
                out.append(distinct(whole[first : last - width + 1]))
            elif last > first:
                one = np.uint64(last - first)
                for x in h[first:last]:
                    one = mix64(np.array([one ^ (x + _MIX[1])], np.uint64))[0] * _MIX[2]
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of MINIMA hashes over a set, 32 bits each."""
    least = np.full(MINIMA, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            np.minimum(least, (shingles[i : i + 2048] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint64)


def pack(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into 64-bit words (rows of least: signatures)."""
    low = mix64(least) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = (np.arange(per) * BITS).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(*least.shape[:-1], -1, per) << shifts, axis=-1)


def rows_for(percent: int) -> int:
    """Minima of a band, at most ROWS: the most with which a pair right at the threshold shares no band once in a million or less."""
    miss = lambda rows: (1 - (percent / 100) ** rows) ** (MINIMA // rows)
    return next((rows for rows in range(ROWS, 1, -1) if miss(rows) <= 1e-6), 1)


def band_keys(least: np.ndarray, size: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of size full minima."""
    bands = MINIMA // size
    with np.errstate(over="ignore"):
        key = np.broadcast_to(seeded(bands, 23), (*least.shape[:-1], bands)).copy()
        rows = least[..., : bands * size].reshape(*least.shape[:-1], bands, size)
        for k in range(size):
            key = mix64(key ^ (rows[..., k] + _MIX[0])) * _MIX[2]
    return key


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        a = mix64(shingles ^ _MIX[0]).sum(dtype=np.uint64)
        b = mix64(shingles + _MIX[1]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


#: The fingerprint of the empty set.
EMPTY = fingerprint(np.zeros(0, np.uint64))
