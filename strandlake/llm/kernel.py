"""Words, word hashes and shingles of a whole Arrow batch of texts at once, in numpy.

Texts are walked as UTF-8 bytes. Every function sees whole texts; work arrays of
eight bytes a text byte exist only for a chunk at a time, so a text of any length
needs memory for its words alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A-Z to a-z, every other byte as it is.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Word bytes of the two contracts: all but white space; all but ASCII other than letters and digits.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, dtype=bool)
ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, CHUNK)
_INV = _powers(pow(_BASE, -1, 1 << 64), CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    buf: np.ndarray  # folded bytes of all texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each text, its first word; one entry more than texts
    hash: np.ndarray


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and their offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    at = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(col: pa.Array, member: np.ndarray) -> Words:
    buf, at = text_bytes(col)
    buf = FOLD[buf]
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(at), np.int64), none.astype(np.uint64))
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    inside = member[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(buf, start, end, np.searchsorted(start, at), _hashes(buf, start, end))


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = (_POW, _INV) if hi - lo <= CHUNK else (_powers(_BASE, hi - lo), _powers(pow(_BASE, -1, 1 << 64), hi - lo))
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP[63]
        i = j
    return mix(out)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i+k-1 for every i, whatever texts they are of; empty if there are too few."""
    n = len(hashes) - k + 1
    if n <= 0 or k <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n] * _STEP[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _STEP[j % 60]
    return mix(out + np.array([k], np.uint64) * _STEP[62])


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of every text, one text after the other, and where each begins."""
    n = np.diff(w.first)
    all_grams = grams(w.hash, k)
    sets = []
    for i, count in enumerate(n):
        at = w.first[i]
        if count >= k:
            sets.append(np.unique(all_grams[at : at + count - k + 1]))
        elif count:
            sets.append(grams(w.hash[at : at + count], int(count)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(size)])


def spelled_alike(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """Whether words (none empty) have the same bytes as words of another text that are as long."""
    out = np.ones(len(start), dtype=bool)
    for lo in range(0, len(start), CHUNK):
        s, o, n = start[lo : lo + CHUNK], other_start[lo : lo + CHUNK], (end - start)[lo : lo + CHUNK]
        begin = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(begin, n)
        same = buf[np.repeat(s, n) + within] == other[np.repeat(o, n) + within]
        out[lo : lo + CHUNK] = np.logical_and.reduceat(same, begin)
    return out
