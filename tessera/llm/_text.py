"""Words and rolling hashes of whole Arrow string columns, as numpy passes over their UTF-8 bytes.

A slice holds a few MB of text at most (one document where that alone is longer), so that
temporaries stay small whatever the Arrow batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: Odd bases of two polynomial hashes; what decides by both compares 128 bits.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}

#: Byte classes. White space is \x20 and \x09-\x0D; alphanumeric also takes every byte of a non-ASCII letter.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(n: int, inverse: bool = False, base: int = 0) -> np.ndarray:
    known = _powers.get((base, inverse))
    if known is None or len(known) < n:
        out = np.full(max(n, 1 << 16), pow(_BASES[base], -1, 1 << 64) if inverse else _BASES[base], np.uint64)
        out[0] = 1
        known = _powers[base, inverse] = np.multiply.accumulate(out)
    return known[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % (1 << 64))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, base: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, from one prefix sum of a polynomial."""
    p = np.empty(len(values) + 1, np.uint64)
    p[0] = 0
    np.cumsum(values.astype(np.uint64) * _power(len(values), base=base), out=p[1:])
    h = (p[end] - p[start]) * _power(len(values) + 1, True, base)[start]
    return mix(h ^ (end - start).astype(np.uint64), seed)


def kgram_hash(h: np.ndarray, k: int, seed: int = 0, base: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries of h (len(h) - k + 1 of them)."""
    n = max(0, len(h) - k + 1)
    at = np.arange(n)
    return spans_hash(h, at, at + k, seed, base)


@dataclass
class Words:
    """Words of the documents of one slice: bounds holds, for each document, its first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def other(self) -> np.ndarray:
        """The words' hashes to the other base."""
        return _hashed(self.data, self.start, self.end, 1)

    def room(self) -> np.ndarray:
        """For each word, how many words its document still has from there."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.start))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `limit` bytes of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = bytes_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(column: pa.Array, member: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Maximal runs of member bytes in each document, hashed."""
    data, off = bytes_of(column)
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64), np.zeros(0, np.uint64))
    inside = member[data]
    cut = off[:-1][off[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, start, end, np.searchsorted(start, off), _hashed(data, start, end, 0))


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    h = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # by pieces, for a document of any length
        to = max(at + 1, int(np.searchsorted(start, start[at] + 2 * SLICE_BYTES)))
        lo, hi = start[at], end[to - 1]
        h[at:to] = spans_hash(data[lo:hi].astype(np.uint64) + np.uint64(1), start[at:to] - lo, end[at:to] - lo, base=base)
        at = to
    return h
