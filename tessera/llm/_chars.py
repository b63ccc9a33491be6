"""Distinct hashed character n-grams of whole documents, as numpy passes over code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._text import bytes_of

#: Odd multipliers of the n-gram hash, one for each place in a gram and one to spread the sum.
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
_SPREAD = np.uint32(0xB5297A4D)
_tables: list[np.ndarray] = []


def folded() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 65536: the lower-case letter or digit (others become a space), and whether it is a letter."""
    if not _tables:
        fold, letter = np.full(65536, 32, np.uint32), np.zeros(65536, bool)
        for c in range(65536):
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                low = x.lower()
                fold[c] = ord(low) if len(low) == 1 else c
            elif x.isdigit():
                fold[c] = 48
        _tables.extend((fold, letter))
    return _tables[0], _tables[1]


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the column's texts one after another, and each text's bounds."""
    data, off = bytes_of(column)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), lead[off]


def fold(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, letter = folded()
    if len(cp) and cp.max() >= 65536:
        small = np.minimum(cp, 65535)
        out, is_letter = low[small], letter[small]
        for i in np.flatnonzero(cp >= 65536):
            is_letter[i] = chr(cp[i]).isalpha()
            out[i] = cp[i] if is_letter[i] else 32
        return out, is_letter
    return low[cp], letter[cp]


def _hashes(c: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n-gram that starts at each of len(c) - n + 1 places."""
    m = len(c) - n + 1
    h = np.full(m, np.uint32(n * 0x632BE5AB & 0xFFFFFFFF))
    for k in range(n):
        h += c[k : k + m] * _MULT[k]
    h ^= h >> np.uint32(15)
    h *= _SPREAD
    return h >> np.uint32(32 - bits)


def grams(column: pa.Array, sizes: tuple[int, ...], bits: int, slot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, bool]]:
    """For each text its distinct gram ids and whether it has a letter. slot maps hashes to ids (negative: left out)."""
    cp, bounds = code_points(column)
    # A space on both sides of each text, so that first and last words have edges and no gram spans two texts' letters.
    n_docs = len(bounds) - 1
    padded = np.full(len(cp) + 2 * n_docs, 32, np.uint32)
    place = np.arange(len(cp)) + 2 * np.repeat(np.arange(n_docs), np.diff(bounds)) + 1
    c, letter = fold(cp)
    padded[place] = c
    edges = bounds + 2 * np.arange(n_docs + 1)
    letters = np.concatenate([[0], np.cumsum(letter)])
    has = letters[bounds[1:]] > letters[bounds[:-1]]
    n_ids = (1 << bits) if slot is None else int(slot.max(initial=-1)) + 1
    seen = np.zeros(max(n_ids, 1), bool)
    by_size = []
    for n in sizes:
        h = _hashes(padded, n, bits) if len(padded) >= n else np.zeros(0, np.uint32)
        by_size.append(h if slot is None else slot[h])
    for i in range(n_docs):
        for n, h in zip(sizes, by_size, strict=True):
            part = h[edges[i] : max(edges[i], edges[i + 1] - n + 1)]
            seen[part if slot is None else part[part >= 0]] = True
        ids = np.flatnonzero(seen)
        seen[ids] = False
        yield ids, bool(has[i])
