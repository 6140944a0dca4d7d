"""Longest common subsequence of two lists of line keys in linear memory.

Rows of the LCS table are bit vectors (a zero bit marks a column where the length grows), so a row
costs one addition of long integers. Hirschberg's halving finds the alignment from two such rows.
"""

from __future__ import annotations

import numpy as np

#: Bytes of match masks that are kept for reuse.
CACHE_BYTES = 1 << 26


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the LCS of a with each prefix of b."""
    m = len(b)
    full = (1 << m) - 1
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, side="left").tolist(), np.searchsorted(b[order], a, side="right").tolist()
    masks: dict[int, int] = {}
    v = full
    for lo, hi in zip(low, high):
        if lo == hi:
            continue
        mask = masks.get(lo)
        if mask is None:
            marks = np.zeros(m, np.uint8)
            marks[order[lo:hi]] = 1
            mask = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
            if len(masks) * m // 8 < CACHE_BYTES:
                masks[lo] = mask
        u = v & mask
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-m // 8), "little"), np.uint8), count=m, bitorder="little")
    return np.append(0, np.cumsum(bits == 0))


def _align(a: np.ndarray, b: np.ndarray, first: int, hit: np.ndarray) -> None:
    while len(a) and len(b) and a[0] == b[0]:
        hit[first] = True
        a, b, first = a[1:], b[1:], first + 1
    while len(a) and len(b) and a[-1] == b[-1]:
        hit[first + len(a) - 1] = True
        a, b = a[:-1], b[:-1]
    if not len(a) or not len(b):
        return
    if len(a) == 1:
        hit[first] = bool((b == a[0]).any())
        return
    half = len(a) // 2
    cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    _align(a[:half], b[:cut], first, hit)
    _align(a[half:], b[cut:], first + half, hit)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each line of a is in a longest common subsequence of a and b."""
    hit = np.zeros(len(a), bool)
    mine, theirs = np.isin(a, b), np.isin(b, a)
    found = np.zeros(int(mine.sum()), bool)
    _align(a[mine], b[theirs], 0, found)
    hit[np.flatnonzero(mine)] = found
    return hit
