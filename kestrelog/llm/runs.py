"""Periodic runs of words, found by the branching-tandem test on an enhanced suffix array.

A document is a sequence of word numbers. For each LCP interval of depth d the suffixes of its
smaller part are asked whether the suffix d places on, or d places back, lies in the other part
(through the inverse suffix array): if so, a square of period d ends right where its run ends.
Squares are rotated to the left as far as they go, which gives their run; multiples of a period end
at the same word and are left out. There are no tree nodes: intervals are two numbers per LCP value.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common

#: A run has at least so many words, and its period fits in at least so many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Suffixes that are tested, and words that are joined, at a time.
CHUNK = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def split(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of texts that stand one after the other in raw, and where each text's words begin."""
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (edge[:-1] | np.append(True, space[:-1])[: len(raw)]))
    ends = np.flatnonzero(~space & (edge[1:] | np.append(space[1:], True)[: len(raw)])) + 1
    cuts = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw[~space])])
    return words, np.searchsorted(starts, offsets)


def stretches(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that can be in a run, and the number of the unbroken stretch each is in.

    Every word of a run comes LEAST_TIMES times in it, hence in its stretch; what comes less often
    breaks the stretch, again and again until that removes little.
    """
    place = np.arange(len(word))
    part = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    wide = int(word.max(initial=0)) + 1
    while len(place):
        _, where, count = np.unique(part * wide + word[place], return_inverse=True, return_counts=True)
        often = count[where] >= LEAST_TIMES
        had, place, part = len(place), place[often], part[often]
        part = np.cumsum(np.append(0, (np.diff(place) > 1) | (np.diff(part) > 0)))[: len(place)]
        long = np.bincount(part)[part] >= LEAST_WORDS if len(place) else np.zeros(0, bool)
        place, part = place[long], part[long]
        if len(place) > had * 7 // 8:
            break
    return place, part


def suffix_array(word: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the stretches in order, the place of each in that order, and where its stretch ends.

    Prefix doubling over the suffixes that are not yet apart; those of two stretches always are.
    """
    n = len(word)
    end = np.searchsorted(part, part, side="right")
    key = part * (int(word.max()) + 1) + word
    order = np.argsort(key, kind="stable")
    sorted_key, slots, rank, k = key[order], np.arange(n), np.empty(n, np.int64), 1
    suffixes = order.copy()
    while True:
        new = np.append(True, sorted_key[1:] != sorted_key[:-1])
        rank[suffixes[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        if not len(slots):
            return suffixes, rank, end
        at = suffixes[slots]
        then = at + k
        key = rank[at] * (n + 1) + np.where(then < end[at], rank[np.minimum(then, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        suffixes[slots], sorted_key = at[order], key[order]
        k *= 2


def common_prefixes(word: np.ndarray, suffixes: np.ndarray, rank: np.ndarray, end: np.ndarray) -> list[int]:
    """Words that each suffix shares with the one before it in order (0 for the first)."""
    w, before, last, slot = word.tolist(), suffixes.tolist(), end.tolist(), rank.tolist()
    shared, h = [0] * len(w), 0
    for i, r in enumerate(slot):
        if r == 0:
            h = 0
            continue
        j = before[r - 1]
        if last[i] != last[j]:
            h = 0
            continue
        room = last[i] - max(i, j)
        while h < room and w[i + h] == w[j + h]:
            h += 1
        shared[r] = h
        h = h - 1 if h else 0
    return shared


def intervals(shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each LCP value the suffixes [left, right) around it that share at least as much.

    Of equal values of one interval the last is on top, so that any two suffixes meet in one value.
    """
    n = len(shared)
    left, right, open_ = [0] * n, [n] * n, []
    for k in range(n):
        d = shared[k]
        while open_ and shared[open_[-1]] >= d:
            right[open_.pop()] = k
        left[k] = open_[-1] if open_ else 0
        open_.append(k)
    return np.array(left), np.array(right)


def squares(word: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, period, first place of the stretch) of squares that no word to their right extends."""
    suffixes, rank, end = suffix_array(word, part)
    first = np.searchsorted(part, part, side="left")
    shared = common_prefixes(word, suffixes, rank, end)
    left, right = intervals(shared)
    depth = np.array(shared)
    # a run of LEAST_TIMES periods must fit into the stretch
    node = np.flatnonzero((depth > 0) & (depth * LEAST_TIMES <= (end - first)[suffixes]))
    depth, left, right = depth[node], left[node], right[node]
    low = node - left <= right - node
    begin, size = np.where(low, left, node), np.where(low, node - left, right - node)
    from_, to = np.where(low, node, left), np.where(low, right, node)
    total, at, period = np.cumsum(size), [], []
    for a in range(0, int(total[-1]) if len(total) else 0, CHUNK):
        number = np.arange(a, min(a + CHUNK, int(total[-1])))
        of = np.searchsorted(total, number, side="right")
        i, d = suffixes[begin[of] + number - (total[of] - size[of])], depth[of]
        for start, other in ((i, i + d), (i - d, i - d)):
            inside = (other >= 0) & (other < len(word))
            r = rank[np.where(inside, other, 0)]
            hit = inside & (from_[of] <= r) & (r < to[of])
            at.append(start[hit])
            period.append(d[hit])
    at, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, period))
    return at, period, first[at]


def rotated(word: np.ndarray, start: int, period: int, first: int) -> int:
    """The leftmost place to which a square can be rotated, word by word."""
    step = 16
    while start > first:
        a = max(first, start - step)
        differ = np.flatnonzero(word[a:start] != word[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, step = a, step * 2
    return start


def find_runs(word: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of texts whose word numbers stand one after the other."""
    place, part = stretches(word, bounds)
    if not len(place):
        return []
    word = word[place]
    at, period, first = squares(word, part)
    # what is too short is left out early: LEAST_TIMES - 2 periods to the left must go on
    back = at - (LEAST_TIMES - 2) * period
    fits = back >= first
    fits[fits] = (word[at[fits] - 1] == word[at[fits] - 1 + period[fits]]) & (word[back[fits]] == word[back[fits] + period[fits]])
    at, period, first = at[fits], period[fits], first[fits]
    found, ending, last = [], [], -1
    for x in np.lexsort((period, at + 2 * period)).tolist():
        i, d = int(at[x]), int(period[x])
        stop = i + 2 * d
        if stop != last:
            ending, last = [], stop
        if any(d % q == 0 and start <= i for start, q in ending):
            continue
        start = rotated(word, i, d, int(first[x]))
        ending.append((start, d))
        if stop - start >= max(LEAST_WORDS, LEAST_TIMES * d):
            found.append((int(place[start]), stop - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place: one document in ten repeats a part of itself to its end."""
    order = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[a:] = a + np.arange(n - a) % p
    return order


def _joined(words: pa.Array, order: np.ndarray) -> str:
    """SHA-256 of words joined by one space each."""
    digest = hashlib.sha256()
    for a in range(0, len(order), CHUNK):
        _, where, letters = (x and np.frombuffer(x, np.uint8) for x in words.take(pa.array(order[a : a + CHUNK])).buffers())
        sizes = np.diff(where.view(np.int64)[: len(order[a : a + CHUNK]) + 1])
        text = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        text[1 + np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = letters[: int(sizes.sum())]
        digest.update(text[0 if a else 1 :].data)
    return digest.hexdigest()


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def _find(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
        for batch in batches:
            for first, end, raw, offsets in common.text_blocks(batch.column(1)):
                words, bounds = split(raw, offsets)
                ids = batch.column(0).slice(first, end - first).to_pylist()
                order = [b + planted(i if plant else None, e - b) for i, b, e in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist())]
                number = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)
                runs = find_runs(number[np.concatenate(order)], bounds)
                of = np.searchsorted(bounds, [r[0] for r in runs], side="right") - 1
                rows = []
                for k, kept in enumerate(order):
                    mine = [(runs[x][0] - int(bounds[k]), *runs[x][1:]) for x in np.flatnonzero(of == k).tolist()]
                    drop = np.zeros(len(kept), bool)
                    for start, length, period in mine:
                        drop[start + period : start + length] = True
                    best = max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    listed = hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in mine).encode()).hexdigest()
                    rows.append((len(mine), *(best or (None,) * 3), best and 1000 * best[1] // best[2], listed, _joined(words, kept[~drop]), len(kept), int(drop.sum())))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *columns], [c.split()[0] for c in _SCHEMA.split(", ")])

    return run


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> runs of each text, the greatest by length / period, and digests.

    A run is a stretch of words that repeats its first `period` words (the smallest such number) at
    least 4 times, is at least 6 words long and can't go on to either side. All runs are found, in
    whole texts. runs_sha256 is of every run's "start,length,period" line, collapsed_sha256 of
    the words that no run repeats; n_dropped counts the others. With plant, one document in ten (by
    its id) is made to repeat a part of itself first. Null and empty texts have no words and no runs;
    a null id is never planted; repeated rows keep a row each; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_find(plant), _SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(common.table(spark, sf_dir, "documents"), plant=True)


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
