from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from sample_texts import ODD, prose

from kestrelog.llm import runs


def slow_runs(words: list) -> list[tuple[int, int, int]]:
    """Every period at every place: the longest stretch of period q, kept if no smaller period holds in it."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                if not any(q % p == 0 and s <= i and i + length <= s + m for (s, m), p in found.items()):
                    found[(i, length)] = q
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and n and h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def number(words):
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array([names[w] for w in words], np.int64)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_search_by_period(letters):
    rng = random.Random(letters)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 7))]
            texts.append([rng.randrange(letters) for _ in range(rng.randrange(12))] + unit * rng.randrange(8) + unit[:1] + [rng.randrange(letters + 1) for _ in range(rng.randrange(25))])
        bounds = np.cumsum([0, *map(len, texts)])
        got = runs.find_runs(np.array(sum(texts, []), np.int64), bounds)
        assert got == [(s + int(b), m, q) for t, b in zip(texts, bounds) for s, m, q in slow_runs(t)]


def test_long_repeats_take_little_time():
    for words in (["a"] * 60_000, ["a", "b", "c"] * 20_000, [f"w{i % 7_001}" for i in range(60_000)]):
        q = len(set(words))
        assert runs.find_runs(number(words), np.array([0, len(words)])) == [(0, len(words), q)]
    pair = ["a", "b"]  # Fibonacci words hold many runs that overlap
    while len(pair[-1]) < 3_000:
        pair = [pair[1], pair[1] + pair[0]]
    thrice = list(pair[-1]) * 4
    assert runs.find_runs(number(thrice), np.array([0, len(thrice)])) == slow_runs(thrice)


def test_query_rows_equal_plain_version(spark):
    rng = random.Random(3)
    texts = [*ODD, "x\x0by\x0cx\ty\nx\ry x y", "a a a a a", "a a a a a a", "é é " * 9, " ".join(["to be or not"] * 30), None, ""]
    texts += [prose(rng, 200) if rng.random() < 0.5 else " ".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(150)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a b " * 5, "x"), (3, texts[3], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = [tuple(r)[:8] for r in runs.periodic_runs(docs, plant=True).collect()]
    assert got == [slow_row(i, t) for i, t, _ in rows]
    assert sum(r[1] for r in got) > 20
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_block_of_one_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + " ab cd" * 50_000
    (row,) = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.n_words, row.n_dropped) == (1, 200_000, 100_000, 2, 300_000, 99_998)
