from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from kestrelog.llm import simhash
from kestrelog.llm.components import connected_components

from sample_texts import ODD, WORDS, prose


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    for text in [*(t for t in ODD[:9] if t), prose(rng, 2), prose(rng, 3), prose(rng, 400), "Éa É B " * 300]:
        assert simhash.fingerprint_of(text.encode()) == slow_fingerprint(text)


def test_every_pair_within_one_bit_meets_at_a_home_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    x = np.concatenate([x, x[:40] & np.uint64(0x80000000)])  # codewords too
    rows, anchors, home = simhash.anchors_of(x)
    assert (np.bincount(rows) <= 17).all()
    assert (np.bincount(rows[home], minlength=len(x)) == 1).all()
    homes = dict(zip(rows[home], anchors[home]))
    for i, v in enumerate(x):
        for bit in range(32):
            _, near, _ = simhash.anchors_of(np.array([v ^ np.uint64(1 << bit)], np.uint64))
            assert homes[i] in near


def brute(fps):
    fps = sorted(set(fps))
    return components([(a, b) for i, a in enumerate(fps) for b in fps[i:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3], fps)


def linked(spark, fps, limit):
    edges = simhash.links(spark.createDataFrame([(f,) for f in set(fps)], "fp long"), limit)
    found = {r.node: r.root for r in connected_components(edges).collect()}
    for e in edges.collect():
        assert ((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 3
    return {f: found.get(f, f) for f in set(fps)}


def test_links_against_brute_force(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(30):
        at = rng.getrandbits(64)
        for _ in range(12):
            fps.append(at - (1 << 64) if at >> 63 else at)
            for _ in range(rng.randint(0, 4)):
                at ^= 1 << rng.randrange(64)
    want = brute(fps)
    assert linked(spark, fps, simhash.GROUP_LIMIT) == want
    assert linked(spark, fps, 9) == want  # groups past the limit go the other way


def test_near_duplicates_of_odd_rows(spark, odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.fingerprint for r in rows if r.doc_id is not None} == {i: f"{slow_fingerprint(t):016x}" for i, t in enumerate(ODD)}
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts = base + base[:5] + [b + " " + rng.choice(WORDS) for b in base[:20]]
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = {100 - i: slow_fingerprint(t) for i, t in enumerate(texts)}
    want = components([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], list(fps))
    assert got == want
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert kept == set(want.values())


def test_deduplicate_keeps_columns_and_one_of_repeated_ids(spark, odd_docs, no_docs):
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 3 in ids
    assert simhash.near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 199), (199, 200), (None, 7)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(41)} | {199: 199, 200: 199}
