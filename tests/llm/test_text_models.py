from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from kestrelog.llm import langid, toxicity

from sample_texts import ODD, prose

TONGUES = {"aa": "kata mela siro pano tika rema".split(), "bb": "schtru wrengt mächte bürk klotz".split()}


def corpus(spark, n=240):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(3, 60), TONGUES[lang]), lang) for i in range(n) for lang in [rng.choice(["aa", "bb"])]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_languages_are_named(spark):
    docs = corpus(spark)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.language_id(docs).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1


def slow_bits(train: dict[str, bytes], text: bytes) -> dict[str, float]:
    """Method C over bytes with frozen counts, context by context; zeros stand before a text."""
    out = {}
    for lang, t in train.items():
        counts: dict[bytes, dict[int, int]] = {}
        s = bytes(3) + t
        for i in range(3, len(s)):
            for k in range(4):
                c = counts.setdefault(s[i - k : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
        total, x = 0.0, bytes(3) + text
        for i in range(3, len(x)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    total += 8
                    break
                c = counts.get(x[i - k : i])
                if c is None:
                    continue
                n, d = sum(c.values()), len(c)
                if x[i] in c:
                    total -= math.log2(c[x[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d))
        out[lang] = total
    return out


def test_code_lengths_match_a_plain_model():
    rng = random.Random(6)
    train = {lang: prose(rng, 40, w).encode() for lang, w in TONGUES.items()} | {"cc": "日本語の文章です。もう一つの文章。".encode()}
    parts = []
    for i, t in enumerate(train.values()):
        keys, n = np.unique(langid._codes(np.frombuffer(t, np.uint8), np.array([0, len(t)])), return_counts=True)
        parts.append((np.full(len(keys), i), keys.astype(np.int64), n))
    found = langid.tables(*(np.concatenate(x) for x in zip(*parts)), len(train))
    texts = [prose(rng, 9, TONGUES["aa"]).encode(), prose(rng, 9, TONGUES["bb"]).encode(), b"", b"zz kata qq", "ñandú 日本 \x00".encode(), bytes(range(256))]
    offsets = np.cumsum([0, *map(len, texts)])
    got = langid.code_lengths(found, np.frombuffer(b"".join(texts), np.uint8), offsets)
    for row, text in zip(got, texts):
        assert np.allclose(row, list(slow_bits(train, text).values()), rtol=1e-5, atol=1e-3)


def test_every_language_is_learned_whatever_their_number(spark):
    rng = random.Random(7)
    letters = [chr(0x100 + 7 * i) for i in range(60)]
    rows = [(40 * i + k, " ".join("".join(rng.choice(letters[i] + "abc") for _ in range(6)) for _ in range(12)), f"l{i:02}") for i in range(40) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {r[0]: r[2] for r in rows}
    for group in (16, 7):
        found = langid.language_id(docs, langid.Settings(group=group)).collect()
        assert all(r.lang_pred == truth[r.doc_id] for r in found) and len(found) == len(rows)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    rows = langid.language_id(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, text in enumerate(ODD):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.language_id(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}


def toxic_corpus(spark, n=400):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        words = prose(rng, rng.randint(10, 80)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "scoundrel", "Rotten,"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    weights = toxicity.train(docs, labels)
    assert weights.count() < 2_000  # L1 keeps few
    kept = {r.doc_id for r in toxicity.reject(docs, weights).collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, weights).collect() if r.score < 0.5}


def test_ftrl_weights_match_a_plain_loop():
    settings = toxicity.Settings(min_rows=1, epochs=2)
    texts, ys = ["bad word here", "good word", "bad bad thing", "fine day"], [1, 0, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(ys, pa.int32())], ["text", "toxic"])
    (out,) = toxicity._ftrl(settings)([batch])
    got = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        rows.append({int(b) for _, bs in toxicity._buckets(raw, np.array([0, len(raw)])) for b in bs} | {toxicity.BIAS})
    z, n = {}, {}

    def w(i):
        l1 = 0 if i == toxicity.BIAS else settings.l1
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((settings.beta + math.sqrt(ni)) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for x, y in zip(rows, ys):
            g = 1 / (1 + math.exp(-sum(w(i) for i in x))) - y
            for i, wi in [(i, w(i)) for i in x]:
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / settings.alpha * wi
                n[i] = n.get(i, 0.0) + g * g
    want = {i: w(i) for i in z if w(i)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 0), (5, 0), (None, 1), (7, 9)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    none = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(no_docs, labels).count() == 0
