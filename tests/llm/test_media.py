from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import webp_writer
from sample_texts import ODD, prose

from kestrelog.llm import media, webp, webp_encoder


def picture(colors: int, height=23, width=19, seed=1):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 256, (colors, 4), dtype=np.uint8)
    blocks = rng.integers(0, colors, (height, width))
    blocks[:, 5:15] = blocks[:, 5:6]  # runs
    blocks[10:] = blocks[: height - 10]
    return table[blocks]


@pytest.mark.parametrize("transforms", [(), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR,), (webp.CROSS_COLOR,), (webp.PALETTE,), (webp.PREDICTOR, webp.CROSS_COLOR, webp.SUBTRACT_GREEN), (webp.PALETTE, webp.PREDICTOR)])
@pytest.mark.parametrize("options", [{}, {"cache_bits": 5}, {"copies": True}, {"groups": 3}, {"cache_bits": 2, "copies": True, "groups": 2}])
def test_decoder_inverts_every_part(transforms, options):
    for colors in (2, 4, 13, 90):
        pixels = picture(colors)
        (got,) = webp.decode(webp_writer.write(pixels, transforms, **options))
        assert (got == pixels).all()


def test_random_modes_and_factors():
    pixels = np.random.default_rng(2).integers(0, 256, (30, 33, 4), dtype=np.uint8)
    for seed in range(4):
        (got,) = webp.decode(webp_writer.write(pixels, (webp.PREDICTOR, webp.CROSS_COLOR), seed=seed))
        assert (got == pixels).all()


def test_broken_images_are_refused():
    (good,) = media.to_media([media.padded(b"some text, " * 90)])
    for bad in (good[:-5], b"RIFX" + good[4:], good[:20] + b"\x00" + good[21:], good[:24]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    chunk = webp.chunks_of(good)[0]
    with pytest.raises(ValueError):
        webp.decode_many([chunk[: len(chunk) // 2]])


RAW = [b"", b"a", b"x" * 64, b"x" * 65, bytes(range(256)) * 3, b"ab" * 40_000, bytes(1_100_000), b"one line that comes again and again\n" * 300]


def test_payload_round_trip():
    rng = random.Random(3)
    raws = RAW + [prose(rng, rng.randint(1, 400)).encode() for _ in range(60)] + [np.random.default_rng(k).integers(0, 256, 50 + 977 * k, dtype=np.uint8).tobytes() for k in range(12)]
    payloads = [media.padded(x) for x in raws]
    for raw, payload in zip(raws, payloads):
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == raw.rstrip(b"\0")
    files = media.to_media(payloads)
    assert [x.tobytes() for x in media.from_media(files)] == payloads
    alone = [media.to_media([x])[0] for x in payloads]
    assert alone == files  # a file does not depend on the others of its block
    assert len(files[-13 - 60]) < 1000  # a line that repeats costs little more than once


@pytest.mark.parametrize("colors", [1, 2, 4, 13, 90, 200])
def test_encoder_on_pictures(colors):
    shapes = [(23, 19), (1, 1), (1, 16), (128, 16), (40, 16)]
    images = [picture(colors, h, w, seed) if w == 19 else np.resize(picture(colors, 23, 19, seed), (h, w, 4)) for seed, (h, w) in enumerate(shapes)]
    for image, file in zip(images, webp_encoder.encode_many(images)):
        assert (webp.decode(file)[0] == image).all()


def test_encoder_uses_every_part():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:128, 0:16]
    slope = np.stack([y + 3 * x, y + 3 * x, y + 3 * x, 0 * y + 255], -1).astype(np.uint8)
    noise = rng.integers(0, 256, (128, 16, 1), dtype=np.uint8)
    bound = np.concatenate([(noise.view(np.int8) // 2).view(np.uint8), noise, (noise.view(np.int8) // 4).view(np.uint8), 0 * noise + 255], -1)
    smooth = slope + np.cumsum(rng.integers(-2, 3, (128, 16, 1)), 0).astype(np.uint8) * np.array([1, 2, 3, 0], np.uint8)
    table = np.resize(np.frombuffer(b"0  1", np.uint8), (128, 16, 4)) ^ np.repeat(rng.integers(0, 2, (128, 16, 1), dtype=np.uint8), 4, -1)
    text = np.frombuffer(media.padded(prose(random.Random(1), 900).encode())[:4096], np.uint8).reshape(-1, 16, 4)
    images = [slope, bound, smooth, table, text]
    seen = set()
    for image, file in zip(images, webp_encoder.encode_many(images)):
        assert (webp.decode(file)[0] == image).all()
        seen |= webp.parsed(webp.chunks_of(file)[0]).features
    assert {"predictor", "palette", "matches", "cache", "prefix codes"} <= seen and seen & {"subtract-green", "cross-colour"}


def test_the_querys_own_images_use_the_formats_parts(spark):
    """Texts of the given table: normal prefix codes throughout, matches and the colour cache where they pay."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = [c for r in media.store(docs).collect() for c in webp.chunks_of(bytes(r.media))]
    heads = [webp.parsed(c) for c in files]
    share = lambda name: sum(name in h.features for h in heads) / len(heads)
    assert share("prefix codes") > 0.95 and share("cache") > 0.3 and share("matches") > 0.1
    assert sum(map(len, files)) < 0.75 * docs.selectExpr("sum(octet_length(text))").first()[0]


def test_media_query_on_odd_rows(spark, odd_docs, no_docs):
    rows = media.media_features(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        raw = (ODD[r.doc_id] or "").encode()
        payload = media.padded(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (0, 1)}) == 1  # equal texts, equal values
    assert media.media_features(no_docs).count() == 0


def test_code_lengths_are_written_as_they_are_read():
    """Codes of one, two and many symbols, with short and long runs of equal lengths and of zeros."""
    rng = np.random.default_rng(12)
    for n in (40, 256, 280, 280 + 1024):
        for used in (0, 1, 2, 3, 20, n // 2, n):
            counts = np.zeros(n, np.int64)
            counts[rng.choice(n, used, replace=False)] = rng.geometric(0.02, used)
            lengths, bits = webp_encoder.code_lengths(counts), webp_encoder.Bits()
            webp_encoder._put_code(bits, lengths)
            held = webp.Bits(bits.value.to_bytes(bits.n // 8 + 1, "little"))
            assert (webp._read_lengths(held, n) == lengths).all() and held.at == bits.n


def test_codes_are_built_and_read_for_all_images_together(monkeypatch):
    rng = random.Random(5)
    payloads = [media.padded(prose(rng, n).encode()) for n in range(20, 400, 5)]

    def refuse(*_):
        raise AssertionError("a code of one image alone")

    monkeypatch.setattr(webp_encoder, "code_lengths", refuse)
    monkeypatch.setattr(webp, "_read_lengths", refuse)
    assert [x.tobytes() for x in media.from_media(media.to_media(payloads))] == payloads


def test_many_codes_are_those_of_one_at_a_time():
    """Codes without, with one and with many symbols, even and very uneven counts, of alphabets of several sizes."""
    rng = np.random.default_rng(13)
    counts = np.zeros((60, 300), np.int64)
    for k, row in enumerate(counts):
        used = int(rng.choice([0, 1, 2, 3, 12, 30, 150, 280]))
        size = int(rng.choice([280, 300]))
        values = 2 ** np.arange(used) if used <= 30 and k % 2 else rng.geometric(0.02, used)
        row[rng.choice(size, used, replace=False)] = rng.permutation(values)
    counts[0, 290] = 7
    for limit in (9, 11):
        lengths = webp_encoder.many_lengths(counts, limit)
        assert (lengths == np.stack([webp_encoder.code_lengths(row, limit) for row in counts])).all()
        alphabets = np.where(lengths[:, 280:].any(1), 300, 280)
        written = [webp_encoder.Bits() for _ in lengths]
        for k, (bits, row) in enumerate(zip(written, lengths)):
            bits.put(0, k % 7)
            webp_encoder._put_code(bits, row)
        images = [webp.Coded(1, 1, 0, [], None, 0, b.value.to_bytes(b.n // 8 + 1, "little"), k % 7) for k, b in enumerate(written)]
        windows, begins = webp._windows(images, 1 << 15)
        pos = 8 * begins[:-1] + np.array([x.at for x in images])
        assert (webp._lengths_together(windows, pos, alphabets) == lengths).all()
        assert (pos - 8 * begins[:-1]).tolist() == [b.n for b in written]
