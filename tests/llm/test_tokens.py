from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from kestrelog.llm import tokencount, tokenids

from sample_texts import ODD, prose

PIECES = [" ", "\n", "\x01", "\x01\x010", "  ", "a", "bc", "'s", "don't", "é", " ", "<|endoftext|>", "1", "!!", "\t", "日本", "B,", "x", "|", " ", " ", "word.", "\n\n", "\r\n"]


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(tokenids.TOKENIZER)).encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_librarys_ids(monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE_PIECES", 50)  # generations change often
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + [prose(rng, 50) for _ in range(50)]
    encoder = tokenids.PieceEncoder(tokenids.TOKENIZER)
    assert encoder.direct
    end, got = np.array([0], "<u2").tobytes(), []
    for i in range(0, len(texts), 100):
        where, ids = encoder.encode([t.encode() for t in texts[i : i + 100]], end)
        got += [bytes(ids[a:b]) for a, b in zip(where.tolist(), where.tolist()[1:])]
    assert got == [np.array([*x, 0], "<u2").tobytes() for x in plain_ids(texts)]


def test_packing_round_trip():
    rng = np.random.default_rng(9)
    for n in (0, 1, 3, 4, 5, 1000):
        for high in (200, 70_000, 1 << 20, 1 << 32):
            ranks = rng.integers(0, high, n, dtype=np.uint32)
            control, data = tokenids.pack(ranks)
            assert len(control) == -(-n // 4) and (tokenids.unpack(control, data, n) == ranks).all()


def check_ids(docs, rows):
    want = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(rows, key=lambda r: r.start)
    start = 0
    for (doc_id, _), ids, r in zip(want, plain_ids([t for _, t in want]), got, strict=True):
        ids = [*ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_id_files(spark, odd_docs, no_docs, tmp_path):
    rng = random.Random(10)
    docs = spark.createDataFrame([(i * 7 % 101, prose(rng, rng.randint(0, 60))) for i in range(101)], "doc_id long, text string").repartition(5)
    check_ids(docs, tokenids.token_ids(docs, str(tmp_path / "files")).collect())
    blocks = spark.read.parquet(str(tmp_path / "files" / "blocks"))
    ranks = {r["rank"]: r for r in spark.read.parquet(str(tmp_path / "files" / "ranks")).collect()}
    assert all(ranks[i].n >= ranks[i + 1].n for i in range(len(ranks) - 1))
    assert blocks.agg(F.sum("n_tokens")).first()[0] == sum(r.n for r in ranks.values())
    check_ids(odd_docs, tokenids.token_ids(odd_docs).collect())
    assert tokenids.token_ids(no_docs).count() == 0
    copies = spark.createDataFrame([(5, "the same")] * 40 + [(None, "none")] * 40 + [(6, prose(rng, 20))], "doc_id long, text string").repartition(4)
    check_ids(copies, tokenids.token_ids(copies).collect())


def test_token_counts_and_cache(spark, odd_docs, no_docs, tmp_path):
    import sentencepiece

    cache = str(tmp_path / "cache")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.MODEL))
    rows = tokencount.token_counts(odd_docs, cache).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id is not None:
            text = ODD[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text))) and r.over_limit == (r.n_tokens > 4096)
    held = spark.read.parquet(cache).count()
    assert held == len({t or "" for t in [*ODD, "no id here at all"]})
    more = odd_docs.union(spark.createDataFrame([(50, "a new text", None, None, 0, None, 0)], odd_docs.schema))
    assert tokencount.token_counts(more, cache).count() == odd_docs.count() + 1
    assert spark.read.parquet(cache).count() == held + 1  # only the miss was added
    spark.createDataFrame([(r.digest, r.version, 777) for r in spark.read.parquet(cache).where("n_tokens = 0").collect()], tokencount.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert 777 in {r.n_tokens for r in tokencount.token_counts(odd_docs, cache).collect()}  # counts come from the cache
    assert tokencount.token_counts(no_docs, str(tmp_path / "other")).count() == 0


def test_token_counts_with_a_hot_text_and_many_misses(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, "hot text" if i % 3 else prose(rng, 3 + i % 5)) for i in range(300)], "doc_id long, text string")
    want = sorted(tuple(r) for r in tokencount.token_counts(docs, str(tmp_path / "a")).collect())
    assert len(want) == 300
    monkeypatch.setattr(tokencount, "HOT_PARTS", 10**9)  # every digest's counts are broadcast
    assert sorted(tuple(r) for r in tokencount.token_counts(docs, str(tmp_path / "a")).collect()) == want
    monkeypatch.setattr(tokencount, "HOT_PARTS", 0)  # none are
    few = docs.where("doc_id < 100")
    tokencount.token_counts(few, str(tmp_path / "b")).count()
    monkeypatch.setattr(tokencount, "MISSES", 0)  # misses go by a shuffle
    assert sorted(tuple(r) for r in tokencount.token_counts(docs, str(tmp_path / "b")).collect()) == want


def test_workers_give_memory_back_after_each_task(monkeypatch):
    """A worker lives on beside later stages, so what a task freed must not stay with it."""
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(tokenids.common, "give_back", lambda: calls.append(1))
    docs = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a few words", None]})
    found = list(tokenids._encode(tokenids.TOKENIZER)(iter([docs])))
    assert [b.num_rows for b in found] == [2, 1] and len(calls) == 1
