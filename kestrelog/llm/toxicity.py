"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word beginnings (which stand for inflected words), word
pairs and pairs with one or two words between, hashed to 2^20 buckets; those in fewer than min_rows training texts are not admitted. FTRL goes from
row to row, so training runs in one task, on a bounded sample of labelled rows in the order of
a hash of the id. L1 keeps a few thousand weights at most, which go to the tasks as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 20
BIAS = 1 << BITS
_POWERS = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(64, dtype=np.uint64))
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]
_KIND = np.zeros(256, np.uint8)  # the lower-cased byte, 0 between words
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _KIND[_b] = _b
for _b in range(65, 91):
    _KIND[_b] = _b + 32


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows that training reads, whatever the corpus size."""

    max_rows: int = 8_000
    min_rows: int = 4
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1


#: Bytes of a word's beginning that make a feature of their own.
BEGINNINGS = (4, 5)


def _word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words and of their beginnings, and for each word its row. A text's end ends a word."""
    kind = _KIND[raw]
    is_word = kind > 0
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[inner] = is_word[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return [np.empty(0, np.uint64)] * (1 + len(BEGINNINGS)), np.empty(0, np.int64)
    at = np.flatnonzero(is_word)
    first = np.flatnonzero(begins[at])
    lengths = np.diff(np.append(first, len(at)))
    position = np.arange(len(at)) - np.repeat(first, lengths)
    terms = kind[at].astype(np.uint64) * _POWERS[position & 63]
    hashes = [np.add.reduceat(terms, first)]
    padded = np.append(terms, np.zeros(max(BEGINNINGS), np.uint64))
    for n in BEGINNINGS:  # a shorter word's beginning is the whole word
        begun = np.zeros(len(first), np.uint64)
        for k in range(n):
            begun += np.where(lengths > k, padded[first + k], np.uint64(0))
        hashes.append(begun)
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def _buckets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays of each kind of feature; repeats are kept."""
    (h, *begun), row = _word_hashes(raw, offsets)
    shift = np.uint64(64 - BITS)
    yield row, ((h * _ODD[0]) >> shift).astype(np.int64)
    for k, b in enumerate(begun):
        yield row, (((b ^ _ODD[k + 1]) * _ODD[3]) >> shift).astype(np.int64)
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            pair = (h[:-gap] * _ODD[gap]) ^ ((h[gap:] + np.uint64(gap)) * _ODD[4])
            yield row[gap:][same], ((pair[same] * _ODD[0]) >> shift).astype(np.int64)


def _ftrl(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int]] = []
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for first, end, raw, offsets in common.text_blocks(batch.column(0)):
                found = list(_buckets(raw, offsets))
                keys = np.unique(np.concatenate([r << (BITS + 1) | b for r, b in found])) if found else np.empty(0, np.int64)
                cuts = np.searchsorted(keys, np.arange(end - first + 1) << (BITS + 1))
                mask = (1 << (BITS + 1)) - 1
                for i in range(end - first):
                    rows.append((np.append(keys[cuts[i] : cuts[i + 1]] & mask, BIAS).astype(np.int32), toxic[first + i]))
        z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
        admitted = np.zeros(BIAS + 1, np.int32)
        for x, _ in rows:
            admitted[x] += 1
        admitted = admitted >= settings.min_rows
        admitted[BIAS] = True
        rows = [(x[admitted[x]], y) for x, y in rows]

        def weights(zi, ni, l1):
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2))

        penalty = np.full(BIAS + 1, settings.l1)
        penalty[BIAS] = 0
        for _ in range(settings.epochs):
            for x, y in rows:
                zi, ni = z[x], n[x]
                w = weights(zi, ni, penalty[x])
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / settings.alpha * w
                n[x] = ni + g * g
        w = weights(z, n, penalty)
        at = np.flatnonzero(w)
        del rows, z, n
        common.give_back()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["bucket", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs (doc_id, text) and labels (doc_id, toxic) -> sparse weights (bucket int, weight double).

    Labels other than 0 and 1 and rows without an id are left out; a document with several
    labels counts as toxic if any says so. At most settings.max_rows documents are used, the
    first by a hash of the id, one row each: of several texts of one id the least. Null and
    empty texts teach the bias alone; ties of the hash go by id. Without labelled rows there
    are no weights. Texts are read whole.
    """
    labelled = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labelled.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(settings.max_rows)  # bounded: it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    dealt = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(13), "doc_id"), F.xxhash64("text"))
    return dealt.select("text", "toxic").mapInArrow(_ftrl(settings), "bucket int, weight double")


def _share(spark: SparkSession, weights: DataFrame):
    """The weights as a broadcast; they are 2^20 + 1 rows at most."""
    fitted = weights.toPandas()
    dense = np.zeros(BIAS + 1)
    dense[fitted["bucket"].to_numpy()] = fitted["weight"].to_numpy()
    at = np.flatnonzero(dense[:BIAS])
    return spark.sparkContext.broadcast((at.astype(np.int32), dense[at], float(dense[BIAS])))


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score), over whole texts; null and empty texts get the bias alone."""
    shared = _share(docs.sparkSession, weights)
    return docs.select("doc_id", "text").mapInArrow(_scorer(shared), "doc_id long, score double")


def reject(docs: DataFrame, weights: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; a score of exactly the threshold goes.

    Null and empty texts score by the bias alone. Repeated rows and null ids are judged row by
    row; an empty table stays empty; other columns, whatever their names, are kept. Without
    weights, as from no labels, nothing is known to be toxic and every row stays.
    """
    if weights.isEmpty():
        return docs
    shared, column = _share(docs.sparkSession, weights), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = _dense(shared.value)
        for batch in common.slices(batches):
            yield batch.filter(pa.array(_scores(batch.column(column), dense, bias) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _dense(shared: tuple) -> tuple[np.ndarray, float]:
    at, w, bias = shared
    dense = np.zeros(BIAS, np.float32)
    dense[at] = w
    return dense, bias


def _scores(texts: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(texts), bias)
    for first, end, raw, offsets in common.text_blocks(texts):
        keys = []
        for row, bucket in _buckets(raw, offsets):
            hit = dense[bucket] != 0
            keys.append(row[hit] << BITS | bucket[hit])
        keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        total[first:end] += np.bincount(keys >> BITS, dense[keys & (BIAS - 1)], end - first)
    return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = _dense(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), dense, bias))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """documents and labels -> (doc_id, held_out, score, predicted).

    Labels of documents whose crc32(doc_id as text) mod 5 is 0 are never learned from. Every row
    of docs gives one row, repeats too; a null doc_id counts as held out. Other columns are
    ignored. Without any usable label every score is 0.5 and predicted is 1 by the rule score >= 0.5.
    """
    fold = common.shard_of(F.col("doc_id"), 5)
    weights = train(docs.where(fold != 0), labels.where(fold != 0), settings)
    held = F.coalesce(fold == 0, F.lit(True)).alias("held_out")
    return score(docs, weights).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
