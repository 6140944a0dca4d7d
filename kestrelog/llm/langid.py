"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to 3, frozen after training. A byte costs
-log2 of its probability at the longest context in which it was seen, plus the escape codes of
the longer contexts that exist but did not see it (method C: d / (n + d) escapes with d distinct
symbols among n), down to a uniform code over the 256 bytes. A text's code length under a
language is the sum over all its bytes; the shortest code names the language.

Since the statistics are frozen, the cost of every four-byte string that any language of a group
saw, escapes included, is worked out once for all of them. A byte's costs are one row of that
table; a byte that no language saw after its three predecessors pays their escapes and is looked
up with two, then fewer. Nothing that was learned is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, containment


@dataclass(frozen=True)
class Settings:
    """rows_per_language bounds what a language learns from (expected labelled rows), and so the model.

    Every lang value is learned. Languages are built and scored in groups: a group's counts are
    on the driver at a time, and its tables have a column for each of its languages.
    """

    rows_per_language: int = 2_500
    group: int = 16


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def merged(parts: list) -> list:
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64))]

    for batch in batches:
        languages = batch.column(1).to_numpy(zero_copy_only=False)
        for first, end, raw, offsets in common.text_blocks(batch.column(0)):
            codes = _codes(raw, offsets)
            owner = np.repeat(languages[first:end], np.diff(offsets))
            for language in np.unique(languages[first:end]).tolist():
                keys, n = np.unique(codes[owner == language], return_counts=True)
                parts = held.setdefault(language, [])
                parts.append((keys, n))
                if len(parts) > 16:
                    held[language] = merged(parts)
    for language, parts in held.items():
        (keys, n), *_ = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), language, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], ["language", "gram", "n"])


def _codes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, itself and the three before it as one number; zeros before a text's start."""
    b = raw.astype(np.uint32)
    codes = b.copy()
    since = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in (1, 2, 3):
        codes[k:] |= np.where(since[k:] >= k, b[:-k] << np.uint32(8 * k), np.uint32(0))
    return codes


class Places:
    """Numbers the pairs (row, symbol) of a set in order: a bit for each symbol of a row, and the pairs before each word of bits."""

    def __init__(self, keys: np.ndarray, rows: int, symbols: int):
        """keys: sorted distinct row * symbols + symbol."""
        self.words = (symbols + 63) // 64
        row, symbol = keys // symbols, keys % symbols
        self.bits = np.zeros(rows * self.words, np.uint64)
        np.bitwise_or.at(self.bits, row * self.words + (symbol >> 6), np.uint64(1) << (symbol & 63).astype(np.uint64))
        count = np.bitwise_count(self.bits).astype(np.int64)
        self.before = (np.cumsum(count) - count).astype(np.int32)

    def find(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Each pair's number, -1 for those not in the set."""
        at = row * self.words + (symbol >> 6)
        word, bit = self.bits[at], np.uint64(1) << (symbol & 63).astype(np.uint64)
        return np.where(word & bit, self.before[at] + np.bitwise_count(word & (bit - np.uint64(1))), -1)


@dataclass(frozen=True)
class Tables:
    """Costs of a group of languages, a column each. a symbols: the bytes seen, and one for all others, which cost the same."""

    symbol: np.ndarray  # byte -> symbol
    one: np.ndarray  # after one symbol: (context * a + symbol, language) -> bits
    escape: np.ndarray  # of contexts of two symbols
    three: Places  # (two symbols, third) as contexts and as strings
    three_cost: np.ndarray
    three_escape: np.ndarray
    four: Places  # (context of three, symbol)
    four_cost: np.ndarray


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    groups: tuple[Tables, ...]


def _coded(count: np.ndarray, total: np.ndarray, distinct: np.ndarray, shorter: np.ndarray, escape: np.ndarray) -> np.ndarray:
    """Bits of symbols seen count times in contexts of total symbols, distinct of them; unseen ones escape to shorter."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, -np.log2(count / (total + distinct)), escape + shorter)


def _escapes(total: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)


def tables(language: np.ndarray, gram: np.ndarray, n: np.ndarray, m: int) -> Tables:
    """Counts of four-byte strings of languages 0 to m - 1 -> their costs. Lower orders are sums over the strings."""
    present = np.zeros(256, bool)
    present[0] = True  # what stands before a text
    for k in range(4):
        present[np.unique(gram >> 8 * k & 255)] = True
    symbol = np.where(present, np.cumsum(present), 0)
    a = int(symbol.max()) + 1
    s = [symbol[gram >> 8 * k & 255] for k in (3, 2, 1, 0)]
    n = n.astype(np.float64)
    before, after = (s[0] * a + s[1]) * a + s[2], (s[1] * a + s[2]) * a + s[3]
    keys3 = np.unique(np.concatenate([before, after]))
    three = Places(keys3, a * a, a)
    context, shorter = np.searchsorted(keys3, before), np.searchsorted(keys3, after)
    keys4, place = np.unique(context * a + s[3], return_inverse=True)
    four = Places(keys4, len(keys3), a)
    one, escape = np.empty((a * a, m), np.float32), np.empty((a * a, m), np.float32)
    three_cost, three_escape = (np.empty((len(keys3), m), np.float32) for _ in range(2))
    four_cost = np.empty((len(keys4), m), np.float32)
    context4, shorter4 = np.empty(len(keys4), np.int64), np.empty(len(keys4), np.int64)
    context4[place], shorter4[place] = context, shorter
    for i in range(m):
        mine = language == i
        w = n[mine]
        zero = np.bincount(s[3][mine], w, a)
        total, distinct = zero.sum(), float((zero > 0).sum())
        bits0 = _coded(zero, total, distinct, np.float64(8), _escapes(total, distinct))
        two = np.bincount((s[2] * a + s[3])[mine], w, a * a).reshape(a, a)
        total, distinct = two.sum(1, keepdims=True), (two > 0).sum(1, keepdims=True)
        bits1 = _coded(two, total, distinct, bits0[None], _escapes(total, distinct)).reshape(-1)
        count = np.bincount(shorter[mine], w, len(keys3))
        pair = keys3 // a
        total, distinct = np.bincount(pair, count, a * a), np.bincount(pair, count > 0, a * a)
        escape2 = _escapes(total, distinct)
        bits2 = _coded(count, total[pair], distinct[pair], bits1[keys3 % (a * a)], escape2[pair])
        count = np.bincount(place[mine], w, len(keys4))
        total, distinct = np.bincount(context4, count, len(keys3)), np.bincount(context4, count > 0, len(keys3))
        escape3 = _escapes(total, distinct)
        bits3 = _coded(count, total[context4], distinct[context4], bits2[shorter4], escape3[context4])
        one[:, i], escape[:, i], three_cost[:, i], three_escape[:, i], four_cost[:, i] = bits1, escape2, bits2, escape3, bits3
    return Tables(symbol, one, escape, three, three_cost, three_escape, four, four_cost)


def code_lengths(found: Tables, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language of a group. A long text is read in pieces, each after the three bytes before it."""
    bits = np.zeros((len(offsets) - 1, found.one.shape[1]))
    for a, b, cuts in common.pieces(offsets):
        first = max(0, a - 3)
        cost = _costs(found, raw[first:b], np.clip(offsets, first, b) - first)
        bits += common.row_sums(cost[a - first :], cuts)
    return bits


def _costs(found: Tables, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each byte under each language, after the bytes of its text that stand before it."""
    a = int(found.symbol.max()) + 1
    s = found.symbol[raw]
    since = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    last = []
    for k in (1, 2, 3):
        x = np.full(len(s), found.symbol[0])
        x[k:] = np.where(since[k:] >= k, s[:-k], found.symbol[0])
        last.append(x)
    context = found.three.find(last[2] * a + last[1], last[0])
    string = np.where(context >= 0, found.four.find(np.maximum(context, 0), s), -1)
    cost = found.four_cost[string]
    rare = np.flatnonzero(string < 0)
    if len(rare):
        s, context, near, far = s[rare], context[rare], last[0][rare], last[1][rare]
        paid = np.where(context[:, None] >= 0, found.three_escape[context], 0)
        string = found.three.find(far * a + near, s)
        short = found.escape[far * a + near] + found.one[near * a + s]
        cost[rare] = paid + np.where(string[:, None] >= 0, found.three_cost[string], short)
    return cost


def train(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Learns from text and non-null lang of docs, a sample of settings.rows_per_language rows each as expected.

    Rows are chosen by a hash of the id against a rate that follows from the counts, so no
    group is gathered. None if there is nothing to learn from.
    """
    usable = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and text <> ''")
    per = usable.groupBy("lang").agg(F.count("*").alias("rows")).orderBy("lang").toPandas()  # a row per language
    if not len(per):
        return None
    rates = per.assign(language=np.arange(len(per)), rate=settings.rows_per_language / per["rows"])[["lang", "language", "rate"]]
    rates = containment.checked(docs.sparkSession.createDataFrame(rates, "lang string, language int, rate double"))
    uniform = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = usable.join(rates, "lang").where(uniform < F.col("rate")).select("text", "language")
    counts = sample.mapInArrow(_grams, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    counts = common.stored(counts, "language-counts")
    groups = []
    for first in range(0, len(per), settings.group):
        m = min(settings.group, len(per) - first)
        found = counts.where(F.col("language").between(first, first + m - 1)).toArrow()
        language, gram, n = (found.column(k).to_numpy() for k in range(3))
        groups.append(tables(language - first, gram, n, m))
    return Model(tuple(per["lang"]), tuple(groups))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        for batch in batches:
            best = np.full(batch.num_rows, -1)
            share = np.zeros(batch.num_rows)
            for first, end, raw, offsets in common.text_blocks(batch.column(1), 1 << 19):
                has = common.row_sums(letter[raw], offsets) > 0
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
                    has[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                if model is None or not has.any():
                    continue
                bits = np.concatenate([code_lengths(g, raw, offsets) for g in model.groups], axis=1)
                pick = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000))
                best[first:end] = np.where(has, pick, -1)
                share[first:end] = np.where(has, 1 / odds.sum(1), 0)
            names = np.array([*(model.languages if model else ()), "und"], object)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, lang_pred, score) over whole texts.

    score is the share of the best language if all were equally likely beforehand; ties go to
    the first name. A null text, or one without a letter in any script, is `und` with score 0,
    and so is every text if there is no model. Texts of any length are read whole. One row for
    each row of docs; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """documents -> (doc_id, held_out, lang_pred, score), learned from documents whose fold is not held out.

    The held-out fold is crc32(doc_id as text) mod 3 = 1. A null doc_id is not learned from and
    counts as held out. Other columns are ignored; repeated rows keep a row each.
    """
    fold = common.shard_of(F.col("doc_id"), 3)
    model = train(docs.where(fold != 1), settings)
    return identify(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
