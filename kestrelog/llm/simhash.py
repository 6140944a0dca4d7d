"""SimHash near-duplicates, linked by anchor-point covering.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at most three
bits, then in one half they differ in at most one. The anchors of a half are the words of
the perfect [31, 26] Hamming code with the 32nd bit kept as it is: every half lies within
radius 1 of exactly one anchor. A fingerprint is replicated to every anchor within covering
radius plus threshold (1 + 1) of each half, at most 17 anchors a half, so that it meets the
home anchor of every half that differs from its own in one bit at most. Fingerprints that
meet at an anchor are compared on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .containment import checked

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Fingerprints at one anchor that are compared with each other; those of a larger group are linked by _dense_links.
GROUP_LIMIT = 4096

_MASKS = np.array([sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)], np.uint64)


def fingerprint_of(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text's UTF-8 bytes (bytes.lower and bytes.split know ASCII only, as wanted)."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1)[: len(found) - shingle_words + 1].tolist()
    ends = (ends[shingle_words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.dtype("<u8"))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
        counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.empty(batch.num_rows, np.uint64)
        for i, text in enumerate(batch.column(1)):
            out[i] = fingerprint_of((text.as_py() or "").encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors within distance 2 of 32-bit halves, as (row, anchor, is home)."""
    half = half.astype(np.uint64)
    low, top = half & np.uint64(0x7FFFFFFF), half & np.uint64(0x80000000)
    syndrome = np.zeros(len(half), np.int64)
    for k, mask in enumerate(_MASKS):
        syndrome |= (np.bitwise_count(low & mask) & 1).astype(np.int64) << k
    flip = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0)).astype(np.uint64)
    home = (low ^ flip) | top
    rows, found, is_home = [np.arange(len(half))] * 2, [home, home ^ np.uint64(0x80000000)], [np.ones(len(half), bool), np.zeros(len(half), bool)]
    for i in range(1, 32):  # the codewords two bits away flip i and i ^ syndrome
        j = i ^ syndrome
        ok = np.flatnonzero((syndrome > 0) & (j > i))
        pair = np.uint64(1 << (i - 1)) | (np.uint64(1) << (j[ok] - 1).astype(np.uint64))
        rows.append(ok)
        found.append((low[ok] ^ pair) | top[ok])
        is_home.append(np.zeros(len(ok), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(is_home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for which in (0, 1):
            rows, found, home = anchors_of(fps >> np.uint64(32) if which else fps & np.uint64(0xFFFFFFFF))
            found = found | np.uint64(which << 32)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fps, as (child, parent) arrays: never more edges than members."""
    left, child, parent = fps, [], []
    while len(left):
        seed, left, queue = left[0], left[1:], []
        queue.append(seed)
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= MAX_BITS
            if near.any():
                got = left[near]
                child.append(got)
                parent.append(np.full(len(got), at, np.uint64))
                queue.extend(got)
                left = left[~near]
    return (np.concatenate(child), np.concatenate(parent)) if child else (np.empty(0, np.uint64),) * 2


def _compare(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: list, b: list, dense: bool) -> pa.RecordBatch:
            a, b = (np.concatenate(x or [np.empty(0, np.uint64)]).view(np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), dense))], ["a", "b", "dense"])

        def settle(anchor, fp, home):
            """Links within the groups of rows sorted by anchor."""
            starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            sizes = np.diff(np.append(starts, len(anchor)))
            wanted = np.add.reduceat(home.astype(np.int64), starts) > 0
            a, b, dense = [], [], []
            group = np.repeat(np.where(wanted & (sizes <= 8), np.arange(len(starts)), -1), sizes)
            for k in range(1, 8):
                if len(fp) <= k:
                    break
                hit = (group[k:] == group[:-k]) & (group[k:] >= 0)
                hit &= np.bitwise_count(fp[k:] ^ fp[:-k]) <= MAX_BITS
                a.append(fp[k:][hit])
                b.append(fp[:-k][hit])
            for s, n in zip(starts[wanted & (sizes > 8)], sizes[wanted & (sizes > 8)]):
                if n > limit:
                    dense.append(fp[s : s + n])
                else:
                    x, y = _forest(fp[s : s + n])
                    a.append(x)
                    b.append(y)
            yield out(a, b, False)
            if dense:
                yield out(dense, dense, True)

        held, n_held, big = [], 0, None  # rows of the last anchor wait for the next batch
        for batch in batches:
            anchor = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            home = batch.column(2).to_numpy(zero_copy_only=False)
            if big is not None:  # a group past the limit goes through as it comes
                same = int(np.searchsorted(anchor, big, side="right"))
                if same:
                    yield out([fp[:same]], [fp[:same]], True)
                    anchor, fp, home = anchor[same:], fp[same:], home[same:]
                if not len(anchor):
                    continue
                big = None
            if held:
                anchor, fp, home = (np.concatenate([x[i] for x in held] + [y]) for i, y in enumerate((anchor, fp, home)))
                held, n_held = [], 0
            cut = int(np.searchsorted(anchor, anchor[-1], side="left")) if len(anchor) else 0
            if cut:
                yield from settle(anchor[:cut], fp[:cut], home[:cut])
            if len(anchor) - cut > limit:
                big = anchor[-1]
                yield out([fp[cut:]], [fp[cut:]], True)
            elif len(anchor) > cut:
                held = [(anchor[cut:], fp[cut:], home[cut:])]
        if held:
            yield from settle(*held[0])

    return run


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.concatenate([[0], [1 << i for i in range(64)]]).astype(np.uint64)
    two = np.array([(1 << i) | (1 << j) for i in range(64) for j in range(i)], np.uint64)
    flips, near = np.concatenate([one, two]), np.arange(len(one) + len(two)) < len(one)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 64):
            part = fps[i : i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(np.tile(near, len(part)))], ["z", "fp", "near"]
            )


def _dense_links(fps: DataFrame) -> DataFrame:
    """Links among many fingerprints, linear in their number and without comparing pairs.

    x and y differ in three bits or fewer exactly if some z is within one bit of y and two of
    x. Each fingerprint goes to the 2,081 points z within two bits; where a point has a
    member within one bit, all its members are linked to the least such member.
    """
    points = fps.mapInArrow(_ball, "z long, fp long, near boolean")
    least = points.where("near").groupBy("z").agg(F.min("fp").alias("b"))
    return points.join(least, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that span the components of all links."""
    met = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean").repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = common.stored(met.mapInArrow(_compare(group_limit), "a long, b long, dense boolean"), "simhash-links")
    edges = found.where("not dense").select("a", "b")
    dense = found.where("dense").select(F.col("a").alias("fp")).distinct()
    if found.where("dense").limit(1).count():
        edges = edges.union(_dense_links(dense))
    return edges


def near_duplicates(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id, n_same).

    fingerprint is 16 hex digits; component_id is the least doc_id that links reach. Texts are
    compared by fingerprint once for each distinct fingerprint, so copies cost nothing.
    n_same counts the documents with the same fingerprint. A null text counts as empty; texts
    without words have fingerprint zero and are linked with each other like any others. Rows
    with a null doc_id keep a row and do not take part in component ids. Repeated doc_ids keep
    a row each. Texts are read whole, however long; an empty table gives no rows. A difference of
    exactly three bits links. Other columns of docs are ignored.
    """
    prints = common.stored(fingerprints(docs), "simhash-prints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_same")).checkpoint()
    roots = connected_components(links(groups, group_limit))
    joined = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n_same", F.coalesce("root", "fp").alias("root"))
    joined = joined.checkpoint()
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.join(ids, "root").select("fp", "component_id", "n_same")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the least doc_id, with its own columns.

    Rows with a null doc_id stay; of several rows with one doc_id one stays.
    """
    groups = near_duplicates(docs.where("doc_id is not null"))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(checked(common.stored(gone, "simhash-gone")), "doc_id", "left_anti").select(docs.columns)
    twice = checked(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if not twice.limit(1).count():
        return left
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).union(left.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE_SQL: dict[str, str] = {}
