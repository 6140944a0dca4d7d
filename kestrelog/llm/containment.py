"""Containment search: which short texts (items) lie inside which long ones (documents).

Both sides are sets of five-word shingles. Plain MinHash estimates the Jaccard similarity, which
is tiny for a short item in a long document, so the sketch is taken of the item alone and sizes
are partitioned. Items are classed by size: an item of up to BANDS shingles is sketched by all
of them, a larger one by the shingles that are least under BANDS seeded hash functions, one row
a band. A document (or window) collides in a band if it holds that shingle, which for
containment c happens with probability c: at c = 0.8 and 8 bands a true match is missed with
probability 0.2^8 < 3e-6. This is the collision of the item's minimum with the minimum over the
document's part of the item, and needs one hash per document shingle whatever the bands.
Documents with fewer shingles than the threshold asks for are never paired with the item.
Candidates are verified by exact shingle containment, on the words themselves.

Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS = 5
BANDS = 8
THRESHOLD = 0.8
#: Rows up to which a counted side is broadcast; beyond it the join is left to Spark's shuffle.
BROADCAST_ROWS = 500_000


def checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has been counted to have few rows. df must be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _each(words: Column, k: int, f) -> Column:
    """f(word array, start) for each run of k words, as an array. words is evaluated once a row."""
    inner = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: f(w, i)))
    return F.transform(F.array(words), inner)[0]


def shingle_keys(words: Column, k: int) -> Column:
    """64-bit hashes of the runs of k words, in order; null if there are none."""
    return _each(words, k, lambda w, i: F.xxhash64(*[w[i + j] for j in range(k)]))


def shingles(words: Column, k: int) -> Column:
    """The runs of k words, space-joined, in order; null if there are none."""
    return _each(words, k, lambda w, i: F.concat_ws(" ", F.slice(w, i + 1, k)))


def short_items(items: DataFrame, words, least_words: int) -> DataFrame:
    """(item, n_words): what item_shingles leaves out, texts of one to least_words - 1 words."""
    return items.where("item is not null").select("item", F.size(words(F.col("text"))).cast("long").alias("n_words")).where(F.col("n_words").between(1, least_words - 1))


def item_shingles(items: DataFrame, words, least_words: int = 1) -> DataFrame:
    """items (item, text) -> distinct (item, k, s, key, n): n shingles of k words.

    k is five, or the number of words of a shorter item, which then is one shingle. Texts of
    fewer than least_words words, or of none, give no rows. Repeated items count once; the texts of one id are pooled.
    """
    found = items.where("item is not null").select("item", words(F.col("text")).alias("w")).where(F.size("w") >= max(1, least_words))
    sized = found.select("item", "w", F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("k")).checkpoint()
    parts = None
    for k in range(1, SHINGLE_WORDS + 1):
        part = sized.where(F.col("k") == k).select("item", "k", F.explode(F.arrays_zip(shingles(F.col("w"), k).alias("s"), shingle_keys(F.col("w"), k).alias("key"))).alias("x")).select("item", "k", "x.s", "x.key")
        parts = part if parts is None else parts.union(part)
    parts = parts.distinct()
    return parts.join(parts.groupBy("item").agg(F.count("*").alias("n")), "item")


def sketch(parts: DataFrame, bands: int = BANDS) -> DataFrame:
    """item_shingles -> (item, k, key, n): the rows that documents are probed with."""
    small = parts.where(F.col("n") <= bands).select("item", "k", "key", "n")
    seeded = parts.where(F.col("n") > bands).withColumn("band", F.explode(F.sequence(F.lit(1), F.lit(bands))))
    least = seeded.groupBy("item", "k", "n", "band").agg(F.min_by("key", F.struct(F.xxhash64("band", "s"), "s")).alias("key"))
    return small.union(least.select("item", "k", "key", "n")).distinct()


def candidates(docs: DataFrame, probes: DataFrame, lengths: list[int], words, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item, pos): where a document's shingle is in an item's sketch. pos counts words from 0."""
    out = None
    for k in lengths:
        keys = docs.select("doc_id", shingle_keys(words(F.col("text")), k).alias("keys"))
        rows = keys.select("doc_id", F.size("keys").alias("size"), F.posexplode("keys").alias("pos", "key"))
        mine = checked(probes.where(F.col("k") == k).drop("k"))
        hit = rows.join(mine, "key").where(F.col("size") >= F.ceil(F.col("n") * threshold))
        hit = hit.select("doc_id", "item", "pos")
        out = hit if out is None else out.union(hit)
    return out


def shared_shingles(docs: DataFrame, pairs: DataFrame, parts: DataFrame, lengths: list[int], words) -> DataFrame:
    """For candidate pairs (doc_id, item): every exact common shingle (doc_id, item, n, s, pos)."""
    ids = checked(pairs.select("doc_id").distinct())
    wanted = docs.join(ids, "doc_id", "left_semi")
    out = None
    for k in lengths:
        rows = wanted.select("doc_id", F.posexplode(shingles(words(F.col("text")), k)).alias("pos", "s"))
        hit = rows.join(checked(parts.where(F.col("k") == k)), "s").select("doc_id", "item", "n", "s", "pos")
        out = hit if out is None else out.union(hit)
    return out.join(pairs.select("doc_id", "item").distinct(), ["doc_id", "item"], "left_semi")


def prepare(items: DataFrame, words, least_words: int = 1) -> tuple[DataFrame, DataFrame, list[int]]:
    """Item shingles and sketch as stored tables, and the shingle lengths that occur (1 to 5)."""
    parts = common.stored(item_shingles(items, words, least_words), "item-shingles")
    lengths = sorted(r.k for r in parts.select("k").distinct().collect())
    return parts, common.stored(sketch(parts), "item-sketch"), lengths or [SHINGLE_WORDS]
