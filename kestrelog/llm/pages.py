"""Main texts of web pages by comparing each page with the one nearest to it by URL on the same host.

Pages of a host are put in order of their paths; each is aligned, line by line, with its nearer
neighbour by longest common subsequence, and lines that both hold are deleted. Markup has the last
word where it speaks: lines of a marked article stay (two articles may share a passage), lines of
menus, notices and the like go, shared or not. Pages of equal lines are compared once, as one page.
Pages are parsed twice, for the hashes of their lines and for their text, which moves once and packed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, blocks, common

#: Two pages of which one has less than this share of its text to itself are copies, not neighbours.
OWN_SHARE = 0.1
#: How many ways the copies of one page are dealt out where they meet its result.
SALTS = 16



def _parsed(batch: pa.RecordBatch, column: int) -> Iterator[list[tuple[str, int]]]:
    for _, _, raw, offsets in common.text_blocks(batch.column(column), 1 << 22):
        data, cuts = raw.tobytes(), offsets.tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield blocks.lines(data[a:b].decode("utf-8", "replace"))


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, digests = [], [], []
        for lines in _parsed(batch, 1):
            keys.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in lines])
            sizes.append([0 if z == blocks.OUTSIDE else len(t) for t, z in lines])
            digests.append(hashlib.md5("\n".join(f"{z}{t}" for t, z in lines).encode()).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(digests, pa.binary())], ["row", "keys", "sizes", "digest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of the zone that a page's text is in, packed, and their numbers among all lines."""
    for batch in batches:
        zones, numbers, packed, counts = [], [], [], []
        for lines in _parsed(batch, 3):
            zone = max((z for _, z in lines if z != blocks.OUTSIDE), default=blocks.OUTSIDE)
            own = [] if zone == blocks.OUTSIDE else [i for i, (_, z) in enumerate(lines) if z == zone]
            zones.append(zone)
            numbers.append(own)
            packed.append(zlib.compress("\n".join(lines[i][0] for i in own).encode(), 3))
            counts.append(len(lines))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in range(3)], pa.array(zones, pa.int32()), pa.array(numbers, pa.list_(pa.int32())), pa.array(packed, pa.binary()), pa.array(counts, pa.int32())],
            ["row", "page_id", "url", "zone", "numbers", "packed", "n_lines"],
        )


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines that are shared with the partner, where the markup has not spoken."""
    for batch in batches:
        texts, shared_lines = [], []
        for zone, numbers, packed, shared in zip(*(batch.column(k) for k in (2, 3, 4, 6))):
            shared = shared.as_py() or []
            text = zlib.decompress(packed.as_py()).decode()
            if zone.as_py() == blocks.PLAIN and any(shared):
                text = "\n".join(t for i, t in zip(numbers.as_py(), text.split("\n")) if not shared[i])
            texts.append(text)
            shared_lines.append(sum(shared))
        lengths = [len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (0, 1)], pa.array(texts, pa.string()), pa.array(lengths, pa.int64()), batch.column(7), batch.column(5), pa.array(shared_lines, pa.int32())], _OUT_NAMES)


_OUT = "page_id long, url string, text string, n_chars long, partner_id long, n_lines int, n_shared int"
_OUT_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags = []
        columns = [[np.asarray(x.values) for x in batch.column(k)] for k in range(1, 5)]
        for keys, sizes, other_keys, other_sizes in zip(*columns):
            hit = alignment.shared(keys, other_keys)
            back = alignment.shared(other_keys, keys)
            own = min(s[~h].sum() / max(1, s.sum()) for s, h in ((sizes, hit), (other_sizes, back)))
            flags.append(hit if own >= OWN_SHARE else np.zeros(len(hit), bool))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.list_(pa.bool_()))], ["row", "shared"])


def keyed(pages: DataFrame) -> DataFrame:
    """pages with `row`, a digest of (page_id, url, html): rows that are alike in all three are one page."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-"))
    return pages.select(F.unhex(F.md5(F.concat(*[part(c) for c in ("page_id", "url", "html")]).cast("binary"))).alias("row"), "page_id", "url", "html")


def outlines(pages: DataFrame) -> DataFrame:
    """keyed() rows -> stored (row, page_id, host, path, digest, keys, sizes): hashes and lengths of a page's lines."""
    address = F.coalesce(F.lower("url"), F.lit(""))
    named = pages.select(
        "row",
        "html",
        "page_id",
        F.regexp_extract(address, r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1).alias("host"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1).alias("path"),
    )
    found = named.select("row", "html").mapInArrow(_outline, "row binary, keys array<long>, sizes array<int>, digest binary")
    names = named.select("row", "page_id", "host", "path").distinct()
    found = found.groupBy("row").agg(*[F.first(c).alias(c) for c in ("keys", "sizes", "digest")])
    return common.stored(names.join(found, "row"), "page-lines")


def _segments(a: str, b: str) -> Column:
    """Leading segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def neighbours(pages: DataFrame) -> DataFrame:
    """outlines() -> (row, partner, copies, host, digest): the first page of each text and the page nearest to it on its host.

    Order over all hosts is by ranges; places follow from the rows of each range, so no host is
    in one task. Of the pages before and after, the one that shares more leading path segments is nearer.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = pages.where("host <> ''").groupBy("host", "digest").agg(F.min(F.struct("path", "page_id", "row")).alias("at"), F.count("*").alias("copies")).select("host", "digest", "at.path", "at.page_id", "at.row", "copies")
    sorted_ = first.repartitionByRange(n, "host", "path", "page_id", "row").sortWithinPartitions("host", "path", "page_id", "row")
    sorted_ = common.stored(sorted_.withColumn("slot", F.monotonically_increasing_id()), "page-order")
    part = F.shiftright("slot", 33)
    sizes = sorted_.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per partition
    starts = np.cumsum([0, *[r["count"] for r in sizes]]).tolist()
    starts = spark.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts)], "part long, start long")
    placed = sorted_.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("slot").bitwiseAND((1 << 33) - 1))
    other = placed.select(F.col("host").alias("their_host"), F.col("path").alias("their_path"), F.col("row").alias("partner"), F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("place"), (F.col("place")).alias("their_place"))
    near = F.struct(_segments("path", "their_path").alias("same"), (-F.col("their_place")).alias("before"), "partner")
    met = placed.join(other, "place").where(F.col("host") == F.col("their_host"))
    return met.groupBy("row", "host", "digest", "copies").agg(F.max(near)["partner"].alias("partner"))


def page_texts(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> (page_id, url, text, n_chars, partner_id, n_lines, n_shared), a row for each row.

    The text is that of marked articles, else of a marked main part, without what stands outside
    (menus, headers, footers, sidebars, notices, adverts, forms, comments); else all lines that neither
    stand outside nor are shared with the nearest page. Of an article's header its headings stay. n_shared
    counts lines shared with partner_id, the nearest page; pages of equal lines have one partner. Copies
    (with less than 0.1 of text of their own) share nothing. Null and empty pages have an empty text; pages
    without a host are compared with none; null and repeated ids keep a row each; an empty table gives none.
    """
    pages = keyed(pages)
    found = outlines(pages)
    pairs = common.stored(neighbours(found), "page-pairs")
    theirs = found.select(F.col("row").alias("partner"), F.col("keys").alias("their_keys"), F.col("sizes").alias("their_sizes"))
    both = pairs.select("row", "partner").join(theirs, "partner").join(found.select("row", "keys", "sizes"), "row")
    flags = both.select("row", "keys", "sizes", "their_keys", "their_sizes").mapInArrow(_compare, "row binary, shared array<boolean>")
    names = found.select(F.col("row").alias("partner"), F.col("page_id").alias("partner_id"))
    flags = common.stored(pairs.join(flags, "row").join(names, "partner").select("row", "host", "digest", "copies", "shared", "partner_id"), "page-flags")
    more = flags.where("copies > 1").select("host", "digest", "shared", "partner_id", F.col("row").alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    copies = found.select("row", "host", "digest", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    copies = copies.join(more, ["host", "digest", "salt"]).where("row <> first").select("row", "shared", "partner_id")
    flags = flags.select("row", "shared", "partner_id").union(copies)
    texts = pages.mapInArrow(_texts, "row binary, page_id long, url string, zone int, numbers array<int>, packed binary, n_lines int")
    out = texts.join(flags, "row", "left")
    return out.select("page_id", "url", "zone", "numbers", "packed", "n_lines", "shared", "partner_id").mapInArrow(_join, _OUT)


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(common.table(spark, sf_dir, "pages"))


QUERIES = {"op12_html_text": op12_html_text}
ORACLE_SQL: dict[str, str] = {}
