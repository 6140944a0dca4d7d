"""Media columns: payloads stored as lossless WebP images, read back as pixel arrays.

A payload is one image of 16 pixels a row, four samples a pixel, or several images of 128 rows
each and the rest. Short images let a task decode many of them pixel by pixel together, however
long a text is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, webp, webp_encoder

ALIGN = 64
#: A row of pixels holds 64 bytes, four samples a pixel; an image has at most so many rows.
ROW_PIXELS, ROWS = ALIGN // 4, 128
#: Bytes of media that are decoded together.
MEDIA_BYTES = 1 << 22


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def to_media(payloads: list[bytes]) -> list[bytes]:
    """Payloads (multiples of 64 bytes) -> the files of each, one after the other."""
    pixels = [np.frombuffer(x, np.uint8).reshape(-1, ROW_PIXELS, 4) for x in payloads]
    files = iter(webp_encoder.encode_many([p[i : i + ROWS] for p in pixels for i in range(0, len(p), ROWS)]))
    return [b"".join(next(files) for _ in range(0, len(p), ROWS)) for p in pixels]


def from_media(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each, in order."""
    chunks = [webp.chunks_of(x) for x in media]
    pixels = iter(webp.decode_many([c for x in chunks for c in x]))
    return [np.concatenate([next(pixels).reshape(-1) for _ in x]) for x in chunks]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash of an 8 by 8 reduction."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    deviation = float(np.sqrt(counts @ (np.arange(256) - mean) ** 2 / len(samples)))
    cuts = np.linspace(0, len(samples), 65).astype(np.int64)
    sums = np.add.reduceat(samples, cuts[:-1], dtype=np.int64) / np.diff(cuts)
    bits = np.packbits(sums > sums.mean()).tobytes().hex()
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};hash={bits}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, offsets in common.text_blocks(batch.column(1)):
            data, cuts = raw.tobytes(), offsets.tolist()
            media = to_media([padded(data[a:b]) for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for _, _, raw, offsets in common.text_blocks(batch.column(2), MEDIA_BYTES):
            data, cuts = raw.tobytes(), offsets.tolist()
            media = [data[a:b] for a, b in zip(cuts, cuts[1:])]
            for stored, samples in zip(media, from_media(media)):
                raw = samples.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ALIGN:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(samples)))
        columns = [list(c) for c in zip(*rows)] if rows else [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names)


def store(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, media): UTF-8, padded with zero bytes, as images. A null text is empty."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> digests and features of the decoded samples."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)


def media_features(docs: DataFrame) -> DataFrame:
    """documents -> a row for each row: stored as images in the shared folder, read back and described.

    Equal texts give equal values: a file follows from the payload alone. Null ids and repeated
    rows keep their rows; null and empty texts are 64 zero bytes; texts of any length are stored
    whole; an empty table gives no rows; other columns are ignored.
    """
    return features(common.stored(store(docs), "media"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_media": op8_media}
ORACLE_SQL: dict[str, str] = {}
