"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds as numpy arrays at a time.
BLOCK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and one machine does all, as in tests."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path is None:
        path = sc.getCheckpointDir()
        if path is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="spark-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and is computed once."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that what is made of one at a time stays small; memory goes back when there are no more."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on from task to task and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def fold(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(column: Column) -> Column:
    """Lower-cased words between runs of ASCII white space; null and blank texts have none."""
    parts = F.split(F.trim(F.regexp_replace(fold(F.coalesce(column, F.lit(""))), r"[\x20\x09-\x0D]+", " ")), " ")
    return F.filter(parts, lambda w: w != "")


def shard_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of an Arrow string column as (first row, end row, bytes, offsets), each of about `limit` bytes.

    Nulls count as empty texts. A text longer than the limit makes a slice of its own.
    """
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def pieces(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, cuts): what lies between offsets in parts [a, b) of a size at most, and the offsets within each part."""
    for a in range(int(offsets[0]), int(offsets[-1]), size):
        b = min(a + size, int(offsets[-1]))
        yield a, b, np.clip(offsets, a, b) - a


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between successive offsets; empty ranges sum to zero. Long ranges are summed in pieces."""
    sums = np.zeros((len(offsets) - 1, *values.shape[1:]))
    for a, b, cuts in pieces(offsets):
        total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values[a:b], axis=0, dtype=np.float64)])
        sums += total[cuts[1:]] - total[cuts[:-1]]
    return sums
