"""Token counts through a digest cache.

The cache is a Parquet table (digest, version, n_tokens): the SHA-256 of the normalised content
and of the tokenizer's file and library. Only distinct contents that the cache does not hold are
encoded; their counts are appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: A digest with more than one HOT_PARTS-th of the rows is hot; there are fewer than HOT_PARTS of them, whatever the data.
HOT_PARTS = 1000
#: Missing digests up to which they are broadcast to the texts.
MISSES = 200_000
_LOADED: dict[str, object] = {}


def tokenizer_version(model: str = MODEL) -> str:
    """Names the counting rule: the library and its version, and the model file's digest."""
    import sentencepiece

    return f"sentencepiece-{sentencepiece.__version__}-{hashlib.sha256(Path(public_tokenizers.path(model)).read_bytes()).hexdigest()[:16]}"


def _counter(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        if model not in _LOADED:
            _LOADED[model] = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        encode = _LOADED[model].encode
        for batch in batches:
            counts: list[int] = []
            for first, end, _, _ in common.text_blocks(batch.column(1), 1 << 18):
                counts += map(len, encode(batch.column(1).slice(first, end - first).to_pylist(), num_threads=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def normalised(text):
    """What is counted and digested: the text itself, a null as empty. Anything more would change counts."""
    return F.coalesce(text, F.lit(""))


def _digest(text):
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer; a cache that does not exist yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    held = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two jobs may have appended the same


def _texts(docs: DataFrame) -> DataFrame:
    """(digest, text), each task sending a content on once, so that a text with many copies does not gather."""
    return docs.groupBy("digest").agg(F.min("text").alias("text"))


def fill_cache(docs: DataFrame, digests: DataFrame, cache: str, model: str = MODEL) -> None:
    """Encodes the texts of docs whose digests the cache lacks, once each, and appends their counts.

    digests are asked of the cache first, so that only missing texts move. Where nothing is
    held all texts are missing; where too many are missing to be broadcast, distinct texts meet
    the missing digests in a shuffle.
    """
    spark, version = docs.sparkSession, tokenizer_version(model)
    held = cached_counts(spark, cache, version)
    texts = docs.select(_digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("text"))
    if held.limit(1).count():
        missing = common.stored(digests.select("digest").join(held, "digest", "left_anti"), "token-misses")
        if missing.limit(MISSES + 1).count() <= MISSES:
            misses = _texts(texts.join(F.broadcast(missing), "digest", "left_semi"))
        else:
            misses = _texts(texts).join(missing, "digest", "left_semi")
    else:
        misses = _texts(texts)
    counts = misses.select("digest", "text").mapInArrow(_counter(model), "digest binary, n_tokens long")
    counts.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, cache: str, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_tokens, over_limit), a row for each row, through the cache.

    A null text counts as empty, which has no tokens. Texts are counted whole, however long.
    Null and repeated doc_ids keep their rows; an empty table gives no rows; other columns are
    ignored. Rows of hot digests meet their counts by a broadcast, the others by a shuffle.
    """
    keys = docs.select("doc_id", F.octet_length(normalised(F.col("text"))).cast("long").alias("n_bytes"), _digest(F.col("text")).alias("digest"))
    keyed = common.stored(keys, "token-digests")
    digests = common.stored(keyed.groupBy("digest").agg(F.count("*").alias("rows")), "token-distinct")
    fill_cache(docs, digests, cache, model)
    counts = cached_counts(docs.sparkSession, cache, tokenizer_version(model))
    total = keyed.count()
    hot = digests.where(F.col("rows") * HOT_PARTS > total)
    hot = F.broadcast(common.stored(hot.select("digest").join(counts, "digest").withColumnRenamed("n_tokens", "hot"), "token-hot"))
    near = keyed.join(hot, "digest", "left")
    told = near.where("hot is not null").select("doc_id", "n_bytes", F.col("hot").alias("n_tokens"))
    rest = near.where("hot is null").drop("hot").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
    return told.union(rest).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that its work does not depend on earlier runs."""
    return token_counts(common.table(spark, sf_dir, "documents"), common.fresh_path(spark, "token-cache"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
