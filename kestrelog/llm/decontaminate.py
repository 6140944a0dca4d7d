"""Benchmark decontamination: documents that hold test items, by size-partitioned containment search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, containment

THRESHOLD = containment.THRESHOLD
#: Shorter items are not looked for; left_out() lists them. With 1 every item is, and one of a word marks all documents that use it.
LEAST_WORDS = 1


def left_out(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, n_words) of the items that are too short to be looked for."""
    return containment.short_items(benchmark.select(F.col("item_id").alias("item"), "text"), common.words, least_words).withColumnRenamed("item", "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """documents, benchmark (item_id, text) -> (doc_id, item_id, n_shared, n_item, containment).

    A row for each document that holds at least 0.8 of an item's distinct five-word shingles,
    lower-cased (A-Z) and split at ASCII white space. Items of fewer than least_words words are
    left out; with least_words below five a shorter item is one shingle of its own length. Null and blank texts and null ids match nothing; texts of a
    repeated doc_id or item_id are pooled; other columns are ignored. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").alias("item"), "text")
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    parts, probes, lengths = containment.prepare(items, common.words, least_words)
    pairs = common.stored(containment.candidates(docs, probes, lengths, common.words).select("doc_id", "item").distinct(), "leak-candidates")
    shared = containment.shared_shingles(docs, pairs, parts, lengths, common.words)
    counted = shared.groupBy("doc_id", "item").agg(F.countDistinct("s").alias("n_shared"), F.max("n").alias("n_item"))
    share = F.round(F.col("n_shared") / F.col("n_item"), 6)
    return counted.where(F.col("n_shared") >= F.ceil(F.col("n_item") * THRESHOLD)).select("doc_id", F.col("item").alias("item_id"), "n_shared", "n_item", share.alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that hold no benchmark item of least_words words or more; rows with a null doc_id stay."""
    leaks = common.stored(contaminated(docs, benchmark, least_words).select("doc_id").distinct(), "leaks")
    return docs.join(containment.checked(leaks), "doc_id", "left_anti").select(docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL_WORDS = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT item_id, {SQL_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest([array_to_string(w[j:j + least(len(w), 5) - 1], ' ') FOR j IN range(1, len(w) - least(len(w), 5) + 2)]) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
p AS (SELECT DISTINCT doc_id, 5 AS k, unnest([array_to_string(w[j:j + 4], ' ') FOR j IN range(1, len(w) - 3)]) AS s FROM d WHERE len(w) >= 5),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM p JOIN i USING (s) WHERE i.k = 5 GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.8)
"""

QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE_SQL = {"op2_decontamination": SQL}
