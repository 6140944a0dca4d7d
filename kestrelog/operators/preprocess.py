"""Preprocessing that is fitted on training rows only: moments, vocabularies, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions import tables

NUMERIC = ["prior_auth_count_1h", "prior_failure_count_1h", "seconds_since_previous_auth", "prior_unique_destinations_24h", "prior_user_destination_count_24h"]
BINARY = ["has_user_history", "is_new_user_destination", "is_new_user_source", "is_new_host_connection", "is_machine_account", "history_complete_1h", "history_complete_24h"]
CATEGORICAL = ["authentication_type", "logon_type", "authentication_orientation", "authentication_result"]
BARRED = {"timestamp", "source_line", "dataset_day", "acting_user", "source_user", "destination_user", "source_computer", "destination_computer"}
UNSEEN, MISSING, FIRST_ID = 0, 1, 2
PLACEHOLDER = 0.0
#: Values of all vocabularies together up to which they are looked up in a map.
MAPPED = 1_000


def check_inputs(columns: list[str]) -> list[str]:
    """Time and identity columns are barred from model inputs."""
    if bad := BARRED & set(columns):
        raise ValueError(f"barred model inputs: {sorted(bad)}")
    return columns


def _long(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double" if name == "value" else "string").alias("value")) for c in columns])).alias("x")).select("x.feature", "x.value")


def fit_numeric(train: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """(feature, n, mean, std, scale) of ln(1 + x), nulls skipped; scale is 1 for a constant or single value."""
    stats = _long(train, check_inputs(columns), "value").groupBy("feature").agg(F.count("value").alias("n"), F.avg(F.log1p("value")).alias("mean"), F.stddev_pop(F.log1p("value")).alias("std"))
    return stats.withColumn("scale", F.when((F.col("n") <= 1) | (F.col("std") < 1e-12), F.lit(1.0)).otherwise(F.col("std")))


def fit_vocabulary(train: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """(feature, value, id): distinct non-empty values in order, ids from 2."""
    values = _long(train, check_inputs(columns), "text").where("value is not null and value <> ''").distinct()
    return values.withColumn("id", (F.row_number().over(Window.partitionBy("feature").orderBy("value")) + (FIRST_ID - 1)).cast("int"))


def standardise(df: DataFrame, stats: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Adds <column>_z as floats; a missing gap gets the placeholder. stats has a row for each column."""
    fitted = {r.feature: r for r in stats.where(F.col("feature").isin(columns)).collect()}
    return df.withColumns({f"{c}_z": F.coalesce(((F.log1p(c) - F.lit(fitted[c].mean)) / F.lit(fitted[c].scale)).cast("float"), F.lit(PLACEHOLDER).cast("float")) for c in columns})


def binary_inputs(df: DataFrame, columns: list[str] = BINARY) -> DataFrame:
    return df.withColumns({f"{c}_f": F.col(c).cast("float") for c in columns})


def encode(df: DataFrame, vocabulary: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """Adds <column>_id: the vocabulary's id, 0 for unseen, 1 for null or empty values.

    A vocabulary of at most MAPPED values becomes a map in the plan; a larger one is joined, column by column.
    """
    small = vocabulary.where(F.col("feature").isin(columns)).limit(MAPPED + 1).collect()
    if len(small) <= MAPPED:
        ids = {c: [F.lit(x) for r in small if r.feature == c for x in (r.value, r.id)] for c in columns}
        found = {c: F.create_map(*ids[c])[F.col(c)] if ids[c] else F.lit(None).cast("int") for c in columns}
        return df.withColumns({f"{c}_id": F.when(F.col(c).isNull() | (F.col(c) == ""), MISSING).otherwise(F.coalesce(found[c], F.lit(UNSEEN))) for c in columns})
    for c in columns:
        ids = vocabulary.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("id").alias(f"{c}_id"))
        df = df.join(tables.checked(ids), c, "left").withColumn(f"{c}_id", F.when(F.col(c).isNull() | (F.col(c) == ""), MISSING).otherwise(F.coalesce(f"{c}_id", F.lit(UNSEEN))))
    return df


def fitting_counts(df: DataFrame) -> DataFrame:
    """Rows per split, and how many are fitted on and skipped (columns split, fits)."""
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.count_if("fits").alias("fitted"), F.count_if(~F.col("fits")).alias("skipped"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a digest of a fitted table's content, to refuse a transform under another one."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(df.columns)])
    return df.agg(F.md5(F.concat_ws("\n", F.sort_array(F.collect_list(text))).cast("binary")).alias("fingerprint"))


def verify_fingerprint(df: DataFrame, expected: str) -> None:
    if fingerprint(df).first().fingerprint != expected:
        raise ValueError("the fitted table is not the one that was frozen")
