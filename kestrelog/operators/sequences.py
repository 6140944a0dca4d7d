"""User-hour sequences: units, chunks, padding, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions.clock import day_of, hour_start

UNIT = ["acting_user", "hour"]
def in_hour():
    """The order of events within their unit."""
    return Window.partitionBy(*UNIT).orderBy("timestamp", "source_line")



def with_unit(events: DataFrame) -> DataFrame:
    """Adds the hour and the position within the user's hour, from 0."""
    return events.withColumn("hour", hour_start(F.col("timestamp"))).withColumn("position", (F.row_number().over(in_hour()) - 1).cast("long"))


def reference_mismatches(rows: DataFrame) -> DataFrame:
    """rows (source_line, source_reference) whose reference is missing or names another line; every row is looked at."""
    from kestrelog.functions.accounts import reference_line

    named = reference_line(F.col("source_reference"))
    return rows.where(~named.eqNullSafe(F.col("source_line")) | ~F.col("source_reference").eqNullSafe(F.concat(F.lit("auth.txt:"), F.col("source_line").cast("string"))))


def user_hours(events: DataFrame, start: int = 1) -> DataFrame:
    """A row per user-hour: events, complete 24 h history, events touching excluded users (if flagged), lines in order."""
    touching = F.count_if("touches_excluded") if "touches_excluded" in events.columns else F.lit(0).cast("long")
    return events.withColumn("hour", hour_start(F.col("timestamp"))).groupBy(*UNIT).agg(
        F.count("*").alias("n_events"), F.bool_and(F.col("timestamp") >= start + 86_400).alias("complete"), touching.alias("touching_excluded"),
        F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "source_line"))), lambda x: x["source_line"]).alias("lines"),
    ).withColumn("dataset_day", day_of(F.col("hour")))


def fitting_eligible(units: DataFrame) -> DataFrame:
    """units with status and split -> adds fits: available training units without excluded users."""
    return units.withColumn("fits", (F.col("status") == "available") & (F.col("split") == "train") & (F.col("touching_excluded") == 0))


def chunks(units: DataFrame, longest: int) -> DataFrame:
    """(unit keys, chunk, start, length): ceil(n / longest) contiguous slices whose lengths differ by one at most."""
    k = F.ceil(F.col("n_events") / longest)
    each = units.select(*UNIT, "n_events", k.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("chunk"))
    base, rest = F.floor(F.col("n_events") / F.col("k")), F.col("n_events") % F.col("k")
    return each.select(*UNIT, "chunk", (F.col("chunk") * base + F.least("chunk", rest)).alias("start"), (base + (F.col("chunk") < rest).cast("long")).alias("length"))


def chunk_of(position: Column, n: Column, longest: int) -> Column:
    """The chunk that holds a position."""
    k = F.ceil(n / longest)
    base, rest = F.floor(n / k), n % k
    return F.when(position < rest * (base + 1), F.floor(position / (base + 1))).otherwise(rest + F.floor((position - rest * (base + 1)) / base))


def padded(values: Column, length: int, fill: Column) -> Column:
    """An array cut or filled on the right to a length."""
    return F.concat(F.slice(values, 1, length), F.array_repeat(fill, F.greatest(F.lit(0), F.lit(length) - F.size(values)).cast("int")))


def mask(values: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= F.size(values))


def manifest(units: DataFrame, longest: int) -> DataFrame:
    """Per split and status: units, events, percentiles of the hour's length, chunks, share of hours that fit one chunk."""
    return units.groupBy("split", "status").agg(
        F.count("*").alias("units"), F.sum("n_events").alias("events"), F.percentile("n_events", [0.5, 0.9, 0.99]).alias("percentiles"),
        F.sum(F.ceil(F.col("n_events") / longest)).alias("chunks"), F.avg((F.col("n_events") <= longest).cast("double")).alias("share_single"),
    )


def sample_chunks(found: DataFrame, cap: int, k: int, draw: Column | None = None) -> DataFrame:
    """At most cap chunks of an hour and k in all, drawn by a seeded hash."""
    order = draw if draw is not None else F.xxhash64(F.lit(42), *UNIT, "chunk")
    keyed = found.withColumn("draw", order)
    capped = keyed.withColumn("n", F.row_number().over(Window.partitionBy(*UNIT).orderBy("draw", "chunk"))).where(F.col("n") <= cap)
    return capped.orderBy("draw", *UNIT, "chunk").limit(k).drop("n")


def stratified_sample(units: DataFrame, longest: int, per: int, draw: Column | None = None) -> DataFrame:
    """So many single-chunk and multi-chunk units."""
    order = draw if draw is not None else F.xxhash64(F.lit(42), *UNIT)
    kind = F.when(F.col("n_events") > longest, "multi").otherwise("single")
    keyed = units.withColumns({"kind": kind, "draw": order})
    return keyed.where(F.col("kind") == "single").orderBy("draw", *UNIT).limit(per).union(keyed.where(F.col("kind") == "multi").orderBy("draw", *UNIT).limit(per))


def no_activity(requested: DataFrame, scored: DataFrame) -> DataFrame:
    """Requested units that were not scored, with a status and null scores."""
    missing = requested.join(scored.select(*UNIT), UNIT, "left_anti")
    return missing.select(*UNIT, F.lit("no_activity").alias("status"), F.lit(0).cast("long").alias("n_events"), F.lit(None).cast("double").alias("score"))
