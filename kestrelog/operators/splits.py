"""Splits by time, labels, eligibility and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions.clock import between_days, day_bounds, day_of, hour_index, hour_start

#: (name, first day, last day)
POLICY = [("train", 1, 7), ("validation", 8, 16), ("test", 17, 30)]


def check_policy(policy: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Splits follow each other without gap or overlap."""
    for (_, _, last), (name, first, _) in zip(policy, policy[1:]):
        if first != last + 1:
            raise ValueError(f"{name} begins on day {first}, not {last + 1}")
    return policy


def split_of(t: Column, policy: list[tuple[str, int, int]] = POLICY) -> Column:
    """The split of a second; null outside all."""
    out = F.lit(None).cast("string")
    for name, first, last in reversed(check_policy(policy)):
        low, high = day_bounds(first, last)
        out = F.when((t >= low) & (t < high), name).otherwise(out)
    return out


def excluded_users(labels: DataFrame, policy: list[tuple[str, int, int]] = POLICY) -> DataFrame:
    """Users with a label inside training."""
    return labels.where(split_of(F.col("timestamp"), policy) == "train").select("user").distinct()


def with_eligibility(events: DataFrame, excluded: DataFrame) -> DataFrame:
    """Adds touches_excluded: the source or destination user is excluded."""
    for side in ("source_user", "destination_user"):
        flag = excluded.select(F.col("user").alias(side), F.lit(True).alias(f"__{side}"))
        events = events.join(flag, side, "left")
    return events.withColumn("touches_excluded", F.coalesce("__source_user", "__destination_user", F.lit(False))).drop("__source_user", "__destination_user")


def fitting_events(events: DataFrame, excluded: DataFrame) -> DataFrame:
    """Events of which neither user is excluded."""
    for side in ("source_user", "destination_user"):
        events = events.join(excluded.select(F.col("user").alias(side)), side, "left_anti")
    return events


def deduplicate_labels(labels: DataFrame) -> DataFrame:
    """The first line of each (timestamp, user, source, destination)."""
    w = Window.partitionBy("timestamp", "user", "source_computer", "destination_computer").orderBy("source_line")
    return labels.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def label_hours(labels: DataFrame) -> DataFrame:
    """Distinct (user, hour) units of labels."""
    return labels.select("user", hour_start(F.col("timestamp")).alias("hour")).distinct()


def positive_hours(labels: DataFrame, split: str, allow_test: bool = False, policy: list[tuple[str, int, int]] = POLICY) -> DataFrame:
    if split == "test" and not allow_test:
        raise ValueError("test labels are not to be read")
    return label_hours(deduplicate_labels(labels).where(split_of(F.col("timestamp"), policy) == split))


def replay(events: DataFrame, first_day: int, last_day: int, history_seconds: int = 0) -> DataFrame:
    """Events of the days, and of so many seconds before, in order; days prune partitions."""
    low, high = day_bounds(first_day, last_day)
    low = max(1, low - history_seconds)
    return between_days(events, (low - 1) // 86_400 + 1, last_day).where((F.col("timestamp") >= low) & (F.col("timestamp") < high)).orderBy("timestamp", "source_line")


def graph_history_status(window_end: Column, need: int = 86_400, origin: int = 1) -> Column:
    return F.when(window_end - need >= origin, "available").otherwise("insufficient_history")


def candidate_status(units: DataFrame, min_events: int, last_day: int, policy: list[tuple[str, int, int]] = POLICY) -> DataFrame:
    """units (hour, n_events, complete) -> status by the first rule that applies."""
    _, end = day_bounds(1, last_day)
    status = (
        F.when((F.col("hour") < 1) | (F.col("hour") >= end), "out_of_bounds").when(split_of(F.col("hour"), policy).isNull(), "outside_splits")
        .when((F.col("hour") - 1) % 3600 != 0, "not_an_hour").when(~F.col("complete"), "warmup_incomplete_24h_history").when(F.col("n_events") < min_events, "fewer_than_min_events").otherwise("available")
    )
    return units.withColumn("status", status)


def label_statistics(labels: DataFrame, policy: list[tuple[str, int, int]] = POLICY) -> DataFrame:
    """Per split: rows, unique labels, duplicates, units, distinct users and hosts, days."""
    named = labels.withColumn("split", split_of(F.col("timestamp"), policy))
    key = F.struct("timestamp", "user", "source_computer", "destination_computer")
    out = named.groupBy("split").agg(
        F.count("*").alias("rows"), F.countDistinct(key).alias("unique_labels"), F.countDistinct("user", hour_start(F.col("timestamp"))).alias("units"), F.countDistinct("user").alias("users"),
        F.countDistinct("source_computer").alias("sources"), F.countDistinct("destination_computer").alias("destinations"), F.sort_array(F.collect_set(day_of(F.col("timestamp")))).alias("days"),
    )
    return out.withColumn("duplicates", F.col("rows") - F.col("unique_labels"))


def split_summary(events: DataFrame, excluded: DataFrame, policy: list[tuple[str, int, int]] = POLICY) -> DataFrame:
    """Per split: events, share, events that touch excluded users, graph-eligible events."""
    named = with_eligibility(events, excluded).withColumn("split", split_of(F.col("timestamp"), policy))
    out = named.groupBy("split").agg(F.count("*").alias("events"), F.count_if("touches_excluded").alias("touching_excluded"), F.count_if(F.col("timestamp") >= 86_401).alias("graph_eligible"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return out.withColumn("percent", F.round(100.0 * F.col("events") / F.sum("events").over(Window.partitionBy(F.lit(1))), 6))  # a row for each split


def matched_labels(labels: DataFrame, events: DataFrame, policy: list[tuple[str, int, int]] = POLICY) -> DataFrame:
    """Per split and day: labels, and labels with and without a matching event."""
    keys = events.select("timestamp", F.col("acting_user").alias("user"), "source_computer", "destination_computer").distinct().withColumn("found", F.lit(True))
    joined = deduplicate_labels(labels).join(keys, ["timestamp", "user", "source_computer", "destination_computer"], "left")
    named = joined.select(split_of(F.col("timestamp"), policy).alias("split"), day_of(F.col("timestamp")).alias("day"), "found")
    return named.groupBy("split", "day").agg(F.count("*").alias("labels"), F.count_if("found").alias("matched"), F.count_if(F.col("found").isNull()).alias("unmatched"))


def attack_events(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Labels with the log lines that match all four keys."""
    e = events.select("timestamp", F.col("acting_user").alias("user"), "source_computer", "destination_computer", F.col("source_line").alias("event_line"), "authentication_type", "authentication_result")
    return labels.join(e, ["timestamp", "user", "source_computer", "destination_computer"], "left")


def timeline(t: Column) -> list[Column]:
    return [day_of(t).alias("day"), hour_start(t).alias("hour"), hour_index(t).alias("hour_index")]
