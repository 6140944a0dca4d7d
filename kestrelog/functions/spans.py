"""Joins of intervals [start, end) by the bins of time that they touch, so that no key's whole history meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(t: Column, width: int) -> Column:
    return F.floor((t - 1) / width)


def binned(spans: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each bin that a span touches: __bin, and __first, the first of them. Empty spans touch none."""
    first = _bin(F.col(start), width)
    return spans.where(F.col(start) < F.col(end)).withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, _bin(F.col(end) - 1, width))))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Rows of a (start, end) with those of b (their_start, their_end) of the same keys that overlap them, each pair once.

    A pair meets in every bin that both touch and is kept in the first of these. how: inner, or left, which keeps
    rows of a without a partner as well (in each of their bins: use it below an aggregate only).
    """
    theirs = binned(b, width, "their_start", "their_end").withColumnRenamed("__first", "__their_first")
    first = F.col("__bin") == F.greatest("__first", "__their_first")
    condition = (F.col("start") < F.col("their_end")) & (F.col("their_start") < F.col("end")) & first
    left, right = binned(a, width).alias("a"), theirs.withColumnsRenamed({c: f"__k_{c}" for c in keys}).withColumnRenamed("__bin", "__their_bin")
    same = F.col("__bin") == F.col("__their_bin")
    for c in keys:
        same &= F.col(c) == F.col(f"__k_{c}")
    joined = left.join(right, same & condition, how)
    return joined.drop("__bin", "__first", "__their_first", "__their_bin", *[f"__k_{c}" for c in keys])


def points_within(spans: DataFrame, points: DataFrame, keys: list[str], width: int, time: str = "timestamp") -> DataFrame:
    """Rows of points whose time lies in a span of the same keys, with the span's columns; a point is in one bin, so a pair meets once."""
    held = binned(spans, width).drop("__first")
    return points.withColumn("__bin", _bin(F.col(time), width)).join(held, [*keys, "__bin"]).where((F.col(time) >= F.col("start")) & (F.col(time) < F.col("end"))).drop("__bin")
