"""Dataset time: positive whole seconds from 1, with half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
HOUR = 3_600


def day_of(t: Column) -> Column:
    return (F.floor((t - 1) / DAY) + 1).cast("int")


def hour_start(t: Column) -> Column:
    return (F.floor((t - 1) / HOUR) * HOUR + 1).cast("long")


def hour_index(t: Column) -> Column:
    return (F.floor((t - 1) / HOUR) + 1).cast("long")


def day_bounds(first: int, last: int) -> tuple[int, int]:
    """The half-open interval of seconds of days first to last."""
    return (first - 1) * DAY + 1, last * DAY + 1


def clock_text(t: Column) -> Column:
    """Day N HH:MM:SS."""
    s = (t - 1) % DAY
    return F.format_string("Day %d %02d:%02d:%02d", day_of(t), F.floor(s / HOUR).cast("int"), F.floor(s % HOUR / 60).cast("int"), (s % 60).cast("int"))


def between_days(df, first: int, last: int, column: str = "timestamp"):
    """Rows of days first to last; filters dataset_day as well, so that partitions are pruned."""
    low, high = day_bounds(first, last)
    out = df.where((F.col(column) >= low) & (F.col(column) < high))
    return out.where(F.col("dataset_day").between(first, last)) if "dataset_day" in df.columns else out
