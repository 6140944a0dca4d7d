"""Structured Streaming forms of the log's operators.

Each takes a streaming (or batch) DataFrame of events with an event-time column `event_time`
made by with_event_time, and keeps state bounded by the watermark where the operator allows it.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrelog.sources import authlog

LATENESS = "2 hours"
HOUR, DAY = 3600, 86_400
#: Event time of the dataset's first second in histories: a watermark begins at 0, and rows at it or before it count as late.
START = DAY
#: Rows of a user that come out together.
PIECE = 10_000


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A written log as a stream; use trigger(availableNow=True) to read it once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(events: DataFrame, start: int = 0) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_seconds(F.col("timestamp") - 1 + start))


def hourly_counts(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events, failures and exact distinct computers of user-hours, in append mode.

    Two aggregates in a row: by user, hour and computer, then, when the watermark closes the hour, by user and hour.
    """
    w = with_event_time(events).withWatermark("event_time", lateness).groupBy(F.window("event_time", "1 hour").alias("w"), "acting_user", "destination_computer")
    each = w.agg(F.count("*").alias("n"), F.count_if(F.col("authentication_result") == "Fail").alias("fails"))
    g = each.groupBy(F.window(F.window_time("w"), "1 hour").alias("h"), "acting_user").agg(F.sum("n").alias("events"), F.sum("fails").alias("failures"), F.count("destination_computer").alias("destinations"))
    return g.select("acting_user", (F.unix_timestamp("h.start") + 1).alias("hour"), "events", "failures", "destinations")


def first_pairs(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first appearance of each combination of keys; its state is the combinations ever seen."""
    return events.dropDuplicates(keys)


def graph_edges(events: DataFrame, stride: str = "12 hours", lateness: str = LATENESS) -> DataFrame:
    """Edges of sliding day windows."""
    g = with_event_time(events).withWatermark("event_time", lateness).groupBy(F.window("event_time", "1 day", stride).alias("w"), "acting_user", "destination_computer")
    out = g.agg(F.count_if(F.col("authentication_result") == "Success").alias("successes"), F.count_if(F.col("authentication_result") != "Success").alias("failures"))
    return out.select((F.unix_timestamp("w.end") + 1).alias("window_end"), "acting_user", "destination_computer", "successes", "failures")


def incidents(alert_hours: DataFrame, gap_seconds: int = 7200, lateness: str = LATENESS) -> DataFrame:
    """Sessions of a user's alert hours (user, hour, score): hours whose distance is the gap or less after an hour's end merge."""
    t = alert_hours.withColumn("event_time", F.timestamp_seconds(F.col("hour") - 1)).withWatermark("event_time", lateness)
    g = t.groupBy(F.session_window("event_time", f"{gap_seconds + 3600} seconds").alias("w"), "user").agg(F.count("*").alias("alert_hours"), F.max("score").alias("max_score"), F.min("hour").alias("start"), (F.max("hour") + 3600).alias("end"))
    return g.drop("w")


def split_late(events: DataFrame, good_path: str, late_path: str, checkpoint: str, lateness_seconds: int = 7200, raw: bool = False):
    """Writes each micro-batch's rows: those behind the largest time of this and earlier batches by more than the bound go to a side table, and so do rejects.

    With raw, events are log lines (source_line, raw) and are parsed here; rejected lines keep
    their reason, late rows have `late`. A batch is a folder `batch=<id>` of each table, which a
    replay of the batch overwrites, so that rows come once however often a batch is tried; the
    largest time so far is kept likewise, so that lateness survives a restart. A batch without a good row still keeps its rejects.
    """
    write = side_outputs(events.sparkSession, good_path, late_path, lateness_seconds, raw)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def side_outputs(spark: SparkSession, good_path: str, late_path: str, lateness_seconds: int, raw: bool):
    """What split_late does with a batch: a function of the batch and its id, the same however often it is called."""
    marks = f"{late_path}-newest"

    def newest_before(batch_id: int) -> int | None:
        try:
            held = spark.read.schema("newest long, batch long").parquet(marks)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return held.where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        held = (authlog.parse(batch).drop("source_reference") if raw else batch.withColumn("reason", F.lit(None).cast("string"))).persist()
        good = held.where("reason is null")
        newest = [x for x in (newest_before(batch_id), good.agg(F.max("timestamp")).first()[0]) if x is not None]
        late = F.col("timestamp") < max(newest) - lateness_seconds if newest else F.lit(False)
        late = F.coalesce(late, F.lit(False))
        tables = (
            (good.where(~late).drop("reason"), good_path),
            (held.withColumn("reason", F.coalesce("reason", F.when(late, "late"))).where("reason is not null"), late_path),
            (spark.createDataFrame([(max(newest, default=None),)], "newest long"), marks),
        )
        for df, path in tables:
            df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        held.unpersist()

    return write


FEATURES = (
    "acting_user string, source_line long, timestamp long, prior_auth_count_1h long, prior_failure_count_1h long, seconds_since_previous_auth double, prior_unique_destinations_24h long, "
    "prior_user_destination_count_24h long, has_user_history boolean, is_new_user_destination boolean, is_new_user_source boolean"
)
_STATE = "times array<long>, fails array<long>, hosts array<string>, last long, destinations array<string>, sources array<string>"


def _history(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A user's features from the events of the last day, the last time, and the computers ever seen.

    Each event enters and leaves the windows once. When a day has passed without an event, the windows are
    emptied; what was ever seen stays.
    """
    times, fails, hosts, last, known, sources = state.get if state.exists else ([], [], [], None, [], [])
    if state.hasTimedOut:
        state.update(([], [], [], last, known, sources))
        return
    day = deque(zip(times, fails, hosts))
    hour = deque(x for x in day if x[0] >= (last or 0) - HOUR)
    failed, near = sum(f for _, f, _ in hour), Counter(hosts)
    known, sources, out = set(known), set(sources), []
    fields = ["timestamp", "source_line", "failed", "destination_computer", "source_computer"]
    rows = pd.concat([pdf[fields] for pdf in frames]).sort_values(["timestamp", "source_line"])  # Arrow cuts a user's rows anywhere, so its frames are put in order together
    for at in range(0, len(rows), PIECE):
        for t, line, f, host, source in rows.iloc[at : at + PIECE].itertuples(index=False):
            while day and day[0][0] < t - DAY:
                gone = day.popleft()[2]
                near[gone] -= 1
                if not near[gone]:
                    del near[gone]
            while hour and hour[0][0] < t - HOUR:
                failed -= hour.popleft()[1]
            gap = None if last is None else float(t - last)
            out.append((key[0], int(line), int(t), len(hour), failed, gap, len(near), near.get(host, 0), last is not None, host not in known, source not in sources))
            event = (int(t), int(f), host)
            day.append(event)
            hour.append(event)
            failed += int(f)
            near[host] += 1
            known.add(host)
            sources.add(source)
            last = int(t)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])
        out = []
    state.update(([x[0] for x in day], [x[1] for x in day], [x[2] for x in day], last, sorted(known), sorted(sources)))
    state.setTimeoutTimestamp(max((last - 1 + START + DAY) * 1000, state.getCurrentWatermarkMs() + 1))


def history_features(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The per-user features of the batch form on a stream: rolling counts of an hour and a day, gap, first-time flags on every row.

    State holds a user's last day of events and the computers ever seen. Micro-batches must come in time order per user, as the
    log is written; the rows of a user in one micro-batch may come in any order and are sorted together.
    """
    rows = with_event_time(events, START).withWatermark("event_time", lateness)
    rows = rows.select("acting_user", "event_time", "source_line", "timestamp", "destination_computer", "source_computer", (F.col("authentication_result") == "Fail").cast("int").alias("failed"))
    return rows.groupBy("acting_user").applyInPandasWithState(_history, FEATURES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
