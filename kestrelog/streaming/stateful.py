"""History features on a stream by keyed state: rows may come out of order, up to the watermark.

Rows wait in list state until the watermark has passed their time; an event-time timer per key lets
them out in order of (timestamp, source_line). Two keys are at work one after the other: a group of
host pairs, which knows the pairs ever seen and so tells a new one, whoever the user is, and a group of
users, with the last day of events, the time of each user's last one and the computers ever seen. Groups
are hashes, so that a busy host is dealt out and a task asks its state a few times for many rows: an
element of state is the rows of a micro-batch or of a release together, as an Arrow stream. All state is in RocksDB.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .login import DAY, HOUR, LATENESS, PIECE, START, with_event_time

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of pairs and of users; a stream keeps the number for life, since its state is kept by group.
GROUPS = 512

_IN = ["source_line", "timestamp", "failed", "acting_user", "source_computer", "destination_computer"]
_TYPES = {"source_line": pa.int64(), "timestamp": pa.int64(), "failed": pa.int32(), "is_new_host_connection": pa.bool_()}
_ROW = "source_line long, timestamp long, failed int, acting_user string, source_computer string, destination_computer string"
LINKED = f"event_time timestamp, {_ROW}, is_new_host_connection boolean"
FEATURES = (
    "acting_user string, source_line long, timestamp long, prior_auth_count_1h long, prior_failure_count_1h long, seconds_since_previous_auth double, prior_unique_destinations_24h long, "
    "prior_user_destination_count_24h long, has_user_history boolean, is_new_user_destination boolean, is_new_user_source boolean, is_new_host_connection boolean"
)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _wakes(timestamp: int) -> int:
    """The timer of a row (ms): the last instant before its event time, since a timer fires when the watermark is past it and the next operator drops rows at the watermark a batch later."""
    return (timestamp - 1 + START) * 1000 - 1


class _Rows:
    """List state whose elements are rows of one schema together, as Arrow streams."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: list[str], ttl_ms: int | None = None):
        self.schema = pa.schema([(c, _TYPES.get(c, pa.string())) for c in columns])
        self.state = handle.getListState(name, "rows binary", ttl_ms)

    def _element(self, rows: list[tuple]) -> tuple[bytes]:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), self.schema.types)]
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self.schema) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        return (out.getvalue().to_pybytes(),)

    def get(self) -> list[tuple]:
        rows: list[tuple] = []
        for (element,) in self.state.get():
            for batch in pa.ipc.open_stream(bytes(element)):
                rows += zip(*[c.to_pylist() for c in batch.columns])
        return rows

    def append(self, parts: list[list[tuple]]) -> None:
        parts = [self._element(rows) for rows in parts if rows]
        if parts:
            self.state.appendList(parts)

    def put(self, rows: list[tuple]) -> None:
        if rows:
            self.state.put([self._element(rows)])
        else:
            self.state.clear()


class _Ordered(StatefulProcessor):
    """Holds rows back until the watermark has passed them. pending: the columns of a row, by name."""

    pending = _ROW

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = _names(self.pending)
        self.waiting = _Rows(handle, "waiting", self.names)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [list(pdf[self.names].astype(object).itertuples(index=False, name=None)) for pdf in rows]
        at = self.names.index("timestamp")
        self.waiting.append(came)
        earliest = min(r[at] for part in came for r in part)
        held = self.timer.get()
        if held is None or _wakes(earliest) < held[0]:
            self._wake(earliest, held)
        return iter([])

    def _wake(self, earliest: int, held: tuple | None = None) -> None:
        at = _wakes(earliest)
        if held is not None:
            self.handle.deleteTimer(held[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at, line = timerValues.getCurrentWatermarkInMs(), self.names.index("timestamp"), self.names.index("source_line")
        rows = self.waiting.get()
        due = sorted((r for r in rows if _wakes(r[at]) < now), key=lambda r: (r[at], r[line]))
        left = [r for r in rows if _wakes(r[at]) >= now]
        self.waiting.put(left)
        if left:
            self._wake(min(r[at] for r in left))
        else:
            self.timer.clear()
        out = self.released(due, now) if due else []
        for first in range(0, len(out), PIECE):
            yield self.framed(pd.DataFrame(out[first : first + PIECE], columns=self.columns))

    def released(self, rows: list[tuple], now: int) -> list[tuple]:
        """Rows (pending) in order of time -> rows out (columns)."""
        raise NotImplementedError

    def framed(self, out: pd.DataFrame) -> pd.DataFrame:
        return out

    def close(self) -> None:
        pass


class _Links(_Ordered):
    """Key: a group of host pairs. Marks the first event of each pair."""

    columns = _names(LINKED)[1:]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.linked = _Rows(handle, "linked", ["source_computer", "destination_computer"], self.forget_ms)

    def released(self, rows: list[tuple], now: int) -> list[tuple]:
        known, new, out = set(self.linked.get()), [], []
        for r in rows:
            pair = r[4:6]
            fresh = pair not in known
            if fresh:
                known.add(pair)
                new.append(pair)
            out.append((*r, fresh))
        self.linked.append([new])
        return out

    def framed(self, out: pd.DataFrame) -> pd.DataFrame:
        out.insert(0, "event_time", pd.to_datetime(out["timestamp"] - 1 + START, unit="s"))
        return out


class _Users(_Ordered):
    """Key: a group of users. Rolling counts of an hour and a day, gap and first-time flags."""

    pending = f"{_ROW}, is_new_host_connection boolean"
    columns = _names(FEATURES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.day = _Rows(handle, "day", ["acting_user", "timestamp", "failed", "destination_computer"])
        self.last = _Rows(handle, "last", ["acting_user", "timestamp"])
        self.known = _Rows(handle, "known", ["acting_user", "role", "computer"], self.forget_ms)

    def released(self, rows: list[tuple], now: int) -> list[tuple]:
        known, last, days = set(self.known.get()), dict(self.last.get()), defaultdict(list)
        for user, *event in self.day.get():
            days[user].append(tuple(event))
        new, out = [], []
        for user, own in groupby(sorted(rows, key=lambda r: r[3]), key=lambda r: r[3]):  # the order of time stays within a user
            days[user], last[user] = self._user(user, list(own), days[user], last.get(user), known, new, out)
        self.known.append([new])
        self.last.put(list(last.items()))
        since = now // 1000 - START - DAY  # what comes later is later than the watermark
        self.day.put([(user, *event) for user, events in days.items() for event in events if event[0] >= since])
        return out

    @staticmethod
    def _user(user: str, rows: list[tuple], held: list[tuple], last: int | None, known: set, new: list, out: list) -> tuple[list, int]:
        """Adds a user's rows to out and its computers to known and new; the events of its last day and the time of the last one."""
        day = deque(sorted(held, key=lambda x: x[0]))
        hour = deque(x for x in day if last is not None and x[0] >= last - HOUR)
        failed, near = sum(x[1] for x in hour), Counter(x[2] for x in day)
        for line, t, fails, _, source, to, linked in rows:
            while day and day[0][0] < t - DAY:
                old = day.popleft()[2]
                near[old] -= 1
                if not near[old]:
                    del near[old]
            while hour and hour[0][0] < t - HOUR:
                failed -= hour.popleft()[1]
            fresh = []
            for seen in ((user, "to", to), (user, "from", source)):
                fresh.append(seen not in known)
                if fresh[-1]:
                    known.add(seen)
                    new.append(seen)
            gap = None if last is None else float(t - last)
            out.append((user, line, t, len(hour), failed, gap, len(near), near.get(to, 0), last is not None, *fresh, linked))
            event = (t, fails, to)
            day.append(event)
            hour.append(event)
            failed += fails
            near[to] += 1
            last = t
        return list(day), last


def history_features(events: DataFrame, lateness: str = LATENESS, forget_seconds: int | None = None, groups: int = GROUPS) -> DataFrame:
    """The nine history features of every event, out of order by up to `lateness`; rows behind the watermark are dropped.

    A row comes out once the watermark has passed its time. With forget_seconds, what was ever seen is
    forgotten that long after it was noted (by the clock of the machines, as all state TTL is); else it stays. Rows
    without a user or a computer are kept as a user or computer of their own; a row without a timestamp is dropped.
    A release reads its group's state whole, so groups should be more where users and pairs are very many.
    """
    forget = None if forget_seconds is None else forget_seconds * 1000
    rows = with_event_time(events, START).withWatermark("event_time", lateness).where("timestamp is not null")
    name = lambda c: F.coalesce(c, F.lit("")).alias(c)
    failed = F.coalesce(F.col("authentication_result") == "Fail", F.lit(False)).cast("int").alias("failed")
    rows = rows.select("event_time", "source_line", "timestamp", failed, *map(name, _IN[3:]))
    dealt = lambda df, *keys: df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")).groupBy("part")
    linked = dealt(rows, "source_computer", "destination_computer").transformWithStateInPandas(_Links(forget), LINKED, "Append", "EventTime", eventTimeColumnName="event_time")
    return dealt(linked, "acting_user").transformWithStateInPandas(_Users(forget), FEATURES, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams that start from now on is kept in RocksDB, as transformWithState asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
