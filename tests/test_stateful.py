"""Keyed state on streams: rows out of order, late rows, and a restart between batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kestrelog.operators import history
from kestrelog.streaming import login, stateful

SCHEMA = "timestamp long, source_line long, acting_user string, source_computer string, destination_computer string, authentication_result string"
COLUMNS = [c.split()[0] for c in stateful.FEATURES.split(", ")][1:]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    t, out = 90_000, []
    for line in range(1, 260):
        t += rng.choice([0, 0, 5, 900, 4_000])
        out.append((t, line, f"U{rng.randrange(4)}", f"C{rng.randrange(3)}", f"C{rng.randrange(5)}", rng.choice(["Success", "Success", "Fail"])))
    return out


def run(spark, folder, home):
    stateful.use_rocksdb(spark)
    stream = stateful.history_features(login.replay(spark, str(folder), SCHEMA))
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(home / "ck")).option("path", str(home / "out")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_shuffled_rows_over_batches_and_a_restart(spark, tmp_path, rows):
    """Rows come up to 5,000 s late in three files, the stream stops between them, and one row comes a day too late."""
    rng = random.Random(5)
    arrived = sorted((r[0] + rng.randrange(5_000), r) for r in rows)
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = [r for _, r in arrived[a:b]]
        rng.shuffle(part)
        if i == 2:
            part.append((rows[0][0] + 1, 999, "U1", "C1", "C1", "Fail"))  # behind the watermark: dropped
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path / "in", tmp_path)
    spark.createDataFrame([(rows[-1][0] + 10**6, 10_000, "end", "end", "end", "Success")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(spark, tmp_path / "in", tmp_path)
    out = spark.read.parquet(str(tmp_path / "out")).where("acting_user <> 'end'").select(COLUMNS).collect()
    log = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in history.history_features(log).select(COLUMNS).collect()}
    assert len(out) == len(rows) and {tuple(r) for r in out} == want


def test_pieces_of_time_equal_whole_histories(spark, rows):
    """Features in pieces of a day against counts over all rows before."""
    got = {r.source_line: r for r in history.history_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (t, line, user, source, to, _) in enumerate(rows):
        before = [r for r in rows[:i] if r[2] == user]
        hour, day = ([r for r in before if r[0] >= t - w] for w in (3_600, 86_400))
        r = got[line]
        assert (r.prior_auth_count_1h, r.prior_failure_count_1h) == (len(hour), sum(x[5] == "Fail" for x in hour))
        assert (r.prior_unique_destinations_24h, r.prior_user_destination_count_24h) == (len({x[4] for x in day}), sum(x[4] == to for x in day))
        assert r.seconds_since_previous_auth == (float(t - before[-1][0]) if before else None)
        assert r.is_new_user_destination == all(x[4] != to for x in before) and r.is_new_user_source == all(x[3] != source for x in before)
        assert r.is_new_host_connection == all((x[3], x[4]) != (source, to) for x in rows[:i])


def test_no_window_holds_a_users_history(spark, rows):
    """Every window of the features is cut by pieces of time but the one over a user's pieces."""
    import re

    plan = history.history_features(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    assert windows and all("__piece" in w for w in windows)
    hot = spark.createDataFrame([(r[0], r[1], "U", r[3], r[4], r[5]) for r in rows], SCHEMA)
    parts = hot.groupBy(F.floor((F.col("timestamp") - 1) / 86_400)).count()
    assert parts.count() > 2


class _CountedState:
    """One list, value or map state of a key in memory; calls are counted."""

    def __init__(self, calls):
        self.calls, self.items = calls, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "appendList":
                self.items += args[0]
            elif name == "put":
                self.items = list(args[0])
            elif name in ("update", "updateValue"):
                self.items = [args[0]]
            elif name == "clear":
                self.items = []
            elif name == "containsKey":
                return False
            elif name == "get":  # a list's elements, or a value
                return (self.items[0] if self.items else None) if self.single else iter(self.items)

        return call


class _CountedHandle:
    def __init__(self, calls):
        self.calls = calls

    def _state(self, single):
        state = _CountedState(self.calls)
        state.single = single
        return state

    getListState = lambda self, *_: self._state(False)
    getMapState = getListState
    getValueState = lambda self, *_: self._state(True)
    registerTimer = deleteTimer = lambda self, at: self.calls.append("timer")


def test_state_is_asked_a_few_times_for_many_rows():
    """A call to the state store costs far more than a row, so their number must not follow that of rows, users or computers."""
    import pandas as pd

    for kind, more in ((stateful._Links, []), (stateful._Users, ["is_new_host_connection"])):
        calls, out = [], 0
        processor = kind(None)
        processor.init(_CountedHandle(calls))
        rows = [(i, 90_000 + i % 7_000, i % 2, f"U{i % 500}", f"C{i % 40}", f"C{i}", *[True for _ in more]) for i in range(3_000)]
        list(processor.handleInputRows((1,), iter([pd.DataFrame(rows, columns=[*stateful._IN, *more])]), None))
        timers = type("Timers", (), {"getCurrentWatermarkInMs": lambda self: 10**9})()
        out = sum(len(x) for x in processor.handleExpiredTimer((1,), timers, None))
        assert out == 3_000 and len(calls) < 30


def test_rows_at_the_first_second_and_at_the_watermark_are_kept(spark, tmp_path):
    """Second 1 is no later than a new stream's watermark; the only row of its groups stands at the watermark that the first micro-batch leaves."""
    rows = [(1, 1, "U1", "C1", "C2", "Fail"), (1, 2, "U1", "C1", "C3", "Success"), (20_000 - 7_200, 3, "U7", "C7", "C8", "Success"), (20_000 - 7_201, 4, "U8", "C8", "C9", "Success"), (20_000, 5, "U1", "C1", "C2", "Success")]
    later = [(40_000, 6, "U1", "C1", "C2", "Success"), (10**6, 7, "end", "end", "end", "Success")]
    for i, part in enumerate((rows, later[:1], later[1:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, tmp_path / "in", tmp_path)
    want = history.history_features(spark.createDataFrame(rows + later[:1], SCHEMA)).select(COLUMNS).collect()
    out = spark.read.parquet(str(tmp_path / "out")).where("acting_user <> 'end'").select(COLUMNS).collect()
    assert sorted(map(str, out)) == sorted(map(str, want))
