from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kestrelog.operators import graph, history, incidents
from kestrelog.plans import streams
from kestrelog.sources import adapters
from kestrelog.streaming import login

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "events")
    adapters.auth_events(spark, SF).coalesce(1).sortWithinPartitions("timestamp", "source_line").write.parquet(path)
    return path


def once(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def source(spark, log):
    return login.replay(spark, log, spark.read.parquet(log).schema)


def test_hourly_counts(spark, log, tmp_path):
    e = spark.read.parquet(log)
    folder = str(tmp_path / "closed")
    e.coalesce(1).write.parquet(folder)
    last = e.agg(F.max("timestamp")).first()[0]
    e.limit(1).withColumns({"acting_user": F.lit("closing"), "timestamp": F.lit(last + 10**6).cast("long")}).write.mode("append").parquet(folder)
    got = {(r.acting_user, r.hour): (r.events, r.failures, r.destinations) for r in once(login.hourly_counts(source(spark, folder)), tmp_path, "hours").collect()}
    h = (F.floor((F.col("timestamp") - 1) / 3600) * 3600 + 1).alias("hour")
    want = {(r.acting_user, r.hour): (r.n, r.f, r.d) for r in e.groupBy("acting_user", h).agg(F.count("*").alias("n"), F.count_if(F.col("authentication_result") == "Fail").alias("f"), F.countDistinct("destination_computer").alias("d")).collect()}
    assert got == want


def test_first_pairs(spark, log, tmp_path):
    got = once(login.first_pairs(source(spark, log), ["source_computer", "destination_computer"]), tmp_path, "pairs").count()
    assert got == spark.read.parquet(log).select("source_computer", "destination_computer").distinct().count()


def test_graph_edges(spark, log, tmp_path):
    got = {(r.window_end, r.acting_user, r.destination_computer): (r.successes, r.failures) for r in once(login.graph_edges(source(spark, log), "1 day"), tmp_path, "edges", "complete").collect()}
    want = {(r.window_end, r.acting_user, r.destination_computer): (r.successes, r.failures) for r in graph.edges(graph.assign_windows(spark.read.parquet(log))).collect()}
    assert got == want


def test_sessions_are_incidents(spark, tmp_path):
    rows = [("U1", 1 + 3600 * h, 0.5) for h in (0, 3, 7, 8)] + [("U2", 1, 0.7)]
    spark.createDataFrame(rows, "user string, hour long, score double").coalesce(1).write.parquet(str(tmp_path / "alerts"))
    stream = login.replay(spark, str(tmp_path / "alerts"), "user string, hour long, score double")
    got = {(r.user, r.start): r.alert_hours for r in once(login.incidents(stream), tmp_path, "sessions", "complete").collect()}
    batch = incidents.group_hours(spark.createDataFrame(rows, "user string, hour long, score double"))
    want = {(r.user, r.start): r.n for r in batch.groupBy("user", "incident_seq").agg(F.min("hour").alias("start"), F.count("*").alias("n")).collect()}
    assert got == want == {("U1", 1): 2, ("U1", 25201): 2, ("U2", 1): 1}


def test_rolling_features(spark, log, tmp_path):
    stream = login.history_features(source(spark, log))
    columns = [c for c in stream.columns if c != "acting_user"]
    got = {tuple(r) for r in once(stream, tmp_path, "rolling").select(columns).collect()}
    assert got == {tuple(r) for r in history.history_features(spark.read.parquet(log)).select(columns).collect()}


def test_features_go_on_over_batches(spark, log, tmp_path):
    e = spark.read.parquet(log)
    cuts = e.approxQuantile("timestamp", [0.3, 0.7], 0.0)
    folder = tmp_path / "parts"
    for i, (low, high) in enumerate(zip([0, *cuts], [*cuts, 10**9])):
        e.where((F.col("timestamp") > low) & (F.col("timestamp") <= high)).coalesce(1).write.mode("append").parquet(str(folder))
        stream = login.history_features(login.replay(spark, str(folder), e.schema))
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    columns = [c for c in stream.columns if c != "acting_user"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(columns).collect()}
    assert got == {tuple(r) for r in history.history_features(e).select(columns).collect()}


def test_late_rows_go_aside(spark, tmp_path):
    schema = "timestamp long, acting_user string"
    spark.createDataFrame([(100_000, "a"), (99_000, "b"), (10, "c")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = login.split_late(login.replay(spark, str(tmp_path / "in"), schema), str(tmp_path / "good"), str(tmp_path / "late"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r.acting_user for r in spark.read.parquet(str(tmp_path / "late")).collect()} == {"c"}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    spark.createDataFrame([(90_000, "d"), (95_000, "e")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    login.split_late(login.replay(spark, str(tmp_path / "in"), schema), str(tmp_path / "good"), str(tmp_path / "late"), str(tmp_path / "ck")).awaitTermination()
    assert {r.acting_user for r in spark.read.parquet(str(tmp_path / "late")).collect()} == {"c", "d"}  # late against the batch before


def test_rejects_go_aside_too(spark, tmp_path):
    adapters.log_lines(spark, SF).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = login.replay(spark, str(tmp_path / "in"), "source_line long, raw string")
    login.split_late(stream, str(tmp_path / "good"), str(tmp_path / "late"), str(tmp_path / "ck"), 10**9, raw=True).awaitTermination()
    aside = {r.reason: r.n for r in spark.read.parquet(str(tmp_path / "late")).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert set(aside) == {"field_count", "invalid_timestamp", "empty_field"}
    assert spark.read.parquet(str(tmp_path / "good")).count() + sum(aside.values()) == spark.read.parquet(str(tmp_path / "in")).count()


def test_rejects_without_a_good_row_are_kept(spark, tmp_path):
    lines = [(1, "no fields"), (2, "x,a,b,c,d,e,f,g,h")]
    spark.createDataFrame(lines, "source_line long, raw string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = login.replay(spark, str(tmp_path / "in"), "source_line long, raw string")
    login.split_late(stream, str(tmp_path / "good"), str(tmp_path / "late"), str(tmp_path / "ck"), raw=True).awaitTermination()
    assert {(r.source_line, r.reason) for r in spark.read.parquet(str(tmp_path / "late")).collect()} == {(1, "field_count"), (2, "invalid_timestamp")}
    assert spark.read.parquet(str(tmp_path / "good")).count() == 0


def test_a_batch_tried_again_leaves_no_doubles(spark, tmp_path):
    """Batches are played as after a restart: the second one three times, once broken off after its first table."""
    schema = "timestamp long, acting_user string"
    first = spark.createDataFrame([(100_000, "a"), (10, "b")], schema)
    second = spark.createDataFrame([(200_000, "c"), (150_000, "d"), (199_000, "e")], schema)
    write = login.side_outputs(spark, str(tmp_path / "good"), str(tmp_path / "late"), 7_200, False)
    write(first, 0)
    second.where("acting_user = 'c'").write.parquet(str(tmp_path / "good" / "batch=1"))  # what a failed try left behind
    for _ in range(3):
        write(second, 1)
    assert sorted(r.acting_user for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["a", "c", "e"]
    assert sorted((r.acting_user, r.batch) for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [("b", 0), ("d", 1)]
    write(first, 0)  # an earlier batch again: its lateness does not see later batches
    assert sorted(r.acting_user for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["a", "c", "e"]


def test_rows_of_the_first_second_have_features(spark, log, tmp_path):
    """Second 1 is no later than the watermark with which a stream begins."""
    e = spark.read.parquet(log)
    first = e.agg(F.min("timestamp")).first()[0]
    folder = str(tmp_path / "from-one")
    e.withColumn("timestamp", F.col("timestamp") - first + 1).coalesce(1).write.parquet(folder)
    stream = login.history_features(source(spark, folder))
    columns = [c for c in stream.columns if c != "acting_user"]
    got = {tuple(r) for r in once(stream, tmp_path, "from_one").select(columns).collect()}
    assert got == {tuple(r) for r in history.history_features(spark.read.parquet(folder)).select(columns).collect()}


def test_a_part_without_rows_keeps_the_others_apart(spark, log, monkeypatch):
    """Parts two and three of the replay are empty; the micro-batches of the others hold no rows of each other."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    e = spark.read.parquet(log)
    middle = e.approxQuantile("timestamp", [0.5], 0.0)[0]
    gap = e.withColumn("timestamp", F.col("timestamp") + F.when(F.col("timestamp") > middle, 10**8).otherwise(0))
    sizes = []
    stream = streams.replayed(spark, SF, gap, F.col("timestamp"), closing=False)
    q = stream.writeStream.foreachBatch(lambda batch, _: sizes.append((batch.count(), batch.where("timestamp > 5e7").count()))).trigger(availableNow=True).start()
    q.awaitTermination()
    n, late = gap.count(), gap.where("timestamp > 5e7").count()
    assert sizes == [(n - late, 0), (0, 0), (0, 0), (late, late)]
