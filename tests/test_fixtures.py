"""Small hand-worked cases of the log's operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kestrelog.functions import accounts, clock
from kestrelog.operators import behaviours, fusion, graph, history, hourly, incidents, metrics, preprocess, sequences, splits, timing
from kestrelog.sources import authlog

EVENTS = [
    (1, 1, "U1", "C1", "C1", "Negotiate", "Interactive", "LogOn", "Success"), (2, 1, "U1", "C1", "C1", "Negotiate", "Interactive", "LogOn", "Success"), (3, 2, "U1", "C1", "C2", "?", "Network", "TGS", "Success"),
    (4, 3, "U2", "C2", "C3", "NTLM", "Network", "LogOn", "Fail"), (5, 3602, "U1", "C3", "C2", "Kerberos", "Network", "LogOn", "Fail"), (6, 3603, "U1", "C1", "C2", "Kerberos", "Network", "LogOn", "Success"),
    (7, 86401, "U1", "C1", "C4", "Kerberos", "Network", "LogOn", "Success"),
]
SCHEMA = "source_line long, timestamp long, acting_user string, source_computer string, destination_computer string, authentication_type string, logon_type string, authentication_orientation string, authentication_result string"


def events(spark, rows=EVENTS):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"source_user": F.col("acting_user"), "destination_user": F.col("acting_user"), "dataset_day": clock.day_of(F.col("timestamp"))})


def test_seven_events(spark):
    rows = {r.source_line: r for r in history.history_features(events(spark)).collect()}
    names = ["prior_auth_count_1h", "prior_failure_count_1h", "seconds_since_previous_auth", "has_user_history", "prior_unique_destinations_24h", "prior_user_destination_count_24h", "is_new_user_destination", "is_new_host_connection", "history_complete_1h", "history_complete_24h"]
    t, f = True, False
    want = {
        1: [0, 0, None, f, 0, 0, t, t, f, f], 2: [1, 0, 0.0, t, 1, 1, f, f, f, f], 3: [2, 0, 1.0, t, 1, 0, t, t, f, f], 4: [0, 0, None, f, 0, 0, t, t, f, f],
        5: [1, 0, 3600.0, t, 2, 1, f, t, t, f], 6: [1, 1, 1.0, t, 2, 2, f, f, t, f], 7: [0, 0, 82798.0, t, 2, 0, t, t, t, t],
    }
    assert {k: [rows[k][n] for n in names] for k in rows} == want


def test_window_bound_is_inclusive(spark):
    rows = [(i, t, "U1", "C1", "C1", "?", "?", "LogOn", "Success") for i, t in enumerate((100, 200, 201))]
    got = history.rolling_sum(events(spark, rows), ["acting_user"], 100, F.lit(1), "n").orderBy("source_line").collect()
    assert [r.n for r in got] == [0, 1, 1]


def test_rolling_features_against_brute_force_and_causality(spark):
    rng = random.Random(1)
    rows = [(i, t, f"U{rng.randrange(3)}", "C1", f"C{rng.randrange(5)}", "?", "?", "LogOn", rng.choice(["Success", "Fail"])) for i, t in enumerate(sorted(rng.randrange(1, 900) for _ in range(400)))]
    e = events(spark, rows)
    got = history.rolling_sum(e, ["acting_user"], 60, F.when(F.col("authentication_result") == "Fail", 1).otherwise(0), "fails")
    got = {r.source_line: (r.fails, r.kinds) for r in history.rolling_distinct(got, ["acting_user"], "destination_computer", 60, "kinds").collect()}
    for line, t, user, *_ in rows:
        before = [r for r in rows if r[2] == user and t - 60 <= r[1] and (r[1], r[0]) < (t, line)]
        assert got[line] == (sum(r[8] == "Fail" for r in before), len({r[4] for r in before}))
    early = {r.source_line: (r.fails, r.kinds) for r in history.rolling_distinct(history.rolling_sum(events(spark, rows[:200]), ["acting_user"], 60, F.when(F.col("authentication_result") == "Fail", 1).otherwise(0), "fails"), ["acting_user"], "destination_computer", 60, "kinds").collect()}
    assert all(got[k] == v for k, v in early.items())


def test_log_files(spark, tmp_path):
    lines = ["1,U1@D,U1@D,C1,C1,N,I,LogOn,Success"] * 2 + ["5,U1@D,U2@D,C1,C2,?,Network,TGS,Success", "86400,U2$@D,U1@D,C2,C3,NTLM,Network,LogOn,Fail", "86401,U1@D,U1@D,C1,C1,N,I,LogOn,Success", "x,U1@D,U1@D,C1,C1,N,I,LogOn,Success", "7,U1@D", "0,a,b,c,d,e,f,g,h", "9,a,b,,d,e,f,g,h"]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    parsed = authlog.parse(authlog.read_lines(spark, str(tmp_path / "log.txt")))
    assert {r.source_line: r.reason for r in authlog.rejections(parsed).collect()} == {6: "invalid_timestamp", 7: "field_count", 8: "invalid_timestamp", 9: "empty_field"}
    kept = authlog.with_duplicate_ordinal(authlog.accepted(parsed))
    assert {r.source_line: (r.exact_duplicate_ordinal, r.dataset_day) for r in kept.collect()} == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (1, 1), 5: (1, 2)}
    row = authlog.reconcile(parsed, 1, 1).first()
    assert (row.scanned, row.accepted, row.rejected, row.out_of_scope, row.duplicate_groups, row.duplicate_instances) == (9, 4, 4, 1, 1, 1)
    authlog.write_days(kept, str(tmp_path / "days"))
    assert {(r.rows, r.first) for r in authlog.manifest(spark, str(tmp_path / "days")).collect()} == {(4, 1), (1, 86401)}
    mapped = authlog.apply_line_map(authlog.read_lines(spark, str(tmp_path / "log.txt")), spark.createDataFrame([(i, 10 * i) for i in range(1, 10)], "source_line long, mapped long"))
    assert mapped.agg(F.max("source_line")).first()[0] == 90
    with pytest.raises(ValueError):
        authlog.apply_line_map(authlog.read_lines(spark, str(tmp_path / "log.txt")), spark.createDataFrame([(i, 5) for i in range(1, 10)], "source_line long, mapped long"))


def test_order_inversions_across_stripes(spark):
    rows = spark.createDataFrame([(1, 5), (2, 4), (3, 6), (4, 9), (5, 8), (6, 10)], "source_line long, timestamp long")
    assert {r.source_line for r in authlog.order_inversions(rows, 2).collect()} == {2, 5}
    assert {r.source_line for r in authlog.order_inversions(rows, 4).collect()} == {2, 5}


def test_guards(spark):
    with pytest.raises(ValueError):
        authlog.assert_no_labels(spark.createDataFrame([(1,)], "label int"))
    with pytest.raises(ValueError):
        preprocess.check_inputs(["timestamp"])
    with pytest.raises(ValueError):
        splits.check_policy([("a", 1, 2), ("b", 4, 5)])
    with pytest.raises(ValueError):
        splits.positive_hours(None, "test")
    with pytest.raises(ValueError):
        incidents.package_counts(None, None, None, "test")


def test_graph_window(spark):
    """Window (100,000 - 86,400, 100,001]: a pair known from before, a new one, a burst of three in a minute, an event after the end."""
    known = [(7_000, "A", "K", "Success", 1)]
    inside = [(20_000 + 25 * i, "A", "K", "Fail" if i == 1 else "Success", 10 + i) for i in range(3)] + [(20_200, "A", "N", "Fail", 20), (60_000, "B", "K", "Success", 30)]
    after = [(100_001, "A", "Z", "Success", 40)]
    e = spark.createDataFrame(known + inside + after, "timestamp long, acting_user string, destination_computer string, authentication_result string, source_line long")
    w = e.where("timestamp > 13600 and timestamp <= 100000").withColumn("window_end", F.lit(100_001).cast("long"))
    seen = e.groupBy("acting_user", "destination_computer").agg(F.min("timestamp").alias("first"))
    got = {(r.acting_user, r.destination_computer): (r.successes, r.failures, r.weight, r.lines) for r in graph.edges(w).collect()}
    assert got == {("A", "K"): (2, 1, 2.25, [10, 11, 12]), ("A", "N"): (0, 1, 0.25, [20]), ("B", "K"): (1, 0, 1.0, [30])} and seen.count() == 4
    whole = {(r.acting_user, r.destination_computer): r.is_new for r in graph.edges(graph.assign_windows(e)).where("window_end = 86401").collect()}
    assert whole == {("A", "K"): True, ("A", "N"): True, ("B", "K"): True}
    p = graph.bursts(w).where("acting_user = 'A'").first()
    assert (p.peak_60s, p.peak_300s, p.peak_destinations_300s) == (3, 4, 2)


def aligned(spark, rows):
    return spark.createDataFrame([("U", t, s, sa, g, ga) for t, s, sa, g, ga in rows], "user string, hour long, seq_score double, is_seq_alert boolean, graph_score double, is_graph_alert boolean")


def test_temporal_fusion(spark):
    """A lead of the graph over the sequence by four hours; too old a lead; both at once; a lead of the other side; the cap."""
    def run(rows, **more):
        f = fusion.fuse(aligned(spark, rows), "weighted", 0.25)
        return fusion.temporal(f, weight=0.2, alert=0.8, **more).orderBy("hour").collect()

    quiet, h = (0.4, False, 0.2, False), 3_600
    a = run([(h, 0.4, False, 0.9, True), (3 * h, *quiet), (5 * h, 0.8, True, 0.2, False)])
    assert [r.boost for r in a[:2]] == [0, 0] and a[1].lead is None
    assert (a[2].lead, a[2].lead_seconds) == ("graph", 4 * h) and a[2].base == pytest.approx(0.25 * 0.8 + 0.75 * 0.2)
    assert a[2].boost == pytest.approx(0.2 * math.exp(-4 * h / 21_600)) and a[2].fused == pytest.approx(a[2].base + a[2].boost)
    old = run([(h, 0.4, False, 0.9, True), (h + 86_400 + h, 0.8, True, 0.2, False)])
    assert old[1].boost == 0 and old[1].lead is None
    both = run([(7 * h, 0.85, True, 0.95, True)])[0]
    assert (both.lead, both.lead_seconds, both.boost) == ("simultaneous", 0, pytest.approx(0.2))
    other = run([(h, 0.9, True, 0.1, False), (2 * h, 0.1, False, 0.9, True)])[1]
    assert (other.lead, other.lead_seconds) == ("sequence", h)
    assert run([(h, 1.0, True, 1.0, True)])[0].fused == 0.9999


def test_alignment_is_causal_and_goes_stale(spark):
    seq = spark.createDataFrame([("U", 90001, 0.5, "available"), ("U", 180001, 0.6, "available"), ("V", 90001, None, "available")], "user string, hour long, seq_score double, seq_status string")
    gra = spark.createDataFrame([("U", 93601, 0.9, "available", 1), ("U", 93601, 0.8, "available", 2), ("U", 93602, 0.1, "available", 3), ("V", 200000, 0.9, "available", 4)], "user string, available_at long, graph_score double, graph_status string, tie long")
    got = {(r.user, r.hour): (r.graph_score, r.alignment_status) for r in fusion.check_no_leak(fusion.align(seq, gra)).collect()}
    assert got == {("U", 90001): (0.8, "both"), ("U", 180001): (None, "stale_graph"), ("V", 90001): (None, "no_activity")}


def test_metrics_by_hand(spark):
    """Six scores: at 0.6 three alerts, all but one positive right; then four units of which one positive was never scored."""
    rows = spark.createDataFrame([(0.99, True), (0.75, False), (0.6, True), (0.55, False), (0.2, False), (0.1, False)], "score double, label boolean")
    best = metrics.best_f1(rows).first()
    assert best.threshold == 0.6 and best.f1 == pytest.approx(0.8)
    c = metrics.confusion(rows, F.lit(0.6)).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.fpr, c.recall) == (2, 1, 0, 3, 0.25, 1.0)
    assert metrics.average_precision(rows).first().ap == pytest.approx((1 + 2 / 3) / 2) and metrics.roc_auc(rows).first().auc == 7 / 8
    scored = spark.createDataFrame([("p", 0.3), ("q", 0.8), ("r", 0.1), ("s", 0.05), ("t", 0.02)], "unit string, score double")
    s = metrics.evaluation_summary(scored, spark.createDataFrame([("q",), ("r",), ("nowhere",)], "unit string"), ["unit"]).first()
    assert (s.coverage, s.ap, s.prevalence, s.recall_with_unscored) == (pytest.approx(2 / 3), pytest.approx((1 + 2 / 3) / 2), 0.4, pytest.approx(2 / 3))
    tied = spark.createDataFrame([(0.7, True), (0.7, True), (0.7, False), (0.1, False)], "score double, label boolean")
    assert metrics.roc_auc(tied).first().auc == 0.75 and metrics.average_precision(tied).first().ap == pytest.approx(2 / 3)
    equal = spark.createDataFrame([(0.9, True), (0.5, False), (0.3, True), (0.2, False), (0.1, False)], "score double, label boolean")  # 0.9 gives 2/3, 0.3 gives 0.8
    assert metrics.best_f1(equal).first().threshold == 0.3
    two = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, False), (0.6, True)], "score double, label boolean")  # both 0.9 and 0.6 give 2/3
    assert metrics.best_f1(two).first().threshold == 0.9 and metrics.best_f1(two, lowest=True).first().threshold == 0.6
    odd = two.union(spark.createDataFrame([(float("nan"), True), (None, True)], "score double, label boolean"))
    assert metrics.average_precision(odd).first().ap == metrics.average_precision(two).first().ap


def test_scores_close_together_are_cut_into_ranges(spark):
    """Forty thousand scores within [0.92, 1) meet in many ranges, none of which holds more than a few hundredths."""
    rng = random.Random(9)
    rows = [(0.92 + 0.08 * rng.random(), rng.random() < 0.1) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "score double, label boolean")
    c = metrics.cumulative(df)
    plan = c._jdf.queryExecution().toString()
    assert "bucketizer" in plan.lower() or "UDF" in plan
    sizes = metrics.Bucketizer(splits=[-math.inf, *sorted(set(df.stat.approxQuantile("score", [i / 256 for i in range(1, 256)], 1 / 1024))), math.inf], inputCol="score", outputCol="r").transform(df).groupBy("r").count().agg(F.max("count")).first()[0]
    assert sizes < 1_000
    ordered = sorted(rows, reverse=True)
    tp, ap, total = 0, 0.0, sum(y for _, y in rows)
    for i, (_, y) in enumerate(ordered, 1):
        tp += y
        ap += tp / i / total if y else 0
    assert metrics.average_precision(df).first().ap == pytest.approx(ap)


def test_calibrator(spark):
    """Three quarters of the references are equal, the rest spread over two decades: below the step 0, on it its upper end, then rising, a tail that never ends."""
    values = [0.05] * 900 + [10 ** (-1 + 2 * (i + 0.5) / 300) for i in range(300)]
    knots = metrics.fit_calibrator(spark.createDataFrame([(v,) for v in values], "score double"))
    asked = spark.createDataFrame([(0.01,), (0.05,), (1.0,), (7.0,), (10.0,), (1e3,), (1e9,), (None,)], "score double")
    got = [r.calibrated for r in metrics.calibrate(asked, knots).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(0.75, abs=0.002) and got[2] == pytest.approx(0.875, abs=0.002)
    assert got[2] < got[3] < got[4] < got[5] < got[6] < 1 and got[7] is None
    with pytest.raises(ValueError):
        metrics.fit_calibrator(spark.createDataFrame([(float(i),) for i in range(99)], "score double"))


def test_daily_queue_and_incidents(spark):
    rows = [("U1@DOM1", 1, 1, 0.5, 1), ("U2@DOM1", 1, 1, 0.9, 2), ("U3@DOM1", 1, 1, 0.5, 3), ("U4@DOM1", 1, 1, 0.5, 4), ("U1@DOM1", 86401, 2, 0.1, 5)]
    q = incidents.daily_queue(spark.createDataFrame(rows, "user string, hour long, day int, score double, tie long"), 3).where("day = 1").orderBy("rank").collect()
    assert [(r.user[:2], r.tied, r.alert_id) for r in q] == [("U2", False, "ALR-D01-01"), ("U1", True, "ALR-D01-02"), ("U3", True, "ALR-D01-03")]
    hours = spark.createDataFrame([(u, h, 1, 0.9, "concordant_normal", 0.0, 0.9, 0.1) for u, h in (("U1@DOM1", 1), ("U1@DOM1", 7201), ("U1@DOM1", 21601), ("U2$@DOM1", 1))], "user string, hour long, day int, score double, disagreement string, boost double, seq_score double, graph_score double")
    got = {r.incident_id: r.alert_hours for r in incidents.build(hours, "test").collect()}
    assert got == {"INC-TEST-D01-U1_DOM1-001": 2, "INC-TEST-D01-U1_DOM1-002": 1, "INC-TEST-D01-U2_DOM1-001": 1}


def test_sequences(spark):
    u = spark.createDataFrame([("U", 1, n) for n in (1, 7, 64, 65, 130)], "acting_user string, hour long, n_events long")
    for r in sequences.chunks(u, 64).groupBy("n_events" if "n_events" in sequences.chunks(u, 64).columns else "hour").agg(F.max("length").alias("hi"), F.min("length").alias("lo")).collect():
        assert r.hi - r.lo <= 64
    for n in (1, 5, 64, 65, 130, 200):
        one = spark.createDataFrame([("U", 1, n)], "acting_user string, hour long, n_events long")
        c = sequences.chunks(one, 64).orderBy("chunk").collect()
        assert sum(x.length for x in c) == n and max(x.length for x in c) - min(x.length for x in c) <= 1 and [x.start for x in c] == [sum(y.length for y in c[:i]) for i in range(len(c))]
        at = spark.range(n).select(sequences.chunk_of(F.col("id"), F.lit(n), 64).alias("c")).groupBy("c").count().collect()
        assert {r.c: r["count"] for r in at} == {x.chunk: x.length for x in c}


def test_rules_timing_and_texts(spark):
    assert [spark.range(1).select(timing.offset_class(F.lit(x))).first()[0] for x in (-1400, 1600, 13600, None)] == ["early", "immediate", "delayed", "missed"]
    lead = lambda s, g: spark.range(1).select(*timing.precedence(F.lit(s).cast("long"), F.lit(g).cast("long"))).first()
    assert tuple(lead(10000, 20000)) == ("sequence", 10000) and tuple(lead(25000, 10000)) == ("graph", 15000) and tuple(lead(5, 5)) == ("simultaneous", 0) and lead(None, 5)[0] == "graph_only"
    t = spark.range(1).select(clock.clock_text(F.lit(93662)), accounts.reference_line(F.lit("auth.txt:12")), accounts.reference_line(F.lit("auth.txt:0")), accounts.is_machine(F.lit("U1$@D")), behaviours.clean_description(F.lit("A [b](http://c)  d (Citation: x)"))).first()
    assert tuple(t) == ("Day 2 02:01:01", 12, None, True, "A b d")
    groups = behaviours.anchored_groups(spark.createDataFrame([(1, t) for t in (20, 25, 30, 31, 50)], "id int, t long"), ["id"], 10).orderBy("anchor").collect()
    assert [(r.anchor, r["last"], r.n) for r in groups] == [(20, 30, 3), (31, 31, 1), (50, 50, 1)]


def test_preprocessing(spark):
    train = spark.createDataFrame([(0.0, "b"), (3.0, "a"), (None, ""), (8.0, None)], "x double, k string")
    s = preprocess.fit_numeric(train, ["x"]).first()
    assert s.n == 3 and s["mean"] == pytest.approx((0 + 1.3862944 + 2.1972246) / 3)
    v = preprocess.fit_vocabulary(train, ["k"])
    assert {r.value: r.id for r in v.collect()} == {"a": 2, "b": 3}
    got = preprocess.encode(train.union(spark.createDataFrame([(1.0, "zz")], train.schema)), v, ["k"])
    assert sorted(r.k_id for r in got.collect()) == [0, 1, 1, 2, 3]
    z = preprocess.standardise(train, preprocess.fit_numeric(train, ["x"]), ["x"]).collect()
    assert {r.x: r.x_z for r in z}[None] == 0.0
    flat = preprocess.fit_numeric(spark.createDataFrame([(2.0,)] * 3, "x double"), ["x"]).first()
    assert flat.scale == 1.0
    digest = preprocess.fingerprint(v).first().fingerprint
    preprocess.verify_fingerprint(v, digest)
    with pytest.raises(ValueError):
        preprocess.verify_fingerprint(v.limit(1), digest)


def test_isolation_forest_finds_the_odd_one(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(999, 12.0, -12.0)], "tie long, a double, b double")
    scores = hourly.isolation_scores(rows, hourly.grow_trees(rows, ["a", "b"], 30, 128), ["a", "b"], 128)
    assert scores.orderBy(F.desc("score")).first().tie == 999
