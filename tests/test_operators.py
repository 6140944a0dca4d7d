"""Operators against brute force or hand-worked rows, in the cases that the given tables do not reach."""

from __future__ import annotations

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from kestrelog.functions import spans
from kestrelog.operators import behaviours, fusion, graph, history, incidents, metrics, selection, verdicts
from kestrelog.sources import authlog, packages


def slow_ranking(rows):
    """Average precision, AUC and best F1 by definition, equal scores as one step."""
    scores = sorted({s for s, _ in rows}, reverse=True)
    total, tp, fp, ap, best = sum(y for _, y in rows), 0, 0, 0.0, (-1.0, 0.0)
    for s in scores:
        pos, neg = sum(y for x, y in rows if x == s), sum(not y for x, y in rows if x == s)
        tp, fp = tp + pos, fp + neg
        ap += pos * tp / (tp + fp) / total
        best = max(best, (2 * tp / (tp + fp + total), s))
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    return ap, sum(pairs) / len(pairs), best


def test_ranking_metrics_with_negative_scores(spark):
    rng = random.Random(1)
    for low, high in ((-3, 3), (-1, 0), (-1e-9, 1e-9), (0, 5)):
        rows = [(round(rng.uniform(low, high), rng.choice((1, 12))), rng.random() < 0.3) for _ in range(400)] + [(0.0, True), (0.0, False), (-1.0, False)]
        df = spark.createDataFrame(rows, "score double, label boolean")
        ap, auc, (f1, threshold) = slow_ranking(rows)
        assert metrics.average_precision(df).first().ap == pytest.approx(ap)
        assert metrics.roc_auc(df).first().auc == pytest.approx(auc)
        found = metrics.best_f1(df).first()
        assert found.f1 == pytest.approx(f1) and found.threshold == threshold


def test_order_statistics_and_calibrators(spark, tmp_path):
    rng = random.Random(2)
    for values in ([1.0] * 150, [rng.choice((0.1, 0.2, 5.0)) for _ in range(1000)], [rng.gauss(0, 1) for _ in range(3000)], [3.0], []):
        got = metrics.order_statistics(spark.createDataFrame([(v,) for v in values], "x double"), [0.0, 0.25, 0.5, 0.999, 1.0])
        ordered = sorted(values)
        for p, g in zip([0.0, 0.25, 0.5, 0.999, 1.0], got):
            if not values:
                assert g is None
                continue
            at = p * (len(values) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert g == pytest.approx(low + (high - low) * (at - math.floor(at)))
    scores = spark.createDataFrame([(abs(rng.gauss(1, 1)),) for _ in range(500)] + [(None,)], "score double")
    knots = metrics.fit_calibrator(scores)
    metrics.save_calibrator(knots, str(tmp_path / "c"))
    again = metrics.load_calibrator(spark, str(tmp_path / "c"))
    a, b = (sorted((r.score or 0, r.calibrated or 0) for r in metrics.calibrate(scores, k).collect()) for k in (knots, again))
    assert a == b and all(x[1] <= y[1] for x, y in zip(a, a[1:])) and all(0 <= x[1] < 1 for x in a)
    spark.createDataFrame([(1.0, -2.0, 0.5)], "x double, scale double, p double").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        metrics.load_calibrator(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        metrics.fit_calibrator(scores.limit(99))


def test_units_without_scores_are_no_alerts(spark):
    rows = [("U1", 1, None, None, True, False), ("U1", 3601, 0.9, 0.2, False, True), ("U2", 1, None, 0.8, None, True)]
    df = spark.createDataFrame(rows, "user string, hour long, seq_score double, graph_score double, is_seq_alert boolean, is_graph_alert boolean")
    got = {(r.user, r.hour): r for r in fusion.temporal(fusion.fuse(df, "max"), alert=0.5).collect()}
    assert got["U1", 1].fused is None and got["U1", 1].is_alert is None
    assert got["U1", 3601].boost == pytest.approx(0.15 * math.exp(-3600 / 21_600)) and got["U1", 3601].is_alert
    assert got["U2", 1].fused == pytest.approx(0.8)


def test_alignment_drops_scores_that_are_not_available(spark):
    day = 86_400
    seq = [("A", 2 * day + 1, 0.5, "available", None), ("B", 2 * day + 1, 0.5, "warmup", True), ("C", 2 * day + 1, 0.1, "available", True), ("D", 2 * day + 1, 0.9, "available", False), ("E", 4 * day + 1, 0.9, "available", None)]
    gra = [("A", 2 * day, 0.95, "warmup", 1), ("B", 2 * day, 0.95, "available", 1), ("D", 2 * day, 0.3, "available", 1), ("E", 2 * day, 0.95, "warmup", 1)]
    s = spark.createDataFrame(seq, "user string, hour long, seq_score double, seq_status string, seq_alert boolean")
    g = spark.createDataFrame(gra, "user string, available_at long, graph_score double, graph_status string, tie long")
    got = {r.user: (r.seq_score, r.graph_score, r.is_seq_alert, r.is_graph_alert, r.alignment_status) for r in fusion.align(s, g).collect()}
    assert got["A"] == (0.5, None, True, None, "insufficient_history")  # and 0.5 alone is what is fused
    assert got["B"] == (None, 0.95, None, True, "insufficient_history")
    assert got["C"] == (0.1, None, True, None, "sequence_only")  # its own flag counts
    assert got["D"] == (0.9, 0.3, False, False, "both")
    assert got["E"] == (0.9, None, True, None, "stale_graph")  # a stale row's status does not matter
    assert fusion.fuse(fusion.align(s, g), "average").where("user = 'A'").first().base == 0.5


EVENT = "incident_id string, source_line long, timestamp long, source_user string, destination_user string, source_computer string, destination_computer string, authentication_type string, logon_type string, authentication_orientation string, authentication_result string, is_new_user_destination boolean, is_new_host_connection boolean, is_new_user_source boolean"


def event(line, kind="NTLM", how="Network", orient="LogOn", result="Success", dest=False, pair=False, source=False, incident="I"):
    return (incident, line, line * 10, "U1@DOM1", "U2@DOM1", f"C{line % 3}", f"C1{line % 2}", kind, how, orient, result, dest, pair, source)


def test_behaviour_rules(spark):
    rows = [
        event(1, result="Fail"), event(2, dest=True), event(3, pair=True, kind="Kerberos"), event(4, dest=True, orient="LogOff"), event(5, dest=True, how="Interactive"), event(6, source=True, how="?", orient="TGS"),
        event(7, source=True, orient="LogOff"), event(8, pair=True, orient="TGT"),
    ]
    e = spark.createDataFrame(rows, EVENT)
    got = {}
    for r in behaviours.rule_matches(e).collect():
        got.setdefault(r.rule, set()).add(r.source_line)
    assert got == {"failed_logons": {1}, "ntlm_logon_to_new_destination": {2, 8}, "network_logon_to_new_destination": {2, 3, 8}, "logon_from_new_source": {6}}
    flags = {r.source_line: r.flags for r in e.select("source_line", behaviours.event_flags().alias("flags")).collect()}
    assert flags[4] == flags[7] == "" and flags[1] == "failed" and flags[2]
    counts = behaviours.event_counts(e).first()
    assert (counts.new_destinations, counts.new_hosts, counts.new_sources) == (2, 2, 1) and counts.by_orientation.startswith("LogOn:4")


def test_technique_verdicts(spark):
    events = [event(1, result="Fail"), event(2, result="Fail"), event(3, result="Fail"), event(4, dest=True), event(5), event(6, orient="LogOff", dest=True), event(7, orient="TGT", how="?")]
    e = spark.createDataFrame(events, EVENT)
    cases = {
        ("T1110", (1, 2, 3)): ("Supported", "rule_met"), ("T1110.001", (1, 2)): ("Uncertain", "too_few_events"), ("T1110.003", (1,)): ("Uncertain", "rule_met"), ("T1550.002", (4,)): ("Supported", "rule_met"),
        ("T1550.003", (4,)): ("Rejected", "no_matching_event"), ("T1550.004", (4,)): ("Uncertain", "rule_met"), ("T1021", (5,)): ("Uncertain", "weaker_form"), ("T1021.001", (4,)): ("Rejected", "no_matching_event"),
        ("T1021.002", (4, 900)): ("Uncertain", "rule_met"), ("T1078", (4, 901)): ("Uncertain", "rule_met"), ("T1078.002", (6,)): ("Rejected", "no_matching_event"), ("T1558", (7,)): ("Uncertain", "rule_met"),
        ("T1556.004", (4,)): ("Rejected", "known_false"), ("T1003", (4,)): ("Rejected", "no_data_source"), ("T1136", (4,)): ("Uncertain", "no_rule"), ("T9999", (4,)): ("Rejected", "unknown_technique"), ("T1550", (902,)): ("Rejected", "no_cited_event"),
    }
    cited = spark.createDataFrame([("I", t, line) for (t, lines) in cases for line in (*lines, lines[0])], "incident_id string, technique string, source_line long")
    got = {r.technique: (r.verdict, r.reason) for r in verdicts.technique_verdicts(cited, e, verdicts.catalogue(spark)).collect()}
    assert got == {t: v for (t, _), v in cases.items()}


def test_claims(spark):
    facts = spark.createDataFrame([("I", 1, ["C1", "NTLM"]), ("I", 2, ["C2"]), ("I", None, ["U1@DOM1"])], "incident_id string, source_line long, entities array<string>")
    claims = [(1, "U1@DOM1 reached C1 by ntlm", [1]), (2, "C2 was reached", [1]), (3, "C9 was reached", [1]), (4, "C1 again", []), (5, "C1 again", [1, 77]), (6, "C1 and c2", [1, 2])]
    df = spark.createDataFrame([("I", i, t, x) for i, t, x in claims], "incident_id string, claim long, text string, lines array<long>")
    got = {r.claim: r.verdict for r in verdicts.claim_verdicts(df, facts).collect()}
    assert got == {1: "supported", 2: "partly_supported", 3: "unsupported", 4: "unsupported", 5: "partly_supported", 6: "supported"}


def test_negative_samples_in_a_dense_window(spark):
    edges = [(w, f"U{u}", f"C{c}") for w in (1, 2) for u in range(12) for c in range(20) if (u * 7 + c) % 20 < 20 - u % 6]
    df = spark.createDataFrame(edges, "window_end int, acting_user string, destination_computer string")
    for k in (1, 3, 50):
        got = {}
        for r in graph.negative_sample(df, k).collect():
            got.setdefault((r.window_end, r.acting_user), set()).add(r.destination_computer)
            assert (r.window_end, r.acting_user, r.destination_computer) not in set(edges)
        for w in (1, 2):
            for u in range(12):
                assert len(got.get((w, f"U{u}"), ())) == min(k, u % 6)


def test_lines_keep_their_numbers(spark, tmp_path):
    lines = [f"{i},u{i % 7}," + "x" * (i % 50) for i in range(1, 4001)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:2500]) + "\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("\n".join(lines[2500:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # many blocks a file
    try:
        got = {r.source_line: r.raw for r in authlog.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(lines, 1))


def test_quotes_duplicates_and_maps(spark):
    raw = ['5,"a,b",c,d,e,f,g,h,i', '5,"say ""x""",c,d,e,f,g,h,i', "5,a,b,c,d,e,f,g,h", "5,a,b,c,d,e,f,g,h", "6,a", '7,"",b,c,d,e,f,g,h']
    lines = spark.createDataFrame([(i + 1, x) for i, x in enumerate(raw)], "source_line long, raw string")
    p = {r.source_line: r for r in authlog.parse(lines).collect()}
    assert p[1].source_user == "a,b" and p[2].source_user == 'say "x"' and p[1].reason is None
    assert (p[5].reason, p[6].reason) == ("field_count", "empty_field")
    numbered = authlog.with_duplicate_ordinal(authlog.accepted(authlog.parse(lines)))
    assert {r.source_line: r.exact_duplicate_ordinal for r in numbered.collect()} == {1: 1, 2: 1, 3: 1, 4: 2}
    good = spark.createDataFrame([(i + 1, 10 * i + 3) for i in range(6)], "source_line long, mapped long")
    assert {r.source_line for r in authlog.apply_line_map(lines, good, 2).collect()} == {3, 13, 23, 33, 43, 53}
    for bad in (good.where("source_line <> 4"), good.withColumn("mapped", F.when(F.col("source_line") == 5, 1).otherwise(F.col("mapped")))):
        with pytest.raises(ValueError):
            authlog.apply_line_map(lines, bad, 2).count()


def test_guards(spark, tmp_path):
    events = spark.createDataFrame([(1, 10, "a"), (2, 20, "a"), (3, 15, "a")], "source_line long, timestamp long, acting_user string")
    with pytest.raises(ValueError):
        authlog.check_order(events)
    with pytest.raises(ValueError):
        history.check_sorted(events)
    assert history.check_sorted(events.where("source_line < 3")).count() == 2
    flags = spark.createDataFrame([(1, True), (2, False)], "source_line long, f boolean")
    assert history.join_flags(events.where("source_line < 3"), flags, ["f"]).count() == 2
    with pytest.raises(ValueError):
        history.join_flags(events, flags, ["f"])
    stored = spark.createDataFrame([("U", 1, 0.5, None), ("U", 1, 0.6, None), ("V", 1, 0.2, True)], "user string, hour long, score double, is_alert boolean")
    with pytest.raises(ValueError):
        packages.one_unit(stored, "U", 1)
    assert packages.one_unit(stored, "V", 1).count() == 1 and packages.one_unit(stored, "W", 1).count() == 0
    assert {r.score for r in packages.stored_alerts(stored, 0.55).collect()} == {0.6, 0.2}
    with pytest.raises(ValueError):
        packages.write_package(stored, stored, stored, str(tmp_path / "p"), "test")
    (tmp_path / "i.jsonl").write_text('{"incident_id": "A", "user": "u", "start": 5, "end": 4, "priority": "HIGH"}\nnot json\n')
    with pytest.raises(ValueError):
        packages.read_incidents(spark, str(tmp_path / "i.jsonl"))


def test_collapse_and_success_rules(spark):
    one = lambda f1, tp, fn: spark.createDataFrame([(f1, tp, fn)], "f1 double, tp long, fn long")
    cases = [((0.5, 0.2), 40, True), ((0.5, 0.45), 40, False), ((0.1, 0.02), 40, False), ((0.5, 0.45), 10, True), ((0.0, 0.3), 40, False)]
    for (a, b), positives, want in cases:
        assert graph.collapse_report(one(a, 9, 9), one(b, positives - 3, 3)).first().collapsed == want
    scorers = spark.createDataFrame([("ref", 0, 0.01), ("humans", 3, 0.02), ("x", 2, 0.03), ("y", 4, 0.015)], "scorer string, hits long, ap double")
    got = {r.scorer: (r.primary, r.secondary) for r in selection.success_rules(scorers, "ref", "humans").collect()}
    assert got["x"] == (True, False) and got["y"] == (True, False) and got["ref"] == (False, False)


def test_anchored_groups(spark):
    rng = random.Random(5)
    rows = {i: sorted(rng.randrange(1, rng.choice([60, 500, 20_000])) for _ in range(rng.randint(0, 40))) for i in range(40)}
    rows[99] = list(range(1, 4_000, 3))  # a long chain
    for seconds in (30, 1):
        got: dict = {}
        for r in behaviours.anchored_groups(spark.createDataFrame([(i, t) for i, x in rows.items() for t in x], "id long, t long"), ["id"], seconds).collect():
            got.setdefault(r.id, []).append((r.anchor, r["last"], r.n))
        for i, times in rows.items():
            want: list = []
            for t in times:
                if want and t - want[-1][0] <= seconds:
                    want[-1].append(t)
                else:
                    want.append([t])
            assert sorted(got.get(i, [])) == [(w[0], w[-1], len(w)) for w in want]


def test_interval_joins_meet_each_pair_once(spark):
    rng = random.Random(6)
    span = lambda: (a := rng.randrange(1, 300), a + rng.randrange(0, 120))
    a = [(i, rng.choice("xy"), *span()) for i in range(60)]
    b = [(i, rng.choice("xy"), *span()) for i in range(60)]
    left, right = spark.createDataFrame(a, "i int, k string, start long, end long"), spark.createDataFrame(b, "j int, k string, their_start long, their_end long")
    for width in (1, 7, 50, 1_000):
        got = sorted((r.i, r.j) for r in spans.overlapping(left, right, ["k"], width).collect())
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
        points = right.select("j", "k", F.col("their_start").alias("timestamp"))
        got = sorted((r.i, r.j) for r in spans.points_within(left, points, ["k"], width).collect())
        assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[2] < x[3])


def test_negatives_of_two_users_are_independent(spark):
    """Users with few edges among many computers: two users' negatives have about k * k / computers in common."""
    rng = random.Random(8)
    users, computers, k = 120, 259, 20
    edges = {(1, f"U{u}", f"C{c}") for u in range(users) for c in rng.sample(range(computers), 3)} | {(1, f"U{c % users}", f"C{c}") for c in range(computers)}
    got: dict = {}
    for r in graph.negative_sample(spark.createDataFrame(sorted(edges), "window_end int, acting_user string, destination_computer string"), k).collect():
        got.setdefault(r.acting_user, set()).add(r.destination_computer)
    assert {len(x) for x in got.values()} == {k} and len(got) == users
    common = [len(got[a] & got[b]) for a in got for b in got if a < b]
    assert abs(sum(common) / len(common) - k * k / computers) < 0.15 and max(common) < 12


def test_alert_counts_are_required(spark):
    alerts = spark.createDataFrame([("A1", "U1", 1, 1, 2)], "alert_id string, user string, hour long, day int, auth_count long")
    events = spark.createDataFrame([(5, "U1", 1, 1), (3600, "U1", 1, 2), (3601, "U1", 1, 3)], "timestamp long, acting_user string, dataset_day int, source_line long")
    assert {r.source_line for r in incidents.require_counts(alerts, events).collect()} == {1, 2}
    with pytest.raises(ValueError):
        incidents.require_counts(alerts.withColumn("auth_count", F.lit(3)), events)


def test_lookups_skip_what_has_no_line(spark, tmp_path):
    """Days of scattered lines: a Bloom filter on lines is written, the scan gets the filter, and few rows are read."""
    rows = [(d * 86_400 - 5, d, (i * 7919 + d * 13) % 1_000_003) for d in range(1, 9) for i in range(2_000)]
    log = spark.createDataFrame(rows, "timestamp long, dataset_day int, source_line long")
    authlog.write_days(log, str(tmp_path / "days"))
    wanted = [rows[5][2], rows[9_000][2], 999_999_999]
    found = authlog.lookup_lines(spark, str(tmp_path / "days"), wanted)
    assert sorted(r.source_line for r in found.collect()) == sorted(r[2] for r in rows if r[2] in wanted)
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PushedFilters: [In(source_line" in text

    def rows_read(bloom: bool) -> int:
        """Rows that the scan hands on when statistics may not help."""
        off = {f"parquet.filter.{x}.enabled": "false" for x in ("stats", "dictionary", "columnindex", "record-level")}
        read = spark.read.options(**off, **{"parquet.filter.bloom.enabled": str(bloom).lower()}).parquet(str(tmp_path / "days"))
        looked = read.where(F.col("source_line").isin(wanted[:2])).select("source_line", "timestamp")
        looked.collect()
        leaves = looked._jdf.queryExecution().executedPlan().collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value()

    assert rows_read(False) == len(rows) and rows_read(True) <= len(rows) // 2
    with pytest.raises(ValueError):
        authlog.lookup_lines(spark, "", list(range(2_000)))
