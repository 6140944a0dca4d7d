"""Work that grew faster than its input: each test counts or looks at what was repeated."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kestrelog import plans
from kestrelog.operators import selection

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_permutation_scores_all_trials_at_once(spark):
    """One scoring of one table for all inputs and seeds; the values that move are those of the draws."""
    rng, calls = random.Random(3), []
    rows = [(d, t * 7 + d, rng.random() < 0.4, rng.randrange(9), rng.randrange(9)) for d in (1, 2) for t in range(1_500)]
    df = spark.createDataFrame(rows, "day int, tie long, label boolean, a long, b long")

    def score(x):
        calls.append(1)
        return x.withColumn("score", F.col("a") * 10.0 + F.col("b"))

    got = {r.feature: r for r in selection.permutation_importance(df, ["a", "b"], score, 2).collect()}
    assert len(calls) == 1 and set(got) == {"a", "b"}

    import hashlib

    def ap(scored):
        tp = seen = total = 0
        for s in sorted({s for s, _ in scored}, reverse=True):
            step = [y for x, y in scored if x == s]
            seen, tp = seen + len(step), tp + sum(step)
            total += sum(step) * tp / seen
        return total / tp

    whole = ap([(a * 10 + b, y) for _, _, y, a, b in rows])
    for i, name in enumerate("ab"):
        losses = []
        for seed in range(2):
            moved = []
            for d in (1, 2):
                mine = sorted((r for r in rows if r[0] == d), key=lambda r: r[1])
                other = sorted(mine, key=lambda r: hashlib.md5(f"{name}/{seed}/{r[1]}".encode()).hexdigest())
                moved += [((o[3] if i == 0 else r[3]) * 10 + (o[4] if i == 1 else r[4]), r[2]) for r, o in zip(mine, other)]
            losses.append(whole - ap(moved))
        assert abs(got[name].loss - sum(losses) / 2) < 1e-9


def test_equal_rows_of_a_trial_are_scored_once(spark):
    """Scoring costs far more than counting: 4 inputs' values of 2,000 rows make 4 kinds of rows and 2 labels in each of 5 trials."""
    df = spark.createDataFrame([(1 + t % 2, t, t % 3 == 0, t % 2, t // 2 % 2) for t in range(2_000)], "day int, tie long, label boolean, a long, b long")
    seen = []

    def score(x):
        seen.append(x.count())
        return x.withColumn("score", F.col("a") * 10.0 + F.col("b"))

    assert selection.permutation_importance(df, ["a", "b"], score, 2).count() == 2
    assert seen[0] <= 4 * 2 * 5



def test_fits_and_forests_read_a_stored_table(spark):
    """What is scored last is read, not computed again from the log."""
    for name in ("supervised_logistic", "supervised_boosted_trees", "baseline_isolation_forest"):
        assert "Window" not in plan_of(plans.queries()[name](spark, SF))


def test_frames_of_a_user_are_put_in_order_together(spark):
    """Arrow hands a user's rows over in pieces of any size, whose order is not that of time."""
    from kestrelog.operators import history
    from kestrelog.plans import streams
    from kestrelog.sources import adapters
    from kestrelog.streaming import login

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        out = streams.finished(login.history_features(streams.replayed(spark, SF, at=F.col("timestamp"), closing=False)))
        got = {tuple(r) for r in out.select("source_line", *streams._FLAGS).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {tuple(r) for r in history.history_features(adapters.auth_events(spark, SF)).select("source_line", *streams._FLAGS).collect()}


def test_a_part_of_the_replay_is_written_by_several_tasks(spark, monkeypatch):
    """A micro-batch is a part, in as many files as its rows ask for."""
    from kestrelog.plans import streams
    from kestrelog.sources import adapters

    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    stream, sizes = streams.replayed(spark, SF, at=F.col("timestamp"), closing=False), {}
    q = stream.writeStream.foreachBatch(lambda batch, i: sizes.update({i: (batch.count(), batch.select(F.input_file_name()).distinct().count())})).trigger(availableNow=True).start()
    q.awaitTermination()
    low, high = adapters.auth_events(spark, SF).agg(F.min("timestamp"), F.max("timestamp")).first()
    part = F.floor((F.col("timestamp") - low) * streams.PARTS / (high - low + 1)).alias("k")
    assert {k: n for k, (n, _) in sizes.items()} == {r.k: r["count"] for r in adapters.auth_events(spark, SF).groupBy(part).count().collect()}
    assert all(files > 1 for _, files in sizes.values())


def test_search_index_holds_the_terms_asked_for_and_finds_the_same(spark, tmp_path):
    """Postings of other terms are not written for one search; weights and the vocabulary are those of the whole index."""
    from kestrelog.operators import retrieval

    rng = random.Random(8)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(docs, "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(6))) for q in range(9)], "query long, text string")
    whole = retrieval.build(docs, str(tmp_path / "whole"), retrieval.ENGLISH)
    part = retrieval.build(docs, str(tmp_path / "part"), retrieval.ENGLISH, asked=asked)
    assert 0 < part.postings.count() < whole.postings.count() / 2
    hits = [sorted(map(tuple, retrieval.search(ix, asked, 4, 0.01).collect())) for ix in (whole, part)]
    assert hits[0] == hits[1] and hits[0]
    rounded = lambda v: {(r.term, r.docs, round(r.idf, 9), round(r.most, 9)) for r in v.collect()}
    assert rounded(retrieval.vocabulary(docs, retrieval.ENGLISH)) == rounded(whole.vocabulary)


def test_flags_of_the_log_are_found_once(spark, monkeypatch):
    """The queue, its events and what is cited of them come from one pass over the log."""
    from kestrelog.operators import history

    calls, plain = [], history.novelty
    monkeypatch.setattr(history, "novelty", lambda events, *more: calls.append(1) or plain(events, *more))
    for name in ("replies_linked_techniques", "alerts_headline", "evidence_claim_order"):
        calls.clear()
        plans.queries()[name](spark, SF)
        assert len(calls) == 1


def test_records_gather_the_log_of_the_queues_users(spark, monkeypatch):
    """Lines of hours are gathered for users of the queue, not for everybody."""
    from kestrelog.operators import sequences
    from kestrelog.plans import cases, detect

    q, seen, plain = detect.queue(spark, SF).where("user < 'U5'"), [], sequences.user_hours
    monkeypatch.setattr(sequences, "user_hours", lambda events: seen.append(events) or plain(events))
    full = detect.queue_of(detect.counts(spark, SF), *cases.records.COUNTS).where("user < 'U5'")
    cases.nested(spark, SF, full)
    users = {r.user for r in q.select("user").distinct().collect()}
    assert users and {r[0] for r in seen[0].select("acting_user").distinct().collect()} == users


def test_trees_do_not_copy_rows(spark, monkeypatch):
    """Rows are stored once, whatever the number of trees; all else that growing stores is a row for each node at most."""
    from kestrelog.functions import tables
    from kestrelog.operators import extra_trees

    rng, sizes, plain = random.Random(5), [], tables.stored
    rows = [(rng.random(), float(rng.randrange(6)), rng.random() < 0.4) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "a double, b double, label boolean")

    def stored(x, name):
        out = plain(x, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(tables, "stored", stored)
    trees = extra_trees.grow(df, ["a", "b"], extra_trees.Settings(trees=6, depth=3))
    assert sorted(sizes)[-1] == 3_000 and sorted(sizes)[-2] <= 6 * 2**4 and trees.where("node = 1 and n = 3000").count() == 6
    plan = plan_of(extra_trees.scores(df.withColumn("k", F.lit(1)), ["k"], ["a", "b"], trees))
    assert "Generate" not in plan and "Join" not in plan


def test_a_row_without_a_value_ends_where_it_is_asked_for(spark):
    """Such a row counts at the nodes before, and has no score where no tree takes it to a leaf; NaN goes right."""
    from kestrelog.operators import extra_trees

    rows = [(k, float(k % 10), k % 10 > 5) for k in range(100)] + [(100, None, True), (101, float("nan"), True)]
    df = spark.createDataFrame(rows, "k int, a double, label boolean")
    trees = extra_trees.grow(df, ["a"], extra_trees.Settings(trees=3, depth=4, share=1.0))
    count = {(r.tree, r.node): (r.n, r.feature) for r in trees.collect()}
    assert all(count[t, 1][0] == 102 for t in range(3))
    assert all(count[t, 2][0] + count[t, 3][0] == 101 for t in range(3) if count[t, 1][1] is not None)
    score = {r.k: r.score for r in extra_trees.scores(df, ["k"], ["a"], trees).collect()}
    assert len(score) == 102 and score[100] is None and score[101] is not None


def test_source_features_follow_from_first_pairs(spark):
    """The log without flags gives what the flags of events give; several events of a second, and a source that is lost and comes back."""
    from kestrelog.operators import history

    rng = random.Random(9)
    rows = [(t := 1 + rng.randrange(4) * 86_400 + rng.randrange(3), line, f"U{rng.randrange(4)}", f"C{rng.randrange(3)}", f"D{rng.randrange(5)}", 1 + (t - 1) // 86_400) for line in range(1, 200)]
    log = spark.createDataFrame(rows, "timestamp long, source_line long, acting_user string, source_computer string, destination_computer string, dataset_day int")
    got = {(r.acting_user, r.dataset_day): (r.new_source_count, r.new_source_auth_count, r.new_host_connection_events) for r in selection.source_features(log).collect()}
    want: dict = {}
    flagged = history.novelty(log).collect()
    fresh = {(r.acting_user, r.dataset_day, r.source_computer) for r in flagged if r.is_new_user_source}
    for r in flagged:
        day = want.setdefault((r.acting_user, r.dataset_day), [set(), 0, 0])
        if (r.acting_user, r.dataset_day, r.source_computer) in fresh:
            day[0].add(r.source_computer)
            day[1] += 1
        day[2] += r.is_new_host_connection
    assert got == {k: (len(a), b, c) for k, (a, b, c) in want.items()}


def test_a_calibrator_computes_its_references_once(spark):
    from kestrelog.operators import metrics

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    metrics.fit_calibrator(spark.range(500).selectExpr("cast(id as double) as score").mapInArrow(count, "score double"))
    assert seen.value == 500


def test_grid_reads_labels_and_numbers_edges_once(spark, monkeypatch):
    """Eight trials read one table of labels; edges are numbered for each window, not for each rank, and have no lines."""
    from kestrelog.functions import tables
    from kestrelog.operators import graph
    from kestrelog.sources import adapters

    calls, plain, keep = [], adapters.red_team, tables.stored
    monkeypatch.setattr(adapters, "red_team", lambda *a: calls.append("labels") or plain(*a))
    monkeypatch.setattr(tables, "stored", lambda df, name: calls.append(name) or keep(df, name))
    number = graph.StringIndexer
    monkeypatch.setattr(graph, "StringIndexer", lambda **k: calls.append("indexer") or number(**k))
    found = plans.queries()["graph_grid"](spark, SF)
    assert calls.count("indexer") == 4 and calls.count("grid-scores") == 4
    assert calls.count("labels") == 2  # asked for and stored once
    assert found.count() == 8
    e = adapters.auth_events(spark, SF)
    for width in (43_200, 86_400):
        w = graph.assign_windows(e, width, width)
        pick = lambda df: {(r.window_end, r.acting_user, r.destination_computer, r.weight) for r in df.select("window_end", *graph.EDGE, "weight").collect()}
        assert pick(graph.edge_weights(w)) == pick(graph.edges(w, width))


def test_feature_shares_read_stored_scores(spark):
    """Chunks and their evidence come from events that were scored once."""
    assert "is_new_host_connection" not in plan_of(plans.queries()["score_feature_shares"](spark, SF))
