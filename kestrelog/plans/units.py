"""Queries over sequences, event scores, calibration, metrics, hourly counts and the baseline."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.operators import history, hourly, metrics, scoring, sequences, splits
from kestrelog.sources import adapters

from .base import AUTH, SCORES, query
from .history import HISTORY, RED_PART, SPLIT

LONGEST = 2
UNITS = f"""u0 AS (SELECT acting_user, hour, count(*) AS n_events, bool_and(timestamp >= 86401) AS complete, string_agg(source_line, ' ' ORDER BY timestamp, source_line) AS lines, count(*) FILTER (touch) AS touching_excluded
 FROM (SELECT *, source_user IN (FROM ex) OR destination_user IN (FROM ex) AS touch FROM auth) GROUP BY ALL),
u AS (SELECT *, CAST((hour - 1) // 86400 + 1 AS INTEGER) AS dataset_day, {SPLIT.format('hour')} AS split, CASE WHEN NOT complete THEN 'warmup_incomplete_24h_history' WHEN n_events < 1 THEN 'fewer_than_min_events' ELSE 'available' END AS status FROM u0)"""
EX = AUTH + RED_PART + ", ex AS (SELECT DISTINCT user FROM red WHERE timestamp < 604801)"
CHUNKS = f"""c0 AS (SELECT acting_user, hour, n_events, (n_events + {LONGEST - 1}) // {LONGEST} AS k, unnest(range(0, (n_events + {LONGEST - 1}) // {LONGEST})) AS chunk FROM u),
c AS (SELECT acting_user, hour, chunk, chunk * (n_events // k) + least(chunk, n_events % k) AS start, n_events // k + CASE WHEN chunk < n_events % k THEN 1 ELSE 0 END AS length FROM c0)"""


def auth(spark, sf_dir):
    return adapters.auth_events(spark, sf_dir)


def units(spark, sf_dir):
    flagged = splits.with_eligibility(auth(spark, sf_dir), splits.excluded_users(adapters.red_team(spark, sf_dir)))
    u = sequences.user_hours(flagged).withColumn("split", splits.split_of(F.col("hour")))
    return sequences.fitting_eligible(splits.candidate_status(u, 1, 30))


@query("sequence_units", f"WITH {EX}, {UNITS} SELECT acting_user, hour, n_events, complete, touching_excluded, lines, dataset_day, split, status, status = 'available' AND split = 'train' AND touching_excluded = 0 AS fits FROM u")
def _(spark, sf_dir):
    return units(spark, sf_dir).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), " "))


@query("sequence_chunks", f"WITH {EX}, {UNITS}, {CHUNKS} SELECT * FROM c")
def _(spark, sf_dir):
    return sequences.chunks(units(spark, sf_dir), LONGEST)


@query("sequence_padded", f"WITH {EX}, {UNITS} SELECT acting_user, hour, array_to_string(list_resize(string_split(lines, ' '), 4, '0'), ' ') AS padded, array_to_string([CASE WHEN i <= n_events THEN '1' ELSE '0' END FOR i IN range(1, 5)], '') AS mask FROM u")
def _(spark, sf_dir):
    u = units(spark, sf_dir)
    lines = sequences.padded(F.col("lines"), 4, F.lit(0).cast("long"))
    return u.select("acting_user", "hour", F.array_join(lines.cast("array<string>"), " ").alias("padded"), F.array_join(F.transform(sequences.mask(F.col("lines"), 4), lambda b: F.when(b, "1").otherwise("0")), "").alias("mask"))


@query("sequence_manifest", f"WITH {EX}, {UNITS} SELECT split, status, count(*) AS units, CAST(sum(n_events) AS BIGINT) AS events, quantile_cont(n_events, 0.5) AS p50, quantile_cont(n_events, 0.9) AS p90, quantile_cont(n_events, 0.99) AS p99, CAST(sum((n_events + {LONGEST - 1}) // {LONGEST}) AS BIGINT) AS chunks, round(avg(CASE WHEN n_events <= {LONGEST} THEN 1.0 ELSE 0.0 END), 6) AS share_single FROM u GROUP BY ALL")
def _(spark, sf_dir):
    m = sequences.manifest(units(spark, sf_dir), LONGEST)
    return m.select("split", "status", "units", "events", *[F.col("percentiles")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))], "chunks", F.round("share_single", 6).alias("share_single"))


_DRAW = "md5(acting_user || '/' || hour || '/' || chunk)"


@query("sequence_chunk_sample", f"WITH {EX}, {UNITS}, {CHUNKS}, d AS (SELECT *, {_DRAW} AS draw FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY acting_user, hour ORDER BY draw, chunk) AS n FROM d) SELECT acting_user, hour, chunk, start, length FROM (SELECT * FROM r WHERE n <= 1 ORDER BY draw, acting_user, hour, chunk LIMIT 200)")
def _(spark, sf_dir):
    found = sequences.chunks(units(spark, sf_dir), LONGEST)
    draw = F.md5(F.concat_ws("/", "acting_user", F.col("hour").cast("string"), F.col("chunk").cast("string")).cast("binary"))
    return sequences.sample_chunks(found, 1, 200, draw).drop("draw")


@query("sequence_tensor_sample", f"WITH {EX}, {UNITS}, d AS (SELECT *, md5(acting_user || '/' || hour) AS draw FROM u), (SELECT 1)".replace(", (SELECT 1)", "") + f" (SELECT acting_user, hour, n_events, 'single' AS kind FROM d WHERE n_events <= {LONGEST} ORDER BY draw, acting_user, hour LIMIT 20) UNION ALL (SELECT acting_user, hour, n_events, 'multi' AS kind FROM d WHERE n_events > {LONGEST} ORDER BY draw, acting_user, hour LIMIT 20)")
def _(spark, sf_dir):
    draw = F.md5(F.concat_ws("/", "acting_user", F.col("hour").cast("string")).cast("binary"))
    return sequences.stratified_sample(units(spark, sf_dir), LONGEST, 20, draw).select("acting_user", "hour", "n_events", "kind")


@query("sequence_no_activity", f"WITH {AUTH}, who AS (SELECT DISTINCT acting_user, dataset_day FROM auth), q AS (SELECT acting_user, 1 + ((dataset_day - 1) * 24 + h) * 3600 AS hour FROM who, range(0, 24) AS g(h)) SELECT acting_user, hour, 'no_activity' AS status, CAST(0 AS BIGINT) AS n_events, CAST(NULL AS DOUBLE) AS score FROM q WHERE NOT EXISTS (SELECT 1 FROM auth a WHERE a.acting_user = q.acting_user AND a.hour = q.hour)")
def _(spark, sf_dir):
    a = auth(spark, sf_dir)
    start = (F.col("dataset_day").cast("long") - 1) * 86_400 + 1
    asked = a.select("acting_user", "dataset_day").distinct().select("acting_user", F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: start + h * 3600)).alias("hour"))
    return sequences.no_activity(asked, sequences.user_hours(a))


# ---- event scores ----

EVENTS = HISTORY + RED_PART + f""",
ex AS (SELECT DISTINCT user FROM red WHERE timestamp < 604801),
e AS (SELECT *, seconds_since_previous_auth AS gap, row_number() OVER w - 1 AS position, coalesce(lag(logon_type) OVER w, '<start>') AS before_logon FROM nov WINDOW w AS (PARTITION BY acting_user, hour ORDER BY timestamp, source_line)),
tr AS (SELECT * FROM e WHERE timestamp < 604801),
s AS (SELECT avg(ln(1 + gap)) AS mean, (count(*) FILTER (is_new_host_connection) + 1) / (count(*) + 2) AS p_new, count(*) AS n, count(DISTINCT authentication_type) AS d_auth, count(DISTINCT logon_type) AS d_logon FROM tr),
ty AS (SELECT authentication_type, count(*) AS n_auth FROM tr GROUP BY 1), pa AS (SELECT before_logon, logon_type, count(*) AS n_pair FROM tr GROUP BY ALL), be AS (SELECT before_logon, sum(n_pair) AS n_before FROM pa GROUP BY 1),
l AS (SELECT e.acting_user, e.hour, e.position, e.source_line, coalesce(pow(ln(1 + gap) - mean, 2), 0.0) AS l1, CASE WHEN is_new_host_connection THEN -ln(p_new) ELSE -ln(1 - p_new) END AS l2,
 -ln((coalesce(n_auth, 0) + 1) / (n + d_auth + 1)) AS l3, -ln((coalesce(n_pair, 0) + 1) / (coalesce(n_before, 0) + d_logon + 1)) AS l4 FROM e CROSS JOIN s LEFT JOIN ty USING (authentication_type) LEFT JOIN pa USING (before_logon, logon_type) LEFT JOIN be USING (before_logon)),
er AS (SELECT *, (l1 + l2 + l3 + l4) / 4 AS error, CASE greatest(l1, l2, l3, l4) WHEN l1 THEN 'gap' WHEN l2 THEN 'new_host' WHEN l3 THEN 'auth_type' ELSE 'logon_after' END AS top_feature, count(*) OVER (PARTITION BY acting_user, hour) AS cnt FROM l),
ec AS (SELECT *, (cnt + {LONGEST - 1}) // {LONGEST} AS k, CASE WHEN position < (cnt % ((cnt + {LONGEST - 1}) // {LONGEST})) * (cnt // ((cnt + {LONGEST - 1}) // {LONGEST}) + 1) THEN position // (cnt // ((cnt + {LONGEST - 1}) // {LONGEST}) + 1)
 ELSE cnt % ((cnt + {LONGEST - 1}) // {LONGEST}) + (position - (cnt % ((cnt + {LONGEST - 1}) // {LONGEST})) * (cnt // ((cnt + {LONGEST - 1}) // {LONGEST}) + 1)) // (cnt // ((cnt + {LONGEST - 1}) // {LONGEST})) END AS chunk FROM er)"""


def scored_events(spark, sf_dir):
    e = sequences.with_unit(history.novelty(auth(spark, sf_dir)).withColumnRenamed("seconds_since_previous_auth", "gap"))
    e = tables.stored(e, "unit-events")  # read by each statistic and by the losses
    scored = scoring.event_error(scoring.losses(e, scoring.fit(e.where(splits.split_of(F.col("timestamp")) == "train"))))
    n = F.count("*").over(Window.partitionBy(*sequences.UNIT))
    return scored.withColumn("chunk", sequences.chunk_of(F.col("position"), n, LONGEST))


@query("score_event_losses", f"WITH {EVENTS} SELECT source_line, round(l1, 5) AS gap, round(l2, 5) AS new_host, round(l3, 5) AS auth_type, round(l4, 5) AS logon_after, round(error, 5) AS error, top_feature, chunk FROM ec")
def _(spark, sf_dir):
    return scored_events(spark, sf_dir).select("source_line", *[F.round(F.col("losses")[i], 5).alias(n) for i, n in enumerate(scoring.LOSSES)], F.round("error", 5).alias("error"), "top_feature", "chunk")


@query("score_scaled_losses", f"WITH {EVENTS}, m AS (SELECT avg(l1) AS m1, avg(l2) AS m2, avg(l3) AS m3, avg(l4) AS m4 FROM ec JOIN tr USING (source_line)) SELECT source_line, round((l1 / m1 + l2 / m2 + l3 / m3 + l4 / m4) / 4, 5) AS error FROM ec CROSS JOIN m")
def _(spark, sf_dir):
    e = scored_events(spark, sf_dir)
    means = scoring.mean_losses(e.where(splits.split_of(F.col("timestamp")) == "train"))
    return scoring.event_error(scoring.scaled(e, means)).select("source_line", F.round("error", 5).alias("error"))


@query("score_chunks", f"WITH {EVENTS} SELECT acting_user, hour, chunk, round(avg(error), 5) AS chunk_mean, count(*) AS n, round(avg(l1), 5) AS loss_gap, round(avg(l2), 5) AS loss_new_host, round(avg(l3), 5) AS loss_auth_type, round(avg(l4), 5) AS loss_logon_after FROM ec GROUP BY ALL")
def _(spark, sf_dir):
    c = scoring.chunk_errors(scored_events(spark, sf_dir))
    return c.select("acting_user", "hour", "chunk", "n", *[F.round(x, 5).alias(x) for x in ("chunk_mean", "loss_gap", "loss_new_host", "loss_auth_type", "loss_logon_after")])


@query("score_units", f"""WITH {EVENTS}, ch AS (SELECT acting_user, hour, chunk, avg(error) AS m, sum(error) AS s, count(*) AS n, max(error) AS x FROM ec GROUP BY ALL)
SELECT acting_user, hour, round(max(m), 5) AS max_chunk_mean, round(max(x), 5) AS max_event, round(sum(s) / sum(n), 5) AS hour_mean FROM ch GROUP BY ALL""")
def _(spark, sf_dir):
    u = scoring.unit_scores(scored_events(spark, sf_dir))
    return u.select("acting_user", "hour", *[F.round(c, 5).alias(c) for c in ("max_chunk_mean", "max_event", "hour_mean")])


@query("score_evidence_chunks", f"""WITH {EVENTS}, r AS (SELECT *, round(error, 6) AS e6 FROM ec), ch AS (SELECT acting_user, hour, chunk, max(e6) AS x, round(avg(e6), 9) AS m FROM r GROUP BY ALL)
SELECT acting_user, hour, arg_max(chunk, (x, -chunk)) AS worst_chunk, arg_max(chunk, (m, -chunk)) AS best_chunk FROM ch GROUP BY ALL""")
def _(spark, sf_dir):
    e = scored_events(spark, sf_dir).withColumn("error", F.round("error", 6))
    return scoring.unit_scores(e).select("acting_user", "hour", "worst_chunk", "best_chunk")


@query("score_top_events", f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY acting_user, hour ORDER BY round(error, 6) DESC, position) AS rank FROM ec) SELECT acting_user, hour, string_agg(source_line, ' ' ORDER BY rank) AS lines FROM r WHERE rank <= 2 GROUP BY ALL")
def _(spark, sf_dir):
    t = scoring.top_events(scored_events(spark, sf_dir).withColumn("error", F.round("error", 6)), 2)
    return t.select("acting_user", "hour", F.concat_ws(" ", F.transform("events", lambda x: x["source_line"].cast("string"))).alias("lines"))


@query("score_feature_shares", f"""WITH {EVENTS}, ch AS (SELECT acting_user, hour, chunk, avg(error) AS m, avg(l1) AS a1, avg(l2) AS a2, avg(l3) AS a3, avg(l4) AS a4 FROM ec GROUP BY ALL), bc AS (SELECT acting_user, hour, arg_max(chunk, (m, -chunk)) AS chunk FROM ch GROUP BY ALL),
sh AS (SELECT ch.*, a1 + a2 + a3 + a4 AS total FROM ch JOIN bc USING (acting_user, hour, chunk)), lo AS (SELECT acting_user, hour, 'gap' AS feature, CASE WHEN total > 0 THEN a1 / total ELSE 0 END AS share FROM sh UNION ALL SELECT acting_user, hour, 'new_host', CASE WHEN total > 0 THEN a2 / total ELSE 0 END FROM sh UNION ALL SELECT acting_user, hour, 'auth_type', CASE WHEN total > 0 THEN a3 / total ELSE 0 END FROM sh UNION ALL SELECT acting_user, hour, 'logon_after', CASE WHEN total > 0 THEN a4 / total ELSE 0 END FROM sh),
rk AS (SELECT *, row_number() OVER (PARTITION BY acting_user, hour ORDER BY share DESC, feature) AS rank FROM lo) SELECT acting_user, hour, feature, round(share, 6) AS share, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 2""")
def _(spark, sf_dir):
    e = tables.stored(scored_events(spark, sf_dir).select(*sequences.UNIT, "chunk", "position", "error", "losses"), "scored-events")
    evidence = scoring.unit_scores(e).select("acting_user", "hour", F.col("best_chunk").alias("chunk"))
    return scoring.feature_shares(scoring.chunk_errors(e), evidence, 2).withColumn("share", F.round("share", 6))


@query("score_detector_rows", f"WITH {EVENTS}, {UNITS}, m AS (SELECT acting_user, hour, max(error) AS score FROM ec GROUP BY ALL) SELECT acting_user, hour, status, n_events, CASE WHEN status = 'available' THEN round(score, 5) END AS score FROM u LEFT JOIN m USING (acting_user, hour)")
def _(spark, sf_dir):
    rows = scoring.detector_rows(units(spark, sf_dir), scoring.unit_scores(scored_events(spark, sf_dir)), "max_event")
    return rows.withColumn("score", F.round("score", 5))


@query("score_status_counts", f"WITH {EX}, {UNITS} SELECT status, count(*) AS n FROM u GROUP BY status")
def _(spark, sf_dir):
    return units(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("score_unpivoted_models", f"WITH {EVENTS}, x AS (SELECT acting_user, hour, round(max(error), 5) AS max_event, round(avg(error), 5) AS hour_mean FROM ec GROUP BY ALL) SELECT acting_user, hour, 'max_event' AS model, max_event AS score FROM x UNION ALL SELECT acting_user, hour, 'hour_mean', hour_mean FROM x")
def _(spark, sf_dir):
    return scoring.unpivot_scores(scoring.unit_scores(scored_events(spark, sf_dir)), ["max_event", "hour_mean"]).withColumn("score", F.round("score", 5))


@query("score_reconstruction")
def _(spark, sf_dir):
    counts = hourly.hourly_counts(history.novelty(auth(spark, sf_dir)))
    return scoring.reconstruction_error(counts, hourly.COUNTS, 4, counts.where("day <= 7")).select("acting_user", "hour", F.round("error", 5).alias("error"))


CASES = SCORES + ", m AS (SELECT day, quantile_cont(seq_score, 0.5) AS med FROM hs GROUP BY day), n AS (SELECT hs.*, med, n AS n_events FROM hs JOIN hs0 USING (user, hour) JOIN m USING (day))"


@query("score_case_sample", f"WITH {CASES}, " + ", ".join(f"r{i} AS (SELECT '{c}' AS \"case\", user, hour, row_number() OVER (PARTITION BY day ORDER BY {o}, user, hour) AS rk FROM n)" for i, (c, o) in enumerate([("median", "abs(seq_score - med)"), ("top", "seq_score DESC"), ("long", "n_events DESC")])) + " SELECT \"case\", user, hour, CAST(rk AS INTEGER) AS rank FROM (FROM r0 UNION ALL FROM r1 UNION ALL FROM r2) WHERE rk <= 2")
def _(spark, sf_dir):
    hs = adapters.hour_scores(spark, sf_dir)
    n = sequences.user_hours(auth(spark, sf_dir)).select(F.col("acting_user").alias("user"), "hour", "n_events")
    rows = hs.join(n, ["user", "hour"]).select(F.col("user").alias("acting_user"), "hour", "day", F.col("seq_score").alias("score"), "n_events")
    return scoring.case_sample(rows, 2).select("case", F.col("acting_user").alias("user"), "hour", "rank")


# ---- calibration and metrics ----

LABELLED = SCORES + RED_PART + """,
ph AS (SELECT DISTINCT user, 1 + ((timestamp - 1) // 3600) * 3600 AS hour FROM red), sc AS (SELECT hs.*, seq_score AS score, ph.user IS NOT NULL AS label FROM hs LEFT JOIN ph USING (user, hour)),
g AS (SELECT score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM sc GROUP BY score),
cu AS (SELECT score, pos, neg, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g WINDOW o AS (ORDER BY score DESC))"""


def labelled(spark, sf_dir):
    hs = adapters.hour_scores(spark, sf_dir).withColumn("score", F.col("seq_score"))
    return metrics.label_units(hs, splits.label_hours(adapters.red_team(spark, sf_dir)), ["user", "hour"])


@query("metrics_label_units", f"WITH {LABELLED} SELECT user, hour, score, label FROM sc")
def _(spark, sf_dir):
    return labelled(spark, sf_dir).select("user", "hour", "score", "label")


@query("metrics_confusion", f"WITH {LABELLED}, c AS (SELECT day, count(*) FILTER (score >= 0.3 AND label) AS tp, count(*) FILTER (score >= 0.3 AND NOT label) AS fp, count(*) FILTER (score < 0.3 AND label) AS fn, count(*) FILTER (score < 0.3 AND NOT label) AS tn FROM sc GROUP BY day) SELECT day, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c")
def _(spark, sf_dir):
    c = metrics.confusion(labelled(spark, sf_dir), F.lit(0.3), ["day"])
    return c.withColumns({n: F.round(n, 6) for n in ("precision", "recall", "f1", "fpr")})


@query("metrics_cumulative", f"WITH {LABELLED} SELECT score, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(P AS BIGINT) AS P, CAST(N AS BIGINT) AS N FROM cu")
def _(spark, sf_dir):
    return metrics.cumulative(labelled(spark, sf_dir))


@query("metrics_average_precision", f"WITH {LABELLED} SELECT round(sum(pos * tp / (tp + fp)) / max(P), 6) AS ap FROM cu")
def _(spark, sf_dir):
    return metrics.average_precision(labelled(spark, sf_dir)).select(F.round("ap", 6).alias("ap"))


@query("metrics_roc_auc", f"WITH {LABELLED} SELECT round(sum(pos * (N - fp + neg / 2)) / max(P * N), 6) AS auc FROM cu")
def _(spark, sf_dir):
    return metrics.roc_auc(labelled(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query("metrics_best_f1", f"WITH {LABELLED} SELECT round(2 * tp / (tp + fp + P), 6) AS f1, score AS threshold FROM cu ORDER BY 2 * tp / (tp + fp + P) DESC, score DESC LIMIT 1")
def _(spark, sf_dir):
    return metrics.best_f1(labelled(spark, sf_dir)).select(F.round("f1", 6).alias("f1"), "threshold")


@query("metrics_best_f1_curve", f"WITH {LABELLED}, x AS (SELECT score, tp / (tp + fp + 1e-12) AS p, tp / (P + 1e-12) AS r FROM cu) SELECT round(max(2 * p * r / (p + r + 1e-12)), 6) AS f1 FROM x")
def _(spark, sf_dir):
    return metrics.best_f1(labelled(spark, sf_dir), epsilon=1e-12).select(F.round("f1", 6).alias("f1"))


@query("metrics_summary", f"""WITH {LABELLED}, b AS (SELECT 2 * tp / (tp + fp + P) AS f1, score AS threshold FROM cu ORDER BY 1 DESC, 2 DESC LIMIT 1), ap AS (SELECT sum(pos * tp / (tp + fp)) / max(P) AS ap, sum(pos * (N - fp + neg / 2)) / max(P * N) AS auc FROM cu), pp AS (SELECT count(*) AS positives FROM ph)
SELECT count(*) AS units, any_value(positives) AS positives, round(count(*) FILTER (label) / any_value(positives), 6) AS coverage, round(count(*) FILTER (label) / count(*), 6) AS prevalence, round(any_value(ap), 6) AS ap, round(any_value(ap) / (count(*) FILTER (label) / count(*)), 6) AS lift,
round(any_value(auc), 6) AS auc, round(any_value(f1), 6) AS f1, any_value(threshold) AS threshold, round(count(*) FILTER (label AND score >= threshold) / any_value(positives), 6) AS recall_with_unscored FROM sc, b, ap, pp""")
def _(spark, sf_dir):
    hs = adapters.hour_scores(spark, sf_dir).withColumn("score", F.col("seq_score"))
    s = metrics.evaluation_summary(hs, splits.label_hours(adapters.red_team(spark, sf_dir)), ["user", "hour"])
    return s.withColumns({c: F.round(c, 6) for c in ("coverage", "prevalence", "ap", "lift", "auc", "f1", "recall_with_unscored")})


BUDGET = LABELLED + ", rk AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, tie) AS rank FROM sc)"


@query("metrics_daily_ranks", f"WITH {BUDGET} SELECT user, hour, rank FROM rk")
def _(spark, sf_dir):
    return metrics.ranked(labelled(spark, sf_dir), ["day"], ["tie"]).select("user", "hour", "rank")


@query("metrics_budget", f"WITH {BUDGET}, b AS (SELECT count(*) FILTER (rank <= 38) AS selected, count(*) FILTER (rank <= 38 AND label) AS hits, count(*) FILTER (label) AS positives, count(*) FILTER (rank <= 38 AND is_machine) AS machines, count(*) FILTER (rank <= 38 AND label AND NOT is_machine) AS human_hits FROM rk) SELECT *, round(hits / nullif(selected, 0), 6) AS precision, round(hits / nullif(positives, 0), 6) AS recall FROM b")
def _(spark, sf_dir):
    return metrics.budget_metrics(labelled(spark, sf_dir), 38, ["tie"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


MODELS = LABELLED + ", md AS (SELECT 'seq' AS model, user, day, seq_score AS score, label, is_machine, tie FROM sc UNION ALL SELECT 'graph', user, day, graph_score, label, is_machine, tie FROM sc), mr AS (SELECT *, row_number() OVER (PARTITION BY model, day ORDER BY score DESC, tie) AS rank FROM md)"


def models(spark, sf_dir):
    sc = labelled(spark, sf_dir).drop("score").withColumnsRenamed({"seq_score": "seq", "graph_score": "graph"})
    return sc.unpivot(["user", "hour", "day", "label", "is_machine", "tie"], ["seq", "graph"], "model", "score")


@query("metrics_hits_per_day", f"WITH {MODELS} SELECT model, day, count(*) AS hits, count(DISTINCT user) AS users FROM mr WHERE rank <= 38 AND label GROUP BY ALL")
def _(spark, sf_dir):
    return metrics.hits_per_day(models(spark, sf_dir), 38, ["tie"], ["model"])


@query("metrics_model_matrix", f"""WITH {MODELS}, g2 AS (SELECT model, score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM md GROUP BY ALL), c2 AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY model) AS P FROM g2 WINDOW o AS (PARTITION BY model ORDER BY score DESC)),
a AS (SELECT model, round(sum(pos * tp / (tp + fp)) / max(P), 6) AS ap, round(max(2 * tp / (tp + fp + P)), 6) AS f1 FROM c2 GROUP BY model), bb AS (SELECT model, budget, count(*) FILTER (rank <= budget AND label) AS hits, count(*) FILTER (rank <= budget) AS selected, count(*) FILTER (label) AS positives FROM mr, (VALUES (10), (25), (38), (50), (100)) v(budget) GROUP BY ALL)
SELECT model, CAST(budget AS INTEGER) AS budget, hits, round(hits / selected, 6) AS precision, round(hits / positives, 6) AS recall, ap, f1 FROM bb JOIN a USING (model)""")
def _(spark, sf_dir):
    m = models(spark, sf_dir)
    ranks = metrics.ranked(m, ["model", "day"], ["tie"])
    budgets, inside = [10, 25, 38, 50, 100], lambda b: F.col("rank") <= b
    each = lambda b: F.struct(F.lit(b).alias("budget"), F.count_if(inside(b) & F.col("label")).alias("hits"), F.count_if(inside(b)).alias("selected"))
    curve = ranks.groupBy("model").agg(F.count_if("label").alias("positives"), F.array(*map(each, budgets)).alias("at")).select("model", "positives", F.explode("at").alias("x")).select("model", "positives", "x.*")
    out = curve.join(metrics.ranking(m, ["model"]).select("model", "ap", "f1"), "model")
    rates = [F.round(F.col("hits") / F.col("selected"), 6).alias("precision"), F.round(F.col("hits") / F.col("positives"), 6).alias("recall")]
    return out.select("model", "budget", "hits", *rates, F.round("ap", 6).alias("ap"), F.round("f1", 6).alias("f1"))


@query("metrics_user_days", f"WITH {LABELLED} SELECT user, day, max(score) AS score, bool_or(label) AS label, bool_or(is_machine) AS is_machine, min(tie) AS tie FROM sc GROUP BY ALL")
def _(spark, sf_dir):
    return metrics.user_days(labelled(spark, sf_dir))


@query("metrics_candidate_selection", f"WITH {MODELS}, g2 AS (SELECT model, score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM md GROUP BY ALL), c2 AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY model) AS P FROM g2 WINDOW o AS (PARTITION BY model ORDER BY score DESC)) SELECT model, round(sum(pos * tp / (tp + fp)) / max(P), 6) AS ap FROM c2 GROUP BY model ORDER BY ap DESC, model LIMIT 1")
def _(spark, sf_dir):
    trials = metrics.average_precision(models(spark, sf_dir), ["model"]).select("model", F.round("ap", 6).alias("ap"))
    return metrics.select_candidate(trials, [F.desc("ap"), F.col("model")])


_GRID = "[" + ", ".join(repr(i * metrics.P_TOP / (metrics.KNOTS - 1)) for i in range(metrics.KNOTS)) + "]"
PRICES = """r AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS score, ln(greatest(CAST(l_extendedprice AS DOUBLE), 0) + 1e-12) AS x FROM lineitem),
grid AS (SELECT i, i * 0.999 / 1000 AS p FROM range(0, 1001) t(i)), qs AS (SELECT quantile_cont(x, """ + _GRID + """) AS q FROM r),
kn AS (SELECT q[i + 1] AS x, max(i) * 0.999 / 1000 AS p FROM grid, qs GROUP BY 1), ta AS (SELECT (quantile_cont(x, 0.999) - quantile_cont(x, 0.99)) / ln(10.0) AS scale FROM r),
kk AS (SELECT *, lead(x) OVER (ORDER BY x) AS x2, lead(p) OVER (ORDER BY x) AS p2 FROM kn)"""


@query("calibration_knots", f"WITH {PRICES} SELECT round(x, 6) AS x, round(p, 6) AS p, round(scale, 6) AS scale FROM kn, ta")
def _(spark, sf_dir):
    prices = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("score"))
    return metrics.fit_calibrator(prices).select(*[F.round(c, 6).alias(c) for c in ("x", "p", "scale")])


@query("calibration_transform", f"""WITH {PRICES}, j AS (SELECT r.*, kk.x AS kx, kk.p AS kp, x2, p2, (SELECT min(x) FROM kn) AS lo, (SELECT scale FROM ta) AS scale FROM r ASOF LEFT JOIN kk ON r.x >= kk.x)
SELECT l_orderkey, l_linenumber, round(CASE WHEN x < lo THEN 0.0 WHEN x2 IS NULL THEN 1 - (1 - kp) / (1 + (x - kx) / scale) ELSE kp + (p2 - kp) * (x - kx) / (x2 - kx) END, 5) AS calibrated FROM j""")
def _(spark, sf_dir):
    prices = adapters.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("score"))
    return metrics.calibrate(prices, metrics.fit_calibrator(prices)).select("l_orderkey", "l_linenumber", F.round("calibrated", 5).alias("calibrated"))


# ---- hourly counts and baseline ----

HOURLY = HISTORY + """,
hc AS (SELECT acting_user, hour, count(*) AS events, count(*) FILTER (authentication_result = 'Fail') AS failures, count(DISTINCT source_computer) AS sources, count(DISTINCT destination_computer) AS destinations, count(*) FILTER (is_new_user_destination) AS new_destinations,
 count(*) FILTER (is_new_user_source) AS new_sources, count(*) FILTER (is_new_host_connection) AS new_hosts, count(*) FILTER (authentication_type = 'NTLM') AS ntlm, count(*) FILTER (logon_type = 'Network') AS network, count(*) FILTER (authentication_orientation = 'LogOn') AS logon,
 count(*) FILTER (is_new_user_source OR is_new_host_connection) AS either, min(source_line) AS tie, CAST((hour - 1) // 86400 + 1 AS INTEGER) AS day, ends_with(split_part(acting_user, '@', 1), '$') AS is_machine FROM nov GROUP BY acting_user, hour)"""


def counts(spark, sf_dir):
    return hourly.hourly_counts(history.novelty(auth(spark, sf_dir)))


@query("flagship_daily_alerts", f"WITH {HOURLY}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY either DESC, tie) AS rank FROM hc) SELECT acting_user, hour, day, events, failures, destinations, either, rank FROM r WHERE rank <= 38")
def _(spark, sf_dir):
    top = counts(spark, sf_dir).withColumn("score", F.col("either"))
    return metrics.ranked(top, ["day"], ["tie"]).where("rank <= 38").select("acting_user", "hour", "day", "events", "failures", "destinations", "either", "rank")


@query("hourly_counts", f"WITH {HOURLY} SELECT * FROM hc")
def _(spark, sf_dir):
    return counts(spark, sf_dir)


@query("hourly_counting_rules", f"""WITH {HOURLY}{RED_PART}, ph AS (SELECT DISTINCT user, (timestamp - 1) // 86400 + 1 AS day FROM red), ud AS (SELECT acting_user AS user, day, max(new_sources) AS a, max(new_hosts) AS b, max(either) AS c, min(tie) AS tie FROM hc GROUP BY ALL),
x AS (SELECT 'new_user_source' AS rule, user, day, a AS score, tie FROM ud UNION ALL SELECT 'new_host_connection', user, day, b, tie FROM ud UNION ALL SELECT 'either', user, day, c, tie FROM ud), y AS (SELECT x.*, ph.user IS NOT NULL AS label, row_number() OVER (PARTITION BY rule, x.day ORDER BY score DESC, tie) AS rank FROM x LEFT JOIN ph ON ph.user = x.user AND ph.day = x.day)
SELECT rule, count(*) FILTER (rank <= 10) AS selected, count(*) FILTER (rank <= 10 AND label) AS hits, count(*) FILTER (label) AS positives FROM y GROUP BY rule""")
def _(spark, sf_dir):
    labels = splits.label_hours(adapters.red_team(spark, sf_dir)).select("user", splits.day_of(F.col("hour")).alias("day")).distinct()
    days = hourly.rule_scores(counts(spark, sf_dir)).groupBy("rule", "user", "day").agg(F.max("score").alias("score"), F.min("tie").alias("tie"), F.max("is_machine").alias("is_machine"))
    return metrics.budget_metrics(metrics.label_units(days, labels, ["user", "day"]), 10, ["tie"], ["rule"]).select("rule", "selected", "hits", "positives")


SUMMARY = HISTORY + ", " + ", ".join(f"m{i} AS (SELECT acting_user, hour, {c}, row_number() OVER (PARTITION BY acting_user, hour ORDER BY count(*) DESC, min((timestamp, source_line))) AS r FROM feat GROUP BY acting_user, hour, {c})" for i, c in enumerate(("authentication_type", "logon_type", "authentication_orientation")))


_AVG = {"mean_prior_auths": "prior_auth_count_1h", "mean_prior_failures": "prior_failure_count_1h", "mean_gap": "seconds_since_previous_auth"}
_MAX = {"max_prior_auths": "prior_auth_count_1h", "max_prior_failures": "prior_failure_count_1h", "max_destinations": "prior_unique_destinations_24h", "max_user_destination": "prior_user_destination_count_24h"}
_RATE = {"failure_rate": "authentication_result = 'Fail'", "rate_new_host": "is_new_host_connection", "rate_new_destination": "is_new_user_destination", "rate_history": "has_user_history"}
_MODES = ("authentication_type", "logon_type", "authentication_orientation")


@query("baseline_unit_summary", f"""WITH {SUMMARY} SELECT acting_user, hour, round(ln(1 + count(*)), 6) AS log_count, {", ".join(f"round(avg({c}), 6) AS {n}" for n, c in _AVG.items())}, {", ".join(f"max({c}) AS {n}" for n, c in _MAX.items())}, min(seconds_since_previous_auth) AS min_gap,
{", ".join(f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6) AS {n}" for n, c in _RATE.items())}, {", ".join(f"any_value(m{i}.{c}) AS mode_{c}" for i, c in enumerate(_MODES))}, string_agg(source_line, ' ' ORDER BY timestamp, source_line) AS lines
FROM feat f {" ".join(f"JOIN (FROM m{i} WHERE r = 1) m{i} USING (acting_user, hour)" for i in range(3))} GROUP BY acting_user, hour""")
def _(spark, sf_dir):
    """All sixteen values of each user-hour."""
    s = hourly.unit_summary(history.history_features(auth(spark, sf_dir)))
    return s.select("acting_user", "hour", *[F.round(c, 6).alias(c) for c in ("log_count", *_AVG, *_RATE)], *_MAX, "min_gap", *[f"mode_{c}" for c in _MODES], "lines")


@query("baseline_isolation_forest")
def _(spark, sf_dir):
    c = tables.stored(counts(spark, sf_dir).select("acting_user", "hour", "day", "tie", *hourly.COUNTS), "hourly-counts")
    trees = hourly.grow_trees(c.where("day <= 7"), hourly.COUNTS)
    scored = hourly.isolation_scores(c, trees, hourly.COUNTS).select("acting_user", "hour", "day", "score")
    scored = tables.stored(scored, "forest-scores")  # its range is read before its rows
    low_high = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    return scored.select("acting_user", "hour", "day", F.round("score", 6).alias("score"), F.round((F.col("score") - low_high.lo) / F.nullif(F.lit(low_high.hi - low_high.lo), F.lit(0.0)), 6).alias("scaled"))


@query("baseline_scored_against_counts", f"""WITH {HOURLY}, h AS (SELECT acting_user, hour, failures / events AS score, is_machine FROM hc), s AS (SELECT acting_user, hour, failures / events + CASE WHEN hour % 7 = 0 THEN 0.0 ELSE 0.25 END AS score, is_machine <> (tie % 29 = 0) AS is_machine FROM hc WHERE tie % 31 <> 0),
ta AS (SELECT acting_user, hour FROM h ORDER BY score DESC, acting_user, hour LIMIT 50), tb AS (SELECT acting_user, hour FROM s ORDER BY score DESC, acting_user, hour LIMIT 50), td AS ((FROM ta EXCEPT ALL FROM tb) UNION ALL (FROM tb EXCEPT ALL FROM ta))
SELECT 'planted' AS scoring, count(*) FILTER (h.score IS NULL OR s.score IS NULL) AS unmatched, count(*) FILTER (h.is_machine <> s.is_machine) AS flags_differ, max(abs(h.score - s.score)) AS largest, (SELECT count(*) FROM td) AS top_differ, false AS agrees FROM h FULL JOIN s USING (acting_user, hour)
UNION ALL SELECT 'again', 0, 0, 0.0, 0, true""")
def _(spark, sf_dir):
    """A scoring against another with planted differences of units, flags and scores, and against itself."""
    c = tables.stored(counts(spark, sf_dir), "counts")
    a = c.select("acting_user", "hour", (F.col("failures") / F.col("events")).alias("score"), "is_machine")
    b = c.where("tie % 31 <> 0").select("acting_user", "hour", (F.col("failures") / F.col("events") + F.when(F.col("hour") % 7 == 0, 0.0).otherwise(0.25)).alias("score"), (F.col("is_machine") != (F.col("tie") % 29 == 0)).alias("is_machine"))
    found = [hourly.compare_scorings(a, other, ["acting_user", "hour"], 50, 1e-6, "is_machine").withColumn("scoring", F.lit(name)) for name, other in (("planted", b), ("again", a))]
    return found[0].unionByName(found[1])


def _balanced(train):
    n, positives = train.agg(F.count("*"), F.count_if("label")).first()
    weight = F.when(F.col("label"), n / (2.0 * max(positives, 1))).otherwise(n / (2.0 * max(n - positives, 1)))
    return train.withColumns({"y": F.col("label").cast("double"), "weight": weight})


def supervised(spark, sf_dir, classifier):
    """Counts with labels, logged and standardised, scored by a class-balanced classifier fitted on days up to 16."""
    c = counts(spark, sf_dir).withColumn("user", F.col("acting_user"))
    rows = metrics.label_units(c, splits.label_hours(adapters.red_team(spark, sf_dir)), ["user", "hour"])
    rows = tables.stored(rows.select("user", "hour", "day", "label", *hourly.COUNTS), "labelled-counts")  # read by each fit and by the scoring
    rows = VectorAssembler(inputCols=[f"log_{x}" for x in hourly.COUNTS], outputCol="raw").transform(rows.withColumns({f"log_{x}": F.log1p(F.col(x).cast("double")) for x in hourly.COUNTS}))
    train = rows.where("day <= 16")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = classifier.fit(scaler.transform(_balanced(train)))
    return model.transform(scaler.transform(rows)).withColumn("score", vector_to_array("probability")[1])


@query("supervised_logistic")
def _(spark, sf_dir):
    s = supervised(spark, sf_dir, LogisticRegression(labelCol="y", weightCol="weight", maxIter=50))
    return s.select("user", "hour", "day", "label", F.round("score", 6).alias("score"))


@query("supervised_boosted_trees")
def _(spark, sf_dir):
    s = supervised(spark, sf_dir, GBTClassifier(labelCol="y", weightCol="weight", maxIter=10, maxDepth=3, seed=7))
    return s.select("user", "hour", "day", "label", F.round("score", 6).alias("score"))
