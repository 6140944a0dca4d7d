"""Queries over graph windows, fusion, alert queues and incidents."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.operators import fusion, graph, incidents, metrics, splits
from kestrelog.sources import adapters

from .base import AUTH, SCORES, query
from .history import RED_PART
from .units import HOURLY, counts

WE = "((timestamp - 1) // 86400) * 86400 + 86401"
EDGES = AUTH + f""",
w AS (SELECT *, {WE} AS window_end FROM auth), fs AS (SELECT acting_user, destination_computer, min(timestamp) AS first_seen FROM auth GROUP BY ALL),
ed AS (SELECT window_end, acting_user, destination_computer, count(*) FILTER (authentication_result = 'Success') AS successes, count(*) FILTER (authentication_result <> 'Success') AS failures, count(*) AS events,
 string_agg(source_line, ' ' ORDER BY timestamp, source_line) AS lines, count(*) > 100 AS truncated, 1.0 * count(*) FILTER (authentication_result = 'Success') + 0.25 * count(*) FILTER (authentication_result <> 'Success') AS weight,
 any_value(first_seen) >= window_end - 86400 AS is_new FROM w JOIN fs USING (acting_user, destination_computer) GROUP BY window_end, acting_user, destination_computer)"""


def auth(spark, sf_dir):
    return adapters.auth_events(spark, sf_dir)


def windowed(spark, sf_dir):
    return graph.assign_windows(auth(spark, sf_dir))


def edge_rows(spark, sf_dir):
    return graph.edges(windowed(spark, sf_dir))


@query("graph_sliding_windows", f"WITH {AUTH}, x AS (SELECT timestamp, unnest(range(greatest(0, (timestamp - 1 - 86400 + 1 + 43199) // 43200), (timestamp - 1) // 43200 + 1)) AS i FROM auth) SELECT i * 43200 + 86401 AS window_end, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf_dir):
    return graph.assign_windows(auth(spark, sf_dir), 86_400, 43_200).groupBy("window_end").agg(F.count("*").alias("n"))


@query("graph_edges", f"WITH {EDGES} SELECT * REPLACE (CAST(weight AS DOUBLE) AS weight) FROM ed")
def _(spark, sf_dir):
    e = edge_rows(spark, sf_dir)
    return e.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), " "))


PRIOR = "pd AS (SELECT a.acting_user, a.window_end, (SELECT count(*) FROM fs WHERE fs.acting_user = a.acting_user AND fs.first_seen < a.window_end - 86400) AS prior_degree FROM (SELECT DISTINCT acting_user, window_end FROM w) a)"


@query("graph_degrees", f"WITH {EDGES}, {PRIOR} SELECT acting_user, window_end, count(*) AS degree, any_value(prior_degree) AS prior_degree, count(*) - any_value(prior_degree) AS growth FROM ed JOIN pd USING (acting_user, window_end) GROUP BY ALL")
def _(spark, sf_dir):
    return graph.degrees(edge_rows(spark, sf_dir), graph.prior_degrees(auth(spark, sf_dir)))


@query("graph_prior_degrees", f"WITH {EDGES}, a AS (SELECT DISTINCT acting_user, window_end FROM w) SELECT acting_user, window_end, (SELECT count(*) FROM fs WHERE fs.acting_user = a.acting_user AND fs.first_seen < a.window_end - 86400) AS prior_degree, (SELECT count(*) FROM fs WHERE fs.acting_user = a.acting_user AND fs.first_seen >= a.window_end - 86400 AND fs.first_seen < a.window_end) AS fresh FROM a")
def _(spark, sf_dir):
    return graph.prior_degrees(auth(spark, sf_dir))


BURSTS = f"""b1 AS (SELECT acting_user, window_end, timestamp, source_line, count(*) OVER (PARTITION BY acting_user, window_end ORDER BY timestamp RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS c60, count(*) OVER (PARTITION BY acting_user, window_end ORDER BY timestamp RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) AS c300,
 (SELECT count(DISTINCT b.destination_computer) FROM w b WHERE b.acting_user = w.acting_user AND b.window_end = w.window_end AND b.timestamp BETWEEN w.timestamp - 299 AND w.timestamp) AS d300 FROM w),
pk AS (SELECT acting_user, window_end, max(c60) AS peak_60s, max(c300) AS peak_300s, max(d300) AS peak_destinations_300s FROM b1 GROUP BY ALL)"""


@query("graph_bursts", f"WITH {EDGES}, {BURSTS} SELECT * FROM pk")
def _(spark, sf_dir):
    return graph.bursts(windowed(spark, sf_dir))


_LOGS = "round(ln(1 + count(*)), 5) AS log_degree, round(ln(1 + sum(weight)), 5) AS log_strength, round(ln(1 + sum(failures)), 5) AS log_failures"


@query("graph_node_features", f"WITH {EDGES}, {BURSTS}, {PRIOR} SELECT window_end, acting_user AS node, 1.0::DOUBLE AS is_user, 0.0::DOUBLE AS is_computer, {_LOGS}, round(ln(1 + greatest(count(*) - any_value(prior_degree), 0)), 5) AS log_growth, round(ln(1 + any_value(peak_60s)), 5) AS log_60s, round(ln(1 + any_value(peak_300s)), 5) AS log_300s, round(ln(1 + any_value(peak_destinations_300s)), 5) AS log_destinations_300s FROM ed JOIN pk USING (acting_user, window_end) JOIN pd USING (acting_user, window_end) GROUP BY window_end, acting_user UNION ALL SELECT window_end, destination_computer, 0.0, 1.0, {_LOGS}, 0.0, 0.0, 0.0, 0.0 FROM ed GROUP BY window_end, destination_computer")
def _(spark, sf_dir):
    n = graph.node_features(edge_rows(spark, sf_dir), graph.bursts(windowed(spark, sf_dir)), graph.prior_degrees(auth(spark, sf_dir)))
    return n.withColumns({c: F.round(c, 5) for c in n.columns if c.startswith("log_")})


ADJ = """bo AS (SELECT window_end, acting_user AS i, destination_computer AS j, weight FROM ed UNION ALL SELECT window_end, destination_computer, acting_user, weight FROM ed), fu AS (FROM bo UNION ALL SELECT DISTINCT window_end, i, i, 1.0 FROM bo),
de AS (SELECT window_end, i, sum(weight) AS d FROM fu GROUP BY ALL), ad AS (SELECT fu.window_end, fu.i, fu.j, CAST(weight AS DOUBLE) / sqrt(CAST(a.d AS DOUBLE) * CAST(b.d AS DOUBLE)) AS a FROM fu JOIN de a ON a.window_end = fu.window_end AND a.i = fu.i JOIN de b ON b.window_end = fu.window_end AND b.i = fu.j)"""


@query("graph_adjacency", f"WITH {EDGES}, {ADJ} SELECT window_end, i, j, round(a, 6) AS a FROM ad")
def _(spark, sf_dir):
    return graph.normalised_adjacency(edge_rows(spark, sf_dir)).withColumn("a", F.round("a", 6))


@query("graph_propagation", f"WITH {EDGES}, {ADJ}, f0 AS (SELECT window_end, i AS node, CAST(count(*) AS DOUBLE) AS x FROM bo GROUP BY ALL), f1 AS (SELECT ad.window_end, ad.i AS node, sum(a * x) AS x FROM ad JOIN f0 ON f0.window_end = ad.window_end AND f0.node = ad.j GROUP BY ALL) SELECT ad.window_end, ad.i AS node, round(sum(a * x), 5) AS x FROM ad JOIN f1 ON f1.window_end = ad.window_end AND f1.node = ad.j GROUP BY ALL")
def _(spark, sf_dir):
    e = edge_rows(spark, sf_dir)
    ends = e.select("window_end", F.col("acting_user").alias("node")).union(e.select("window_end", "destination_computer"))
    start = ends.groupBy("window_end", "node").agg(F.count("*").cast("double").alias("x"))
    return graph.propagate(graph.normalised_adjacency(e), start, ["x"]).withColumn("x", F.round("x", 5))


@query("graph_negative_sample", f"""WITH {EDGES}, dc AS (SELECT DISTINCT window_end, destination_computer FROM ed), nu AS (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY md5('7' || destination_computer), destination_computer) - 1 AS n, count(*) OVER (PARTITION BY window_end) AS size FROM dc),
sz AS (SELECT DISTINCT window_end, size FROM nu), pr AS (SELECT window_end, size, (SELECT min(c) FROM range(2, 4000) g(c) WHERE c >= size AND c % 3 = 2 AND NOT EXISTS (SELECT 1 FROM range(2, 64) h(d) WHERE d < c AND c % d = 0)) AS p FROM sz),
us AS (SELECT DISTINCT window_end, acting_user, md5('7/' || window_end || '/' || acting_user) AS m FROM ed), st AS (SELECT us.window_end, acting_user, p, CASE WHEN p > 2 THEN CAST('0x' || substr(m, 1, 8) AS BIGINT) % (p - 1) + 1 ELSE 1 END AS a, CASE WHEN p > 2 THEN CAST('0x' || substr(m, 9, 8) AS BIGINT) % (p - 1) + 1 ELSE 1 END AS b, CAST('0x' || substr(m, 17, 8) AS BIGINT) % p AS c, CAST('0x' || substr(m, 25, 8) AS BIGINT) % p AS d, unnest(range(0, p)) AS step FROM us JOIN pr ON pr.window_end = us.window_end),
wk AS (SELECT st.window_end, acting_user, nu.destination_computer, step FROM st JOIN nu ON nu.window_end = st.window_end AND nu.n = (b * (((a * step + c) % p) * ((a * step + c) % p) % p * ((a * step + c) % p) % p) + d) % p),
no AS (SELECT wk.* FROM wk ANTI JOIN ed ON ed.window_end = wk.window_end AND ed.acting_user = wk.acting_user AND ed.destination_computer = wk.destination_computer)
SELECT window_end, acting_user, destination_computer FROM (SELECT *, row_number() OVER (PARTITION BY window_end, acting_user ORDER BY step) AS r FROM no) WHERE r <= 2""")
def _(spark, sf_dir):
    return graph.negative_sample(edge_rows(spark, sf_dir), 2)


@query("graph_edge_anomaly")
def _(spark, sf_dir):
    e = edge_rows(spark, sf_dir).drop("lines")
    scored = graph.edge_anomaly(e.where(f"window_end <= {7 * 86_400 + 1}"), e)
    return graph.day_rows(graph.user_scores(scored)).withColumns({c: F.round(c, 5) for c in ("max_score", "top_mean")})


ESC = EDGES + ", es AS (SELECT *, round(1 - 1 / (1 + weight + CASE WHEN is_new THEN 2 ELSE 0 END), 6) AS score FROM ed), er AS (SELECT *, row_number() OVER (PARTITION BY acting_user, window_end ORDER BY score DESC, destination_computer) AS rank FROM es)"


def weighted_edges(spark, sf_dir, log=None):
    e = edge_rows(spark, sf_dir) if log is None else graph.edges(graph.assign_windows(log))
    return e.withColumn("score", F.round(1 - 1 / (1 + F.col("weight") + F.when(F.col("is_new"), 2).otherwise(0)), 6))


@query("graph_user_scores", f"WITH {ESC} SELECT acting_user, window_end, CAST(max(score) AS DOUBLE) AS max_score, round(avg(score), 5) AS top_mean, string_agg(destination_computer, ' ' ORDER BY rank) AS top_edges, CAST((window_end - 2) // 86400 + 1 AS INTEGER) AS day, CASE WHEN window_end - 86400 <= 1 THEN 'warmup' ELSE 'available' END AS status FROM er WHERE rank <= 3 GROUP BY acting_user, window_end")
def _(spark, sf_dir):
    return graph.day_rows(graph.user_scores(weighted_edges(spark, sf_dir))).withColumn("top_mean", F.round("top_mean", 5))


@query("graph_label_cutoffs", f"WITH {AUTH}{RED_PART} SELECT source_line, ((timestamp - 1) // 86400 + 1) * 86400 + 1 AS cutoff FROM red")
def _(spark, sf_dir):
    return adapters.red_team(spark, sf_dir).select("source_line", graph.label_cutoff(F.col("timestamp")).alias("cutoff"))


@query("graph_window_evaluation", f"""WITH {ESC}{RED_PART}, us AS (SELECT acting_user AS user, window_end, max(score) AS score FROM er GROUP BY ALL HAVING window_end - 86400 > 1), y AS (SELECT DISTINCT user, ((timestamp - 1) // 86400 + 1) * 86400 + 1 AS window_end FROM red),
l AS (SELECT us.*, y.user IS NOT NULL AS label FROM us LEFT JOIN y USING (user, window_end)), g AS (SELECT score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM l GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS P FROM g) SELECT round(sum(pos * tp / (tp + fp)) / max(P), 6) AS ap FROM c""")
def _(spark, sf_dir):
    scores = graph.day_rows(graph.user_scores(weighted_edges(spark, sf_dir))).where("status = 'available'").select(F.col("acting_user").alias("user"), "window_end", F.col("max_score").alias("score"))
    labels = adapters.red_team(spark, sf_dir).select("user", graph.label_cutoff(F.col("timestamp")).alias("window_end"))
    return metrics.average_precision(metrics.label_units(scores, labels, ["user", "window_end"])).select(F.round("ap", 6).alias("ap"))


FROZEN = f"{AUTH}{RED_PART}, fz AS (SELECT DISTINCT user, source_computer, destination_computer FROM red WHERE timestamp < 1382401), tm AS (SELECT a.* FROM auth a JOIN fz ON fz.user = a.acting_user AND fz.source_computer = a.source_computer AND fz.destination_computer = a.destination_computer WHERE timestamp >= 1382401)"


def matches(spark, sf_dir):
    return graph.triple_matches(auth(spark, sf_dir), graph.frozen_triples(adapters.red_team(spark, sf_dir), 1_382_401), 1_382_401)


@query("graph_confirmed_relationships", f"WITH {FROZEN} SELECT source_line, acting_user, source_computer, destination_computer FROM tm")
def _(spark, sf_dir):
    return matches(spark, sf_dir).select("source_line", "acting_user", "source_computer", "destination_computer")


@query("graph_universe_metrics", f"""WITH {FROZEN}, un AS (SELECT DISTINCT acting_user AS user, dataset_day AS day FROM auth WHERE timestamp >= 1382401), h AS (SELECT DISTINCT acting_user AS user, dataset_day AS day, true AS hit FROM tm), y AS (SELECT DISTINCT user, (timestamp - 1) // 86400 + 1 AS day, true AS y FROM red WHERE timestamp >= 1382401),
c AS (SELECT count(*) FILTER (coalesce(hit, false) AND coalesce(y, false)) AS tp, count(*) FILTER (coalesce(hit, false) AND NOT coalesce(y, false)) AS fp, count(*) FILTER (NOT coalesce(hit, false) AND coalesce(y, false)) AS fn, count(*) FILTER (NOT coalesce(hit, false) AND NOT coalesce(y, false)) AS tn FROM un LEFT JOIN h USING (user, day) LEFT JOIN y USING (user, day))
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def _(spark, sf_dir):
    units = lambda df: df.select(F.col("acting_user").alias("user"), F.col("dataset_day").alias("day"))
    labels = adapters.red_team(spark, sf_dir).where("timestamp >= 1382401").select("user", splits.day_of(F.col("timestamp")).alias("day"))
    m = graph.universe_metrics(units(auth(spark, sf_dir).where("timestamp >= 1382401")), units(matches(spark, sf_dir)), labels, ["user", "day"])
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


HYBRID = f"{FROZEN}, gd AS (SELECT acting_user, day, max(graph_score) AS score FROM (SELECT user AS acting_user, day, graph_score FROM hs) GROUP BY ALL), kn AS (SELECT acting_user, dataset_day AS day, count(*) AS matches, string_agg(source_line, ' ' ORDER BY timestamp, source_line) AS lines FROM tm GROUP BY ALL)".replace(AUTH, SCORES)


@query("graph_hybrid_rows", f"WITH {HYBRID} SELECT acting_user, day, score, coalesce(matches, 0) AS matches, lines, score >= 0.7 AS graph_alert, CASE WHEN matches > 0 AND score >= 0.7 THEN 'confirmed_and_anomalous' WHEN matches > 0 THEN 'confirmed_relationship' WHEN score >= 0.7 THEN 'graph_anomaly' ELSE 'none' END AS reason, coalesce(matches, 0) > 0 OR score >= 0.7 AS is_alert FROM gd LEFT JOIN kn USING (acting_user, day)")
def _(spark, sf_dir):
    days = adapters.hour_scores(spark, sf_dir).groupBy(F.col("user").alias("acting_user"), "day").agg(F.max("graph_score").alias("score"))
    return graph.hybrid_rows(days, matches(spark, sf_dir), 0.7)


@query("graph_channel_metrics", f"WITH {HYBRID}, un AS (SELECT acting_user AS user, day, coalesce(matches, 0) > 0 AS k, score >= 0.7 AS g FROM gd LEFT JOIN kn USING (acting_user, day) WHERE day >= 17), y AS (SELECT DISTINCT user, (timestamp - 1) // 86400 + 1 AS day FROM red), ch AS (SELECT 'confirmed' AS channel, user, day, k AS hit FROM un UNION ALL SELECT 'graph', user, day, g FROM un UNION ALL SELECT 'either', user, day, k OR g FROM un) SELECT channel, count(*) FILTER (hit AND y.user IS NOT NULL) AS tp, count(*) FILTER (hit AND y.user IS NULL) AS fp, count(*) FILTER (NOT hit AND y.user IS NOT NULL) AS fn FROM ch LEFT JOIN y ON y.user = ch.user AND y.day = ch.day GROUP BY channel")
def _(spark, sf_dir):
    days = adapters.hour_scores(spark, sf_dir).groupBy(F.col("user").alias("acting_user"), "day").agg(F.max("graph_score").alias("score"))
    rows = graph.hybrid_rows(days, matches(spark, sf_dir), 0.7).where("day >= 17")
    channels = rows.select(F.col("acting_user").alias("user"), "day", (F.col("matches") > 0).cast("double").alias("confirmed"), F.col("graph_alert").cast("double").alias("graph"), F.col("is_alert").cast("double").alias("either")).unpivot(["user", "day"], ["confirmed", "graph", "either"], "channel", "score")
    labels = adapters.red_team(spark, sf_dir).select("user", splits.day_of(F.col("timestamp")).alias("day"))
    return metrics.confusion(metrics.label_units(channels, labels, ["user", "day"]), F.lit(0.5), ["channel"]).select("channel", "tp", "fp", "fn")


@query("graph_collapse_report", f"""WITH {SCORES}{RED_PART}, y AS (SELECT DISTINCT user, 1 + ((timestamp - 1) // 3600) * 3600 AS hour FROM red), l AS (SELECT hs.*, y.user IS NOT NULL AS label FROM hs LEFT JOIN y USING (user, hour)),
c AS (SELECT day <= 16 AS early, count(*) FILTER (graph_score >= 0.6 AND label) AS tp, count(*) FILTER (graph_score >= 0.6 AND NOT label) AS fp, count(*) FILTER (graph_score < 0.6 AND label) AS fn FROM l GROUP BY 1), f AS (SELECT *, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c),
d AS (SELECT a.f1 AS f1_before, b.f1 AS f1_after, greatest(0.0, a.f1 - b.f1) AS absolute_loss, CASE WHEN a.f1 = 0 THEN 0.0 ELSE greatest(0.0, a.f1 - b.f1) / a.f1 END AS relative_loss, b.tp + b.fn AS holdout_positives FROM f a, f b WHERE a.early AND NOT b.early)
SELECT round(f1_before, 6) AS f1_before, round(f1_after, 6) AS f1_after, round(absolute_loss, 6) AS absolute_loss, round(relative_loss, 6) AS relative_loss, holdout_positives, absolute_loss > 0.1 AND relative_loss > 0.5 AS dropped, (absolute_loss > 0.1 AND relative_loss > 0.5) OR holdout_positives < 30 AS collapsed FROM d""")
def _(spark, sf_dir):
    rows = metrics.label_units(adapters.hour_scores(spark, sf_dir).withColumn("score", F.col("graph_score")), splits.label_hours(adapters.red_team(spark, sf_dir)), ["user", "hour"])
    report = graph.collapse_report(metrics.confusion(rows.where("day <= 16"), F.lit(0.6)), metrics.confusion(rows.where("day > 16"), F.lit(0.6)))
    return report.withColumns({c: F.round(c, 6) for c in ("f1_before", "f1_after", "absolute_loss", "relative_loss")})


# ---- alignment and fusion ----

ALIGN = SCORES + """,
sq AS (SELECT user, hour, CASE WHEN tie % 11 = 0 THEN NULL ELSE seq_score END AS s0, CASE WHEN hour < 86401 OR tie % 23 = 0 THEN 'warmup' ELSE 'available' END AS seq_status, CASE WHEN tie % 17 = 0 THEN true WHEN tie % 19 = 0 THEN false END AS seq_alert FROM hs),
gr AS (SELECT user, CAST(day * 86400 + 1 AS BIGINT) AS available_at, max(graph_score) AS graph_score, CASE WHEN day = 1 OR min(tie) % 7 = 0 THEN 'warmup' ELSE 'available' END AS graph_status, min(tie) AS tie FROM hs WHERE day % 4 <> 3 GROUP BY user, day),
b AS (SELECT *, hour + 3600 AS window_end FROM sq),
al0 AS (SELECT b.*, g.available_at, g.graph_score AS g0, g.graph_status, coalesce(b.window_end - g.available_at > 86400, false) AS stale FROM b ASOF LEFT JOIN gr g ON b.user = g.user AND b.window_end >= g.available_at),
al1 AS (SELECT * EXCLUDE (g0, s0), CASE WHEN seq_status = 'available' THEN s0 END AS seq_score, CASE WHEN NOT stale AND graph_status = 'available' THEN g0 END AS graph_score FROM al0),
al AS (SELECT *, CASE WHEN seq_status = 'available' THEN coalesce(seq_alert, seq_score >= 0.4) END AS is_seq_alert, graph_score >= 0.7 AS is_graph_alert, CASE WHEN coalesce(window_end <= 86401 OR seq_status = 'warmup' OR (graph_status = 'warmup' AND NOT stale), false) THEN 'insufficient_history' WHEN seq_score IS NOT NULL AND graph_score IS NOT NULL THEN 'both' WHEN seq_score IS NOT NULL AND stale THEN 'stale_graph' WHEN seq_score IS NOT NULL THEN 'sequence_only' WHEN graph_score IS NOT NULL THEN 'graph_only' ELSE 'no_activity' END AS alignment_status FROM al1)"""
FUSE = ALIGN + """,
fw AS (SELECT *, CASE WHEN seq_score IS NOT NULL AND graph_score IS NOT NULL THEN 0.5 WHEN seq_score IS NOT NULL THEN 1.0 WHEN graph_score IS NOT NULL THEN 0.0 END AS weight_seq FROM al),
fu AS (SELECT *, CASE WHEN seq_score IS NULL AND graph_score IS NULL THEN NULL ELSE coalesce(seq_score, 0) * weight_seq + coalesce(graph_score, 0) * (1 - weight_seq) END AS base,
 CASE WHEN is_seq_alert IS NULL AND is_graph_alert IS NULL THEN 'unavailable' WHEN is_seq_alert AND is_graph_alert THEN 'concordant_alert' WHEN is_seq_alert THEN 'sequence_only_alert' WHEN is_graph_alert THEN 'graph_only_alert' ELSE 'concordant_normal' END AS disagreement FROM fw)"""


def aligned(spark, sf_dir):
    hs = adapters.hour_scores(spark, sf_dir)
    seq = hs.select("user", "hour", F.when(F.col("tie") % 11 != 0, F.col("seq_score")).alias("seq_score"), F.when((F.col("hour") < 86_401) | (F.col("tie") % 23 == 0), "warmup").otherwise("available").alias("seq_status"), F.when(F.col("tie") % 17 == 0, True).when(F.col("tie") % 19 == 0, False).alias("seq_alert"))
    gra = hs.where("day % 4 <> 3").groupBy("user", "day").agg(F.max("graph_score").alias("graph_score"), F.min("tie").alias("tie"))
    gra = gra.select("user", (F.col("day").cast("long") * 86_400 + 1).alias("available_at"), "graph_score", F.when((F.col("day") == 1) | (F.col("tie") % 7 == 0), "warmup").otherwise("available").alias("graph_status"), "tie")
    return fusion.align(seq, gra, seq_threshold=0.4, graph_threshold=0.7)


def fused(spark, sf_dir):
    return fusion.fuse(aligned(spark, sf_dir), "average")


@query("fusion_align", f"WITH {ALIGN} SELECT user, hour, window_end, available_at, seq_score, graph_score, stale, is_seq_alert, is_graph_alert, alignment_status FROM al")
def _(spark, sf_dir):
    return fusion.check_no_leak(aligned(spark, sf_dir)).select("user", "hour", "window_end", "available_at", "seq_score", "graph_score", "stale", "is_seq_alert", "is_graph_alert", "alignment_status")


@query("fusion_status_counts", f"WITH {ALIGN} SELECT alignment_status, count(*) AS n FROM al GROUP BY ALL")
def _(spark, sf_dir):
    return aligned(spark, sf_dir).groupBy("alignment_status").agg(F.count("*").alias("n"))


@query("fusion_universe", f"WITH {SCORES} SELECT user, hour FROM hs UNION SELECT user, CAST((day - 1) * 86400 + 1 AS BIGINT) FROM hs")
def _(spark, sf_dir):
    hs = adapters.hour_scores(spark, sf_dir)
    return fusion.universe(hs, hs.select("user", ((F.col("day").cast("long") - 1) * 86_400 + 1).alias("hour")))


for _rule, _expr in (("max", "CASE WHEN seq_score IS NULL AND graph_score IS NULL THEN NULL ELSE greatest(coalesce(seq_score, 0), coalesce(graph_score, 0)) END"),
                     ("average", "base"),
                     ("weighted", "CASE WHEN seq_score IS NOT NULL AND graph_score IS NOT NULL THEN 0.3 * seq_score + 0.7 * graph_score ELSE coalesce(seq_score, graph_score) END")):

    @query(f"fusion_{_rule}", f"WITH {FUSE} SELECT user, hour, round({_expr}, 6) AS base, disagreement FROM fu")
    def _(spark, sf_dir, rule=_rule):
        return fusion.fuse(aligned(spark, sf_dir), rule, 0.3).select("user", "hour", F.round("base", 6).alias("base"), "disagreement")




def temporal_sql(weight: float, tau: int, source: str = "fu", cap: float = 0.9999) -> str:
    """The fused scores of a temporal setting over the gaps of tp0."""
    return f"SELECT *, CASE WHEN base IS NOT NULL THEN least(base + coalesce({weight} * exp(-gap / {tau}), 0.0), {cap}) END AS fused FROM {source}"


TEMPORAL = FUSE + """,
sa AS (SELECT user, hour FROM fu WHERE is_seq_alert), ga AS (SELECT user, hour FROM fu WHERE is_graph_alert),
tp0 AS (SELECT f.*, (SELECT min(abs(sa.hour - ga.hour)) FROM sa, ga WHERE sa.user = f.user AND ga.user = f.user AND sa.hour BETWEEN f.hour - 86400 AND f.hour AND ga.hour BETWEEN f.hour - 86400 AND f.hour) AS gap,
 (SELECT min(hour) FROM sa WHERE sa.user = f.user AND sa.hour BETWEEN f.hour - 86400 AND f.hour) AS fs, (SELECT min(hour) FROM ga WHERE ga.user = f.user AND ga.hour BETWEEN f.hour - 86400 AND f.hour) AS fg FROM fu f),
tp AS (SELECT *, coalesce(0.15 * exp(-gap / 21600), 0.0) AS boost, CASE WHEN fs IS NULL OR fg IS NULL THEN NULL WHEN fs < fg THEN 'sequence' WHEN fg < fs THEN 'graph' ELSE 'simultaneous' END AS lead, abs(fs - fg) AS lead_seconds FROM tp0),
tf AS (SELECT *, CASE WHEN base IS NOT NULL THEN least(base + boost, 0.9999) END AS fused FROM tp)"""


@query("fusion_temporal", f"WITH {TEMPORAL} SELECT user, hour, round(boost, 6) AS boost, lead, lead_seconds, round(fused, 6) AS fused, fused >= 0.7 AS is_alert FROM tf")
def _(spark, sf_dir):
    t = fusion.temporal(fused(spark, sf_dir), alert=0.7)
    return t.select("user", "hour", F.round("boost", 6).alias("boost"), "lead", "lead_seconds", F.round("fused", 6).alias("fused"), "is_alert")


@query("fusion_day_temporal", f"WITH {SCORES}, d AS (SELECT user, day, max(seq_score) AS seq_score, min(hour) FILTER (seq_score >= 0.4) AS seq_first_alert, max(graph_score) AS graph_score FROM hs GROUP BY ALL) SELECT d.user, d.day, d.seq_score, p.graph_score AS graph_before, CASE WHEN d.seq_first_alert IS NOT NULL AND p.graph_score >= 0.5 THEN d.seq_first_alert - ((d.day - 1) * 86400 + 1) END AS lead_seconds FROM d LEFT JOIN d p ON p.user = d.user AND p.day = d.day - 1")
def _(spark, sf_dir):
    days = adapters.hour_scores(spark, sf_dir).groupBy("user", "day").agg(F.max("seq_score").alias("seq_score"), F.min(F.when(F.col("seq_score") >= 0.4, F.col("hour"))).alias("seq_first_alert"), F.max("graph_score").alias("graph_score"))
    return fusion.day_temporal(days).select("user", "day", "seq_score", "graph_before", "lead_seconds")


#: Name, rule, weight of the sequence, and for temporal ones the boost and its decay in seconds.
SETTINGS = [
    ("maximum", "max", 0.5, None), ("average", "average", 0.5, None), ("weighted 0.3", "weighted", 0.3, None), ("weighted 0.5", "weighted", 0.5, None), ("weighted 0.7", "weighted", 0.7, None),
    ("temporal 6 h", "weighted", 0.5, (0.15, 21_600)), ("temporal 12 h", "weighted", 0.5, (0.15, 43_200)), ("temporal 24 h", "weighted", 0.5, (0.20, 86_400)),
]


def _setting_sql(name, rule, weight, boost):
    base = f"CASE WHEN seq_score IS NULL OR graph_score IS NULL THEN coalesce(seq_score, graph_score) ELSE {'greatest(seq_score, graph_score)' if rule == 'max' else f'{weight} * seq_score + (1 - {weight}) * graph_score'} END"
    if boost is None:
        return f"SELECT '{name}' AS setting, user, hour, {base} AS score FROM tp0"
    return f"SELECT '{name}', user, hour, fused FROM ({temporal_sql(*boost, source=f'(SELECT * REPLACE ({base} AS base) FROM tp0)')})"


@query("fusion_grid", f"""WITH {TEMPORAL}{RED_PART}, y AS (SELECT DISTINCT user, 1 + ((timestamp - 1) // 3600) * 3600 AS hour FROM red), x AS ({" UNION ALL ".join(_setting_sql(*s) for s in SETTINGS)}),
g AS (SELECT setting, round(score, 6) AS score, count(*) FILTER (y.user IS NOT NULL) AS pos, count(*) FILTER (y.user IS NULL) AS neg FROM x LEFT JOIN y ON y.user = x.user AND y.hour = x.hour WHERE score IS NOT NULL GROUP BY ALL), c AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY setting) AS P FROM g WINDOW o AS (PARTITION BY setting ORDER BY score DESC)),
f AS (SELECT *, 2 * tp / (tp + fp + P) AS f1 FROM c), m AS (SELECT setting, round(sum(pos * tp / (tp + fp)) / max(P), 6) AS ap, round(max(f1), 6) AS f1, arg_max(struct_pack(score, tp, fp, P), (f1, score)) AS b FROM f GROUP BY setting)
SELECT setting, CAST(row_number() OVER (ORDER BY ap DESC, f1 DESC, setting) AS INTEGER) AS rank, ap, f1, b.score AS threshold, CAST(b.tp AS BIGINT) AS tp, CAST(b.fp AS BIGINT) AS fp, round(b.tp / (b.tp + b.fp), 6) AS precision, round(b.tp / b.P, 6) AS recall FROM m""")
def _(spark, sf_dir):
    """Eight fusion settings, three of them temporal, ranked by average precision and F1, with the best threshold of each."""
    rows = fusion.grid(tables.stored(aligned(spark, sf_dir), "aligned"), SETTINGS).withColumn("score", F.round("score", 6)).where("score is not null")
    rows = tables.stored(metrics.label_units(rows, splits.label_hours(adapters.red_team(spark, sf_dir)), ["user", "hour"]), "settings")
    out = tables.stored(metrics.ranking(rows, ["setting"]), "setting-ranking")
    at = metrics.confusion(rows.join(F.broadcast(out.select("setting", "threshold")), "setting"), F.col("threshold"), ["setting"])  # a row for each setting
    out = out.withColumns({"ap": F.round("ap", 6), "f1": F.round("f1", 6)}).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ap"), F.desc("f1"), "setting")))  # a row for each setting
    return out.drop("auc").join(at.select("setting", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")), "setting")


@query("fusion_supervised")
def _(spark, sf_dir):
    rows = fusion.fusion_features(fusion.temporal(fused(spark, sf_dir)))
    rows = metrics.label_units(rows, splits.label_hours(adapters.red_team(spark, sf_dir)), ["user", "hour"])
    rows = VectorAssembler(inputCols=["x_seq", "x_graph", "x_boost", "x_lead"], outputCol="features").transform(rows).withColumns({"y": F.col("label").cast("double"), "w": F.when(F.col("label"), 50.0).otherwise(1.0)})
    scored = LogisticRegression(labelCol="y", weightCol="w", maxIter=30).fit(rows.where("hour < 1382401")).transform(rows).withColumn("score", vector_to_array("probability")[1])
    knots = metrics.fit_calibrator(scored.where("hour < 1382401"))
    return metrics.calibrate(scored, knots).select("user", "hour", F.round("score", 5).alias("score"), F.round("calibrated", 5).alias("calibrated"))


# ---- queues and incidents ----

QUEUE = HOURLY + """,
q0 AS (SELECT acting_user AS user, hour, day, CAST(either AS DOUBLE) + failures AS score, tie FROM hc), q1 AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, tie) AS rank, cume_dist() OVER (PARTITION BY day ORDER BY score) AS percentile FROM q0),
qu AS (SELECT *, min(score) OVER (PARTITION BY day) AS cutoff FROM q1 WHERE rank <= 38), q AS (SELECT *, score = cutoff AS tied, format('ALR-D{:02d}-{:02d}', day, rank) AS alert_id FROM qu),
ig AS (SELECT *, sum(CASE WHEN pe IS NULL OR hour - pe > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user ORDER BY hour) AS incident_seq FROM (SELECT *, lag(hour) OVER (PARTITION BY user ORDER BY hour) + 3600 AS pe FROM q))"""
_CLEAN = "replace(replace(user, '@', '_'), '$', '')"


def queue(spark, sf_dir):
    return queue_of(counts(spark, sf_dir))


def queue_of(hours, *more: str):
    return incidents.daily_queue(scores_of(hours, *more))


def hour_scores(spark, sf_dir, *more: str):
    return scores_of(counts(spark, sf_dir), *more)


def scores_of(hours, *more: str):
    return hours.select(F.col("acting_user").alias("user"), "hour", "day", (F.col("either").cast("double") + F.col("failures")).alias("score"), "tie", *more)


@query("alerts_percentiles", f"WITH {QUEUE}, pc AS (SELECT user, hour, cume_dist() OVER (PARTITION BY day ORDER BY events) AS events_percentile FROM (SELECT acting_user AS user, hour, day, events FROM hc)) SELECT q.user, q.hour, q.day, CAST(rank AS INTEGER) AS rank, round(percentile, 6) AS percentile, round(events_percentile, 6) AS events_percentile FROM q JOIN pc ON pc.user = q.user AND pc.hour = q.hour")
def _(spark, sf_dir):
    """Percentiles of the ranking score and of another score of the same hours within the day."""
    found = incidents.daily_queue(hour_scores(spark, sf_dir, "events"), percentiles={"score": "percentile", "events": "events_percentile"})
    return found.select("user", "hour", "day", "rank", *[F.round(c, 6).alias(c) for c in ("percentile", "events_percentile")])


@query("alerts_event_counts", f"WITH {QUEUE}, n AS (SELECT alert_id, count(*) AS found FROM q JOIN auth a ON a.acting_user = q.user AND a.hour = q.hour GROUP BY 1), sc2 AS (SELECT alert_id, hc.events + CASE WHEN q.hour % 7 = 0 THEN 1 ELSE 0 END AS scored FROM q JOIN hc ON hc.acting_user = q.user AND hc.hour = q.hour) SELECT alert_id, scored, found, scored = found AS agrees FROM sc2 JOIN n USING (alert_id)")
def _(spark, sf_dir):
    """Events behind alerts against the counts they were scored with; some counts are planted one too high."""
    scored = hour_scores(spark, sf_dir, "events").withColumn("events", F.col("events") + F.when(F.col("hour") % 7 == 0, 1).otherwise(0))
    return incidents.alert_count_check(incidents.daily_queue(scored), auth(spark, sf_dir), "events")


@query("alerts_daily_queue", f"WITH {QUEUE} SELECT user, hour, day, score, CAST(rank AS INTEGER) AS rank, round(percentile, 6) AS percentile, cutoff, tied, alert_id FROM q")
def _(spark, sf_dir):
    return queue(spark, sf_dir).withColumn("percentile", F.round("percentile", 6)).drop("tie")


@query("alerts_events", f"WITH {QUEUE} SELECT alert_id, source_line, acting_user, hour FROM auth JOIN q ON q.user = auth.acting_user AND q.hour = auth.hour AND q.day = auth.dataset_day".replace("source_line, acting_user, hour FROM auth JOIN", "source_line, acting_user, auth.hour FROM auth JOIN"))
def _(spark, sf_dir):
    return incidents.alert_events(queue(spark, sf_dir), auth(spark, sf_dir)).select("alert_id", "source_line", "acting_user", "hour")


RECORDS = QUEUE + f""",
al AS (SELECT alert_id, a.timestamp, a.source_line FROM auth a JOIN q ON q.user = a.acting_user AND q.hour = a.hour), rf AS (SELECT user, incident_seq, string_agg('auth.txt:' || source_line, ' ' ORDER BY timestamp, source_line) AS refs, count(*) AS n_references FROM ig JOIN al USING (alert_id) GROUP BY ALL),
rc AS (SELECT user, incident_seq, min(day) AS day, min(hour) AS start, max(hour) + 3600 AS end_, string_agg(alert_id, ' ' ORDER BY hour, alert_id) AS alerts, CASE WHEN bool_or(NOT tied) THEN 'HIGH' ELSE 'MEDIUM' END AS priority, count(*) AS alert_hours FROM ig GROUP BY ALL)"""


def records(spark, sf_dir):
    return incidents.records(queue(spark, sf_dir), auth(spark, sf_dir), "validation")


@query("incidents_records", f"WITH {RECORDS} SELECT user, CAST(incident_seq AS BIGINT) AS incident_seq, day, start, end_ AS \"end\", alerts, priority, format('INC-VALIDATION-D{{:02d}}-{{}}-{{:03d}}', day, {_CLEAN}, CAST(incident_seq AS BIGINT)) AS incident_id, n_references, refs AS \"references\" FROM rc JOIN rf USING (user, incident_seq)")
def _(spark, sf_dir):
    return records(spark, sf_dir)


INC = TEMPORAL + f""",
ia AS (SELECT user, hour, CAST((hour - 1) // 86400 + 1 AS INTEGER) AS day, fused AS score, disagreement, boost, seq_score, graph_score FROM tf WHERE fused >= 0.55), ib AS (SELECT *, sum(CASE WHEN pe IS NULL OR hour - pe > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user ORDER BY hour) AS incident_seq FROM (SELECT *, lag(hour) OVER (PARTITION BY user ORDER BY hour) + 3600 AS pe FROM ia)),
ic AS (SELECT user, CAST(incident_seq AS BIGINT) AS incident_seq, min(hour) AS start, max(hour) + 3600 AS "end", min(day) AS day, count(*) AS alert_hours, max(score) AS max_score, avg(score) AS mean_score, max(seq_score) AS max_seq, max(graph_score) AS max_graph, bool_or(disagreement = 'concordant_alert') AS c, bool_or(disagreement = 'sequence_only_alert') AS s, bool_or(disagreement = 'graph_only_alert') AS g, bool_or(boost > 0) AS boosted FROM ib GROUP BY user, incident_seq),
inc AS (SELECT *, format('INC-TEST-D{{:02d}}-{{}}-{{:03d}}', day, {_CLEAN}, incident_seq) AS incident_id, greatest(1, ("end" - start + 3599) // 3600) AS duration_hours, CASE WHEN c THEN 'concordant' WHEN s AND g THEN 'phased' WHEN s THEN 'sequence' WHEN g THEN 'graph' ELSE 'normal' END AS concordance, CASE WHEN c OR max_score >= 0.9995 THEN 'CRITICAL' WHEN boosted OR max_score >= 0.999 THEN 'HIGH' WHEN max_score >= 0.99 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM ic)"""


def built(spark, sf_dir):
    t = fusion.temporal(fused(spark, sf_dir))
    alerts = t.where("fused >= 0.55").select("user", "hour", splits.day_of(F.col("hour")).alias("day"), F.col("fused").alias("score"), "disagreement", "boost", "seq_score", "graph_score")
    return incidents.build(alerts, "test")


@query("incidents_clusters", f"WITH {INC} SELECT incident_id, user, start, \"end\", day, alert_hours, duration_hours, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score, max_seq, max_graph, concordance, priority FROM inc")
def _(spark, sf_dir):
    return built(spark, sf_dir).select("incident_id", "user", "start", "end", "day", "alert_hours", "duration_hours", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"), "max_seq", "max_graph", "concordance", "priority")


@query("incidents_signatures", f"WITH {INC}, ev2 AS (SELECT DISTINCT incident_id, inc.user, a.source_computer, a.destination_computer FROM inc JOIN auth a ON a.acting_user = inc.user AND a.timestamp >= inc.start AND a.timestamp < inc.\"end\"), si AS (SELECT incident_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS signatures FROM (SELECT incident_id, 'user' AS kind FROM ev2 WHERE user = 'U3@DOM1' UNION ALL SELECT incident_id, 'node' FROM ev2 WHERE destination_computer = 'C104' UNION ALL SELECT incident_id, 'pair' FROM ev2 WHERE user = 'U5@DOM1' AND destination_computer = 'C110' UNION ALL SELECT incident_id, 'triple' FROM ev2 WHERE user = 'U8@DOM1' AND source_computer = 'C9' AND destination_computer = 'C101' UNION ALL SELECT incident_id, 'rule' FROM inc WHERE duration_hours >= 6) GROUP BY 1) SELECT incident_id, signatures, CASE WHEN signatures IS NOT NULL THEN 'CRITICAL' ELSE priority END AS priority FROM inc LEFT JOIN si USING (incident_id)")
def _(spark, sf_dir):
    inc = built(spark, sf_dir)
    inc = tables.stored(inc, "incidents")
    events = incidents.incident_events(inc, auth(spark, sf_dir)).select("incident_id", "source_computer", "destination_computer")
    rows = [("user", "U3@DOM1", None, None), ("node", None, None, "C104"), ("pair", "U5@DOM1", None, "C110"), ("triple", "U8@DOM1", "C9", "C101")]
    signatures = spark.createDataFrame(rows, "kind string, user string, source string, computer string")
    return incidents.apply_signatures(inc, events, signatures, F.col("duration_hours") >= 6).select("incident_id", "signatures", "priority")


@query("incidents_triage", f"WITH {INC}{RED_PART}, lh AS (SELECT DISTINCT user, 1 + ((timestamp - 1) // 3600) * 3600 AS lh FROM red), p AS (SELECT incident_id, any_value(alert_hours) AS ah, count(DISTINCT lh) FILTER (lh < \"end\" AND lh + 3600 > start) AS met FROM inc LEFT JOIN lh USING (user) GROUP BY 1) SELECT count(*) AS incidents, count(*) FILTER (met > 0) AS true_incidents, CAST(sum(ah) AS BIGINT) AS alerts, CAST(sum(met) AS BIGINT) AS label_hours_met, round(1 - count(*) / sum(ah), 6) AS compression FROM p")
def _(spark, sf_dir):
    t = incidents.triage(built(spark, sf_dir), splits.label_hours(adapters.red_team(spark, sf_dir)))
    return t.withColumn("compression", F.round("compression", 6))


@query("incidents_queue_view", f"WITH {INC} SELECT incident_id, priority, start FROM inc WHERE priority IN ('CRITICAL', 'HIGH') AND \"end\" > 864001 AND start < 1382401")
def _(spark, sf_dir):
    return incidents.queue_view(built(spark, sf_dir), None, ["CRITICAL", "HIGH"], 864_001, 1_382_401).select("incident_id", "priority", "start")


@query("incidents_unresolved_references", f"WITH {RECORDS}, x AS (SELECT format('INC-VALIDATION-D{{:02d}}-{{}}-{{:03d}}', day, {_CLEAN}, CAST(incident_seq AS BIGINT)) AS incident_id, CAST(regexp_extract(r, '[0-9]+$') AS BIGINT) AS source_line FROM (SELECT *, unnest(string_split(refs, ' ')) AS r FROM rc JOIN rf USING (user, incident_seq))) SELECT incident_id, source_line FROM x WHERE source_line % 10 = 3")
def _(spark, sf_dir):
    """References of the day's records into a log that lacks every tenth line."""
    return incidents.unresolved(records(spark, sf_dir), auth(spark, sf_dir).where("source_line % 10 <> 3"))


@query("incidents_package_counts", f"WITH {RECORDS} SELECT (SELECT count(*) FROM q) AS alerts, (SELECT count(DISTINCT user) FROM q) AS users, (SELECT count(DISTINCT day) FROM q) AS days, (SELECT count(*) FROM al) AS events, (SELECT count(*) FROM rc) AS incidents, (SELECT count(*) FROM rc) AS distinct_ids")
def _(spark, sf_dir):
    qu = queue(spark, sf_dir)
    return incidents.package_counts(qu, incidents.alert_events(qu, auth(spark, sf_dir)), records(spark, sf_dir), "validation")
