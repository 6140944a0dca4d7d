"""Queries over packages and the views a reviewer works with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrelog.operators import behaviours, graph, hourly, incidents, metrics, sequences, splits
from kestrelog.sources import adapters

from .base import AUTH, SCORES, query
from .detect import BURSTS, EDGES, RECORDS, windowed
from .review import CITED, IE, cited, incident_events, user_events, verdicts
from .units import EVENTS, HOURLY, LABELLED, LONGEST, counts, labelled, scored_events


_GRID = "[" + ", ".join(repr(i * metrics.P_TOP / (metrics.KNOTS - 1)) for i in range(metrics.KNOTS)) + "]"


@query("graph_counter_enhanced", f"""WITH {EDGES}, {BURSTS}, {SCORES[len(AUTH) + 2:]}, pe AS (SELECT acting_user AS user, CAST((window_end - 2) // 86400 + 1 AS INTEGER) AS day, ln(greatest(CAST(peak_destinations_300s AS DOUBLE), 0) + 1e-12) AS x FROM pk), rf2 AS (SELECT x FROM pe WHERE day <= 16),
qs AS (SELECT quantile_cont(x, {_GRID}) AS q, (quantile_cont(x, 0.999) - quantile_cont(x, 0.99)) / ln(10.0) AS spread, stddev_pop(x) AS std FROM rf2), sl AS (SELECT CASE WHEN spread > 0 THEN spread ELSE greatest(std, 1e-6) / 10 END AS scale FROM qs), kn AS (SELECT q[i + 1] AS x, max(i) * 0.999 / 1000 AS p FROM range(0, 1001) t(i), qs GROUP BY 1),
kk AS (SELECT *, lead(x) OVER (ORDER BY x) AS x2, lead(p) OVER (ORDER BY x) AS p2 FROM kn), j AS (SELECT pe.*, kk.x AS kx, kk.p AS kp, x2, p2 FROM pe ASOF LEFT JOIN kk ON pe.x >= kk.x), cl AS (SELECT user, day, CASE WHEN kx IS NULL THEN 0.0 WHEN x2 IS NULL THEN 1 - (1 - kp) / (1 + (x - kx) / (SELECT scale FROM sl)) ELSE kp + (p2 - kp) * (x - kx) / (x2 - kx) END AS calibrated FROM j),
ds AS (SELECT user, day, max(graph_score) AS graph_score FROM hs GROUP BY ALL) SELECT user, day, round(0.25 * graph_score + 0.75 * calibrated, 5) AS score FROM cl JOIN ds USING (user, day)""")
def _(spark, sf_dir):
    """0.25 of a user-day's graph score and 0.75 of its calibrated peak of distinct computers."""
    peaks = graph.day_rows(graph.bursts(windowed(spark, sf_dir))).select(F.col("acting_user").alias("user"), "day", F.col("peak_destinations_300s").cast("double").alias("score"))
    days = adapters.hour_scores(spark, sf_dir).groupBy("user", "day").agg(F.max("graph_score").alias("graph_score"))
    rows = metrics.calibrate(peaks, metrics.fit_calibrator(peaks.where("day <= 16"))).join(days, ["user", "day"])
    return rows.select("user", "day", F.round(0.25 * F.col("graph_score") + 0.75 * F.col("calibrated"), 5).alias("score"))


@query("supervised_unit_check", f"WITH {HOURLY}, s AS (SELECT acting_user, hour FROM hc WHERE tie % 13 <> 0) SELECT day, count(*) AS units, count(*) FILTER (s.hour IS NULL) AS without_score FROM hc LEFT JOIN s ON s.acting_user = hc.acting_user AND s.hour = hc.hour GROUP BY day")
def _(spark, sf_dir):
    c = counts(spark, sf_dir)
    scored = c.where("tie % 13 <> 0").select("acting_user", "hour", F.lit(True).alias("scored"))
    return c.join(scored, ["acting_user", "hour"], "left").groupBy("day").agg(F.count("*").alias("units"), F.count_if(F.col("scored").isNull()).alias("without_score"))


@query("supervised_human_only", f"WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN is_machine THEN -1 ELSE score END DESC, tie) AS rank FROM sc) SELECT count(*) FILTER (rank <= 38) AS selected, count(*) FILTER (rank <= 38 AND label) AS hits, count(*) FILTER (rank <= 38 AND is_machine) AS machines FROM r")
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("score", F.when(F.col("is_machine"), -1.0).otherwise(F.col("score")))
    return metrics.budget_metrics(rows, 38, ["tie"]).select("selected", "hits", "machines")


@query("supervised_tie_order", f"WITH {HOURLY} SELECT acting_user, hour, day, CAST(row_number() OVER (PARTITION BY day ORDER BY either DESC, md5('42/' || day || '/' || acting_user || '/' || hour)) AS INTEGER) AS rank FROM hc")
def _(spark, sf_dir):
    """Units of each day in the fixed order that breaks ties."""
    c = counts(spark, sf_dir)
    order = Window.partitionBy("day").orderBy(F.desc("either"), hourly.tie_order(42, "day", "acting_user", "hour"))
    return c.select("acting_user", "hour", "day", F.row_number().over(order).alias("rank"))


@query("evidence_packages", f"""WITH {IE}, b AS (SELECT incident_id, string_agg(rule || '=' || n, ' ' ORDER BY rule) AS behaviours FROM (SELECT incident_id, rule, count(*) AS n FROM rm GROUP BY ALL) GROUP BY 1),
c AS (SELECT incident_id, count(*) AS events, count(*) FILTER (authentication_result = 'Fail') AS failures, count(DISTINCT destination_computer) AS destinations, min(timestamp) AS first, max(timestamp) AS last FROM ie GROUP BY 1) SELECT incident_id, events, failures, destinations, first, last, coalesce(behaviours, '') AS behaviours FROM c LEFT JOIN b USING (incident_id)""")
def _(spark, sf_dir):
    e = incident_events(spark, sf_dir)
    seen = behaviours.observed(e).groupBy("incident_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat_ws("=", "rule", F.col("events").cast("string"))))).alias("behaviours"))
    times = e.groupBy("incident_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    out = behaviours.event_counts(e).join(times, "incident_id").join(seen, "incident_id", "left")
    return out.select("incident_id", "events", "failures", "destinations", "first", "last", F.coalesce("behaviours", F.lit("")).alias("behaviours"))


@query("incidents_search", f"WITH {IE} SELECT DISTINCT incident_id FROM ie WHERE destination_computer = 'C104' OR acting_user LIKE 'U7%' OR source_line = 100")
def _(spark, sf_dir):
    e = incident_events(spark, sf_dir)
    hits = (F.col("destination_computer") == "C104") | F.col("acting_user").startswith("U7") | (F.col("source_line") == 100)
    return e.select("incident_id").distinct().join(e.where(hits).select("incident_id"), "incident_id", "left_semi")


@query("incidents_alert_hours", f"WITH {RECORDS} SELECT user, alert_id, hour, CAST(incident_seq AS BIGINT) AS incident_seq FROM ig")
def _(spark, sf_dir):
    from .detect import queue

    grouped = incidents.group_hours(queue(spark, sf_dir))
    nested = grouped.groupBy("user", "incident_seq").agg(F.sort_array(F.collect_list(F.struct("hour", "alert_id"))).alias("hours"))
    return nested.select("user", "incident_seq", F.explode("hours").alias("h")).select("user", "incident_seq", "h.hour", "h.alert_id")


@query("evidence_timeline", f"WITH {IE} SELECT incident_id, source_line, timestamp, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, source_line) AS position FROM ie")
def _(spark, sf_dir):
    w = Window.partitionBy("incident_id").orderBy("timestamp", "source_line")
    return incident_events(spark, sf_dir).select("incident_id", "source_line", "timestamp", F.row_number().over(w).cast("long").alias("position"))


@query("evidence_claim_order", f"WITH {CITED}, t AS (SELECT ci.incident_id, technique, min(ue.timestamp) AS first FROM ci LEFT JOIN ue ON ue.incident_id = ci.incident_id AND ue.source_line = ci.source_line GROUP BY ALL) SELECT incident_id, technique, first, row_number() OVER (PARTITION BY incident_id ORDER BY first NULLS LAST, technique) AS position, first IS NOT NULL AS timed FROM t")
def _(spark, sf_dir):
    """Mapped techniques by their earliest cited event; those that cite none of the package come last and are marked."""
    events = user_events(spark, sf_dir)
    e = events.select("incident_id", "source_line", "timestamp")
    first = cited(events).join(e, ["incident_id", "source_line"], "left").groupBy("incident_id", "technique").agg(F.min("timestamp").alias("first"))
    w = Window.partitionBy("incident_id").orderBy(F.asc_nulls_last("first"), "technique")
    return first.withColumns({"position": F.row_number().over(w).cast("long"), "timed": F.col("first").isNotNull()})


@query("evidence_citation_summary", f"WITH {IE}, s AS (SELECT acting_user, timestamp, count(*) AS n, min(source_line) AS line FROM (SELECT DISTINCT acting_user, timestamp, source_line FROM ie) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY acting_user ORDER BY timestamp) AS r, count(*) OVER (PARTITION BY acting_user) AS seconds FROM s) SELECT acting_user, string_agg(timestamp || 'x' || n, ' ' ORDER BY r) FILTER (r <= 3) AS shown, greatest(0, max(seconds) - 3) AS more FROM r GROUP BY 1")
def _(spark, sf_dir):
    e = incident_events(spark, sf_dir).select("acting_user", "timestamp", "source_line").distinct()
    per = e.groupBy("acting_user", "timestamp").agg(F.count("*").alias("n"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("acting_user").orderBy("timestamp")))
    shown = F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", F.concat_ws("x", F.col("timestamp").cast("string"), F.col("n").cast("string")).alias("t")))))
    return ranked.groupBy("acting_user").agg(F.concat_ws(" ", F.transform(shown, lambda x: x["t"])).alias("shown"), F.greatest(F.lit(0).cast("long"), F.count("*") - 3).alias("more"))


@query("replies_removed_items", f"WITH {CITED} SELECT reason, count(*) AS removed, count(DISTINCT incident_id) AS incidents FROM vd WHERE verdict = 'Rejected' GROUP BY reason")
def _(spark, sf_dir):
    return verdicts(spark, sf_dir).where("verdict = 'Rejected'").groupBy("reason").agg(F.count("*").alias("removed"), F.countDistinct("incident_id").alias("incidents"))


@query("behaviours_combinations", f"WITH {IE}, k AS (SELECT incident_id, string_agg(DISTINCT rule, '+' ORDER BY rule) AS combination FROM rm GROUP BY 1) SELECT combination, min(incident_id) AS example, count(*) AS incidents FROM k GROUP BY 1")
def _(spark, sf_dir):
    per = behaviours.rule_matches(incident_events(spark, sf_dir)).groupBy("incident_id").agg(F.array_join(F.sort_array(F.collect_set("rule")), "+").alias("combination"))
    return per.groupBy("combination").agg(F.min("incident_id").alias("example"), F.count("*").alias("incidents"))


@query("sequence_export_slices", f"WITH {EVENTS}, ch AS (SELECT acting_user, hour, chunk, avg(error) AS m FROM ec GROUP BY ALL), b AS (SELECT acting_user, hour, arg_max(chunk, (m, -chunk)) AS chunk FROM ch GROUP BY ALL) SELECT ec.acting_user, ec.hour, string_agg(source_line, ' ' ORDER BY position) AS lines FROM ec JOIN b ON b.acting_user = ec.acting_user AND b.hour = ec.hour AND b.chunk = ec.chunk GROUP BY ALL")
def _(spark, sf_dir):
    """The lines of each unit's evidence chunk, by offset and length."""
    from kestrelog.operators import scoring

    u = sequences.user_hours(adapters.auth_events(spark, sf_dir))
    best = scoring.unit_scores(scored_events(spark, sf_dir)).select("acting_user", "hour", F.col("best_chunk").alias("chunk"))
    cut = sequences.chunks(u, LONGEST).join(best, ["acting_user", "hour", "chunk"]).join(u.select("acting_user", "hour", "lines"), ["acting_user", "hour"])
    return cut.select("acting_user", "hour", F.array_join(F.slice("lines", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).cast("array<string>"), " ").alias("lines"))


@query("alerts_day_cutoffs", f"WITH {RECORDS} SELECT day, count(*) FILTER (NOT tied) AS above, count(*) FILTER (tied) AS tied FROM q GROUP BY day")
def _(spark, sf_dir):
    from .detect import queue

    return queue(spark, sf_dir).groupBy("day").agg(F.count_if(~F.col("tied")).alias("above"), F.count_if("tied").alias("tied"))


@query("splits_hour_profile", f"WITH {SCORES} SELECT user, hour, n, fails, dests FROM hs0")
def _(spark, sf_dir):
    e = adapters.auth_events(spark, sf_dir).withColumn("hour", splits.hour_start(F.col("timestamp")))
    return e.groupBy(F.col("acting_user").alias("user"), "hour").agg(F.count("*").alias("n"), F.count_if(F.col("authentication_result") == "Fail").alias("fails"), F.countDistinct("destination_computer").alias("dests"))


