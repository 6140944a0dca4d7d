"""Queries over guards, saved models and the shorter reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.functions.accounts import reference
from kestrelog.operators import behaviours, fusion, graph, history, incidents, metrics, sequences, splits
from kestrelog.sources import adapters, authlog

from .base import AUTH, query
from .detect import EDGES, TEMPORAL, auth, fused, windowed
from .history import HISTORY
from .review import CITED, IE, cited, incident_events, queue_and_events, user_events, verdicts
from .units import PRICES


@query("splits_graph_history", f"WITH {EDGES} SELECT window_end, count(*) AS events, CASE WHEN window_end - 86400 - 86400 >= 1 THEN 'available' ELSE 'insufficient_history' END AS status FROM w GROUP BY window_end")
def _(spark, sf_dir):
    """Graph windows with whether a whole day of history lies before them."""
    per = windowed(spark, sf_dir).groupBy("window_end").agg(F.count("*").alias("events"))
    return per.withColumn("status", splits.graph_history_status(F.col("window_end") - graph.WINDOW))


_PLANTED = "pl AS (SELECT source_line, timestamp - CASE WHEN source_line % 211 = 0 THEN 500000 ELSE 0 END AS timestamp FROM (SELECT row_number() OVER (ORDER BY timestamp, source_line) AS source_line, timestamp FROM auth) UNION ALL SELECT 77, (SELECT timestamp FROM (SELECT row_number() OVER (ORDER BY timestamp, source_line) AS n, timestamp FROM auth) WHERE n = 77))"


@query("history_order_problems", f"WITH {AUTH}, {_PLANTED}, b AS (SELECT source_line, timestamp, lag(timestamp) OVER (ORDER BY source_line, timestamp) AS previous FROM pl) SELECT DISTINCT source_line, 'time_goes_back' AS problem FROM b WHERE timestamp < previous UNION ALL SELECT source_line, 'repeated_line' FROM pl GROUP BY source_line HAVING count(*) > 1")
def _(spark, sf_dir):
    """A log in order of time, in which some lines go back and one comes twice."""
    a = tables.stored(auth(spark, sf_dir).select("timestamp", "source_line").repartitionByRange("timestamp", "source_line").sortWithinPartitions("timestamp", "source_line").withColumn("id", F.monotonically_increasing_id()), "ordered-log")
    part = F.shiftright("id", 33)
    sizes = a.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r["count"]
    line = F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1) + 1
    lines = a.withColumn("part", part).join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part").select(line.alias("source_line"), "timestamp")
    lines = tables.stored(lines, "numbered-log")
    planted = lines.withColumn("timestamp", F.col("timestamp") - F.when(F.col("source_line") % 211 == 0, 500_000).otherwise(0))
    return history.order_problems(planted.unionByName(lines.where("source_line = 77")))


@query("history_joined_flags", f"WITH {HISTORY} SELECT source_line, acting_user, is_new_host_connection FROM nov")
def _(spark, sf_dir):
    """The flag that needs all users, worked out apart and joined back by line; the join fails unless it is one to one."""
    log = auth(spark, sf_dir)
    flags = history.novelty(log).select("source_line", "is_new_host_connection")
    return history.join_flags(log, tables.stored(flags, "host-flags"), ["is_new_host_connection"]).select("source_line", "acting_user", "is_new_host_connection")


@query("sequence_reference_check", f"WITH {AUTH} SELECT source_line, CASE WHEN source_line % 50 = 0 THEN 'auth.txt:' || (source_line + 1) WHEN source_line % 77 = 0 THEN NULL ELSE 'redteam.txt:' || source_line END AS source_reference FROM auth WHERE source_line % 50 = 0 OR source_line % 77 = 0 OR source_line % 91 = 0")
def _(spark, sf_dir):
    """Rows whose reference is not their line's, in a log where some are planted: every row is looked at, not a sample."""
    line = F.col("source_line")
    own = reference("auth.txt", line)
    planted = F.when(line % 50 == 0, reference("auth.txt", line + 1)).when(line % 77 == 0, F.lit(None)).when(line % 91 == 0, reference("redteam.txt", line)).otherwise(own)
    return sequences.reference_mismatches(auth(spark, sf_dir).withColumn("source_reference", planted)).select("source_line", "source_reference")


@query("calibration_saved", f"WITH {PRICES} SELECT round(x, 6) AS x, round(p, 6) AS p, round(scale, 6) AS scale FROM kn, ta")
def _(spark, sf_dir):
    """A calibrator written, read back and checked."""
    path = tables.fresh_path(spark, "calibrator")
    metrics.save_calibrator(metrics.fit_calibrator(adapters.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("score"))), path)
    return metrics.load_calibrator(spark, path).select(*[F.round(c, 6).alias(c) for c in ("x", "p", "scale")])


@query("ingest_detector_columns", f"WITH {AUTH} SELECT dataset_day, count(*) AS events FROM auth GROUP BY 1")
def _(spark, sf_dir):
    """Events by day as a detector reads them: a label column would be refused."""
    return authlog.assert_no_labels(auth(spark, sf_dir)).groupBy("dataset_day").agg(F.count("*").alias("events"))


@query("alerts_headline", f"""WITH {IE}, b AS (SELECT DISTINCT incident_id, rule FROM rm), pq AS (SELECT priority, count(*) AS n FROM rc GROUP BY 1)
SELECT 'priority' AS kind, priority AS name, n FROM pq UNION ALL SELECT 'behaviour', rule, count(*) FROM b GROUP BY rule UNION ALL SELECT 'behaviour', 'none', count(*) FROM (SELECT DISTINCT incident_id FROM ie WHERE incident_id NOT IN (SELECT incident_id FROM b)) HAVING count(*) > 0""")
def _(spark, sf_dir):
    """Incidents by priority and by behaviour, those without any counted too."""
    q, events = queue_and_events(spark, sf_dir)
    fired = behaviours.rule_matches(events).select("incident_id", "rule").distinct()
    named = events.select("incident_id").distinct().join(fired, "incident_id", "left").groupBy(F.coalesce("rule", F.lit("none")).alias("name")).agg(F.count("*").alias("n"))
    ranked = incidents.records(q, auth(spark, sf_dir), "validation").groupBy(F.col("priority").alias("name")).agg(F.count("*").alias("n"))
    return ranked.select(F.lit("priority").alias("kind"), "name", "n").union(named.select(F.lit("behaviour").alias("kind"), "name", "n"))


@query("replies_quota_report", f"WITH {IE}, i AS (SELECT incident_id, any_value(day) AS day, md5(incident_id) AS draw, bool_or(authentication_result = 'Fail') AS failed, count(*) > 40 AS busy FROM ie GROUP BY 1), s AS (SELECT *, 'failed' AS stratum FROM i WHERE failed UNION ALL SELECT *, 'quiet' FROM i WHERE NOT failed UNION ALL SELECT *, 'busy' FROM i WHERE busy), k AS (SELECT *, row_number() OVER (PARTITION BY stratum, day ORDER BY draw, incident_id) AS k FROM s), t AS (SELECT v.stratum, (SELECT count(*) FROM s WHERE s.stratum = v.stratum) AS eligible, least(400, (SELECT count(*) FROM k WHERE k.stratum = v.stratum AND k <= 2)) AS taken FROM (VALUES ('failed'), ('quiet'), ('busy')) v(stratum)) SELECT stratum, CAST(400 AS INTEGER) AS quota, eligible, taken, greatest(400 - taken, 0) AS unmet FROM t")
def _(spark, sf_dir):
    """How far strata of incidents fill a quota of 400 with two a day."""
    i = incident_events(spark, sf_dir).groupBy("incident_id").agg(F.first("day").alias("day"), F.bool_or(F.col("authentication_result") == "Fail").alias("failed"), (F.count("*") > 40).alias("busy"))
    i = tables.stored(i, "quota-incidents")
    strata = {"failed": F.col("failed"), "quiet": ~F.col("failed"), "busy": F.col("busy")}
    return behaviours.quota_report(i, strata, behaviours.quota_sample(i, strata, 400, 2, F.md5(F.col("incident_id").cast("binary"))), 400)


@query("replies_kept_techniques", f"WITH {CITED}, m AS (SELECT CASE WHEN length(incident_id) % 2 = 0 THEN 'a' ELSE 'b' END AS mode, * FROM vd) SELECT mode, technique, count(*) FILTER (verdict = 'Supported') AS supported, count(*) FILTER (verdict = 'Uncertain') AS uncertain, count(*) AS kept FROM m WHERE verdict <> 'Rejected' GROUP BY ALL")
def _(spark, sf_dir):
    """Techniques that each mode keeps, with how sure they are."""
    v = verdicts(spark, sf_dir).where("verdict <> 'Rejected'").withColumn("mode", F.when(F.length("incident_id") % 2 == 0, "a").otherwise("b"))
    count = lambda name: F.count_if(F.col("verdict") == name)
    return v.groupBy("mode", "technique").agg(count("Supported").alias("supported"), count("Uncertain").alias("uncertain"), F.count("*").alias("kept"))


@query("replies_citations", f"""WITH {CITED}, rf3 AS (SELECT incident_id, technique AS item, 'auth.txt:' || source_line AS reference, source_line FROM ci UNION SELECT incident_id, technique, CASE WHEN source_line % 3 = 0 THEN 'package:graph' ELSE 'package:none' END, NULL FROM ci WHERE source_line % 7 < 2),
ty AS (SELECT DISTINCT rf3.*, ue.timestamp, CASE WHEN ue.timestamp IS NOT NULL THEN 0 WHEN reference IN ('package:graph', 'package:detectors') THEN 1 ELSE 2 END AS kind FROM rf3 LEFT JOIN ue ON ue.incident_id = rf3.incident_id AND ue.source_line = rf3.source_line),
en AS (SELECT incident_id, item, kind, timestamp, CASE WHEN kind > 0 THEN reference END AS name, count(*) AS n FROM ty GROUP BY ALL), pl2 AS (SELECT *, row_number() OVER (PARTITION BY incident_id, item ORDER BY kind, timestamp NULLS FIRST, name NULLS FIRST) AS place FROM en)
SELECT incident_id, item, CAST(coalesce(sum(n) FILTER (kind = 0), 0) AS BIGINT) AS events, CAST(coalesce(sum(n) FILTER (kind = 1), 0) AS BIGINT) AS package, CAST(coalesce(sum(n) FILTER (kind = 2), 0) AS BIGINT) AS unknown, string_agg(coalesce(name, timestamp || 'x' || n), ' ' ORDER BY place) FILTER (place <= 4) AS shown, greatest(count(*) - 4, 0) AS more FROM pl2 GROUP BY ALL""")
def _(spark, sf_dir):
    """What each mapped technique cites: events, parts of the package, and references that name neither."""
    events = user_events(spark, sf_dir)
    c = tables.stored(cited(events), "cited")
    own = c.select("incident_id", F.col("technique").alias("item"), reference("auth.txt", F.col("source_line")).alias("reference"))
    part = F.when(F.col("source_line") % 3 == 0, "package:graph").otherwise("package:none")
    parts = c.where("source_line % 7 < 2").select("incident_id", F.col("technique").alias("item"), part.alias("reference"))
    return behaviours.citation_summary(own.union(parts), events, ["package:graph", "package:detectors"], 4)


_OWN = "al2 AS (SELECT user, hour, fused AS score, CASE WHEN fused >= 0.7 THEN 'alert' WHEN fused >= 0.6 THEN 'sub_threshold' END AS why FROM tf WHERE fused IS NOT NULL)"


@query("incidents_eligible_hours", f"""WITH {TEMPORAL}, {_OWN}, el AS (SELECT *, CASE WHEN lag(hour) OVER w IS NULL OR hour - (lag(hour) OVER w + 3600) > 7200 THEN 1 ELSE 0 END AS fresh FROM al2 WHERE why IS NOT NULL WINDOW w AS (PARTITION BY user ORDER BY hour))
SELECT user, hour, round(score, 6) AS score, why, CAST(sum(fresh) OVER (PARTITION BY user ORDER BY hour) AS BIGINT) AS incident_seq FROM el""")
def _(spark, sf_dir):
    """Hours that incidents are made of, by their own alert flag and, below it, at 0.6 or more, with their incident's number."""
    rows = fusion.temporal(fused(spark, sf_dir), alert=0.7).select("user", "hour", F.col("fused").alias("score"), "is_alert")
    return incidents.group_hours(incidents.eligible(rows, 0.6)).select("user", "hour", F.round("score", 6).alias("score"), "why", "incident_seq")
