"""Queries over nested incident records and investigation packages, each part of them as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.operators import behaviours, incidents, records, sequences, splits
from kestrelog.sources import adapters

from .base import query
from .detect import _CLEAN, EDGES, auth, hour_scores, weighted_edges
from .detect import RECORDS as _RECORDS
from .history import RED_PART
from .review import IE, queue_and_events

THRESHOLD = 0.75
_EDGES_PART = EDGES[EDGES.index("w AS ("):]
RECORDS = _RECORDS + RED_PART + f""", {_EDGES_PART},
es AS (SELECT *, round(1 - 1 / (1 + weight + CASE WHEN is_new THEN 2 ELSE 0 END), 6) AS score FROM ed),
er AS (SELECT *, row_number() OVER (PARTITION BY acting_user, window_end ORDER BY score DESC, destination_computer) AS n, CAST((window_end - 2) // 86400 + 1 AS INTEGER) AS gday FROM es),
gd AS (SELECT acting_user AS user, gday AS day, max(score) AS score, count(*) FILTER (is_new) AS new_edges, count(*) AS degree FROM er GROUP BY ALL),
lh AS (SELECT DISTINCT user, 1 + ((timestamp - 1) // 3600) * 3600 AS hour FROM red),
ih AS (SELECT ig.*, format('INC-VALIDATION-D{{:02d}}-{{}}-{{:03d}}', f.day, {_CLEAN.replace("user", "ig.user")}, CAST(ig.incident_seq AS BIGINT)) AS incident_id, lh.user IS NOT NULL AS labelled FROM ig JOIN (SELECT user, incident_seq, min(day) AS day FROM ig GROUP BY ALL) f ON f.user = ig.user AND f.incident_seq = ig.incident_seq LEFT JOIN lh ON lh.user = ig.user AND lh.hour = ig.hour),
ds AS (SELECT DISTINCT incident_id, user, day FROM ih), gx AS (SELECT ds.incident_id, gd.* FROM ds JOIN gd ON gd.user = ds.user AND gd.day = ds.day)"""


def nested(spark, sf_dir, queue: DataFrame | None = None) -> DataFrame:
    """Records of the daily queue with graph context, labels and the first events of each hour as its chunk.

    Edges and hours are those of a user alone, so only the log of the queue's users is gathered.
    """
    queue = tables.stored(incidents.daily_queue(hour_scores(spark, sf_dir, *records.COUNTS)), "queue") if queue is None else queue
    users = tables.checked(queue.select(F.col("user").alias("acting_user")).distinct())
    log = tables.stored(auth(spark, sf_dir).join(users, "acting_user", "left_semi"), "queue-users")
    days = records.graph_days(weighted_edges(spark, sf_dir, log), THRESHOLD)
    labels = splits.label_hours(adapters.red_team(spark, sf_dir))
    units = sequences.user_hours(log).select(F.col("acting_user").alias("user"), "hour", F.slice("lines", 1, 2).alias("lines"))
    return tables.stored(records.incident_records(queue, log, days, labels, "validation", units), "incident-records")


_COUNTS = ", ".join(f"hc.{c}" for c in records.COUNTS)


@query("incidents_nested_hours", f"WITH {RECORDS} SELECT incident_id, ih.user, alert_id, ih.hour, ih.hour + 3600 AS \"end\", CAST(rank AS INTEGER) AS rank, tied, score, round(percentile, 6) AS percentile, {_COUNTS}, labelled FROM ih JOIN hc ON hc.acting_user = ih.user AND hc.hour = ih.hour")
def _(spark, sf_dir):
    """The alert hours inside the records, with their counts and, since it is asked for, their labels."""
    return records.hour_table(nested(spark, sf_dir), answers=True).withColumn("percentile", F.round("percentile", 6))


@query("incidents_graph_edges", f"WITH {RECORDS} SELECT ds.incident_id, ds.user, row_number() OVER (PARTITION BY ds.incident_id ORDER BY er.gday, er.n) - 1 AS position, er.gday AS day, destination_computer, CAST(er.score AS DOUBLE) AS score, is_new, successes, failures, array_to_string(list_transform(string_split(lines, ' ')[1:3], lambda x: 'auth.txt:' || x), ' ') AS \"references\", events > 3 AS truncated FROM ds JOIN er ON er.acting_user = ds.user AND er.gday = ds.day WHERE n <= 3")
def _(spark, sf_dir):
    """The graph edges inside the records."""
    return records.edge_table(nested(spark, sf_dir)).withColumn("references", F.array_join("references", " "))


@query("incidents_nested_summary", f"""WITH {RECORDS}, h AS (SELECT incident_id, user, min(hour) AS start, max(hour) + 3600 AS "end", min(day) AS day, CASE WHEN bool_or(NOT tied) THEN 'HIGH' ELSE 'MEDIUM' END AS priority, CAST(min(rank) AS INTEGER) AS best_rank, max(score) AS max_score, round(avg(score), 6) AS mean_score, round(max(percentile), 6) AS max_percentile, bool_or(labelled) AS labelled, count(*) FILTER (labelled) AS labelled_hours FROM ih GROUP BY ALL),
g AS (SELECT incident_id, CAST(max(score) AS DOUBLE) AS graph_score, max(score) >= {THRESHOLD} AS graph_alert, CAST(sum(new_edges) AS BIGINT) AS new_edges, max(degree) AS max_degree FROM gx GROUP BY 1),
nd AS (SELECT incident_id, string_agg(DISTINCT destination_computer, ' ' ORDER BY destination_computer) AS nodes FROM ds JOIN er ON er.acting_user = ds.user AND er.gday = ds.day WHERE er.score >= {THRESHOLD} GROUP BY 1),
hv AS (SELECT incident_id, ih.hour, a.source_line, a.timestamp, row_number() OVER (PARTITION BY incident_id, ih.hour ORDER BY a.timestamp, a.source_line) AS k FROM ih JOIN auth a ON a.acting_user = ih.user AND a.hour = ih.hour),
rf2 AS (SELECT incident_id, string_agg('auth.txt:' || source_line, ' ' ORDER BY timestamp, source_line) AS refs, string_agg('auth.txt:' || source_line, ' ' ORDER BY timestamp, source_line) FILTER (k <= 2) AS chunk_refs, count(*) AS evidence FROM hv GROUP BY 1)
SELECT h.*, "end" - start AS duration_seconds, graph_score, graph_alert, new_edges, max_degree, coalesce(nodes, '') AS nodes, refs AS "references", chunk_refs AS chunk_references, evidence FROM h LEFT JOIN g USING (incident_id) LEFT JOIN nd USING (incident_id) JOIN rf2 USING (incident_id)""")
def _(spark, sf_dir):
    """The records' own fields, detector scores, graph context, nodes and references."""
    return nested(spark, sf_dir).select(
        "incident_id", "user", "start", "end", "day", "priority", "best_rank", "max_score", F.round("mean_score", 6).alias("mean_score"), F.round("detector_scores.sequence.max_score", 6).alias("max_percentile"), F.col("truth.any").alias("labelled"), F.col("truth.hours").alias("labelled_hours"), "duration_seconds",
        F.col("detector_scores.graph.max_score").alias("graph_score"), F.col("detector_scores.graph.any_alert").alias("graph_alert"), "graph_context.new_edges", "graph_context.max_degree", F.array_join("evidence_nodes", " ").alias("nodes"),
        F.array_join("references", " ").alias("references"), F.array_join("chunk_references", " ").alias("chunk_references"), F.size("references").cast("long").alias("evidence"),
    )


@query("evidence_package_sections", f"""WITH {RECORDS}, {IE[len(_RECORDS):].lstrip(', ' + chr(10))}, h AS (SELECT incident_id, CAST(min(rank) AS INTEGER) AS best_rank, max(score) AS max_score, round(max(percentile), 6) AS max_percentile, count(*) AS alert_hours, count(*) FILTER (tied) AS tied_hours FROM ih GROUP BY 1),
g AS (SELECT incident_id, CAST(max(score) AS DOUBLE) AS graph_score, max(score) >= {THRESHOLD} AS graph_alert, CAST(sum(new_edges) AS BIGINT) AS new_edges, least(max(day), max(day)) IS NOT NULL AS there, count(*) AS graph_days FROM gx GROUP BY 1),
fa AS (SELECT incident_id, count(*) AS events, count(*) FILTER (authentication_result = 'Fail') AS failures, count(DISTINCT source_computer) AS sources, count(DISTINCT destination_computer) AS destinations, min(timestamp) AS first, max(timestamp) AS last FROM ie GROUP BY 1),
bh AS (SELECT incident_id, string_agg(rule || '=' || n, ' ' ORDER BY rule) AS behaviours FROM (SELECT incident_id, rule, count(*) AS n FROM rm GROUP BY ALL) GROUP BY 1)
SELECT incident_id, events, failures, sources, destinations, first, last, best_rank, max_score, max_percentile, alert_hours, tied_hours, graph_score, graph_alert, new_edges, coalesce(behaviours, '') AS behaviours FROM h LEFT JOIN g USING (incident_id) LEFT JOIN fa USING (incident_id) LEFT JOIN bh USING (incident_id)""")
def _(spark, sf_dir):
    """The sections of investigation packages: facts, detectors, graph and behaviours."""
    q, events = queue_and_events(spark, sf_dir, *records.COUNTS)
    found = records.packages(nested(spark, sf_dir, q), events, behaviours.observed(events).select("incident_id", "rule", "events"))
    fired = F.array_join(F.transform("behaviours", lambda b: F.concat_ws("=", b["rule"], b["events"].cast("string"))), " ")
    return found.select("incident_id", "facts.*", "detectors.*", F.col("graph.max_score").alias("graph_score"), F.col("graph.any_alert").alias("graph_alert"), F.col("graph.new_edges").alias("new_edges"), fired.alias("behaviours")).withColumn("max_percentile", F.round("max_percentile", 6))
