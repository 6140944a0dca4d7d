"""Incident records and investigation packages as nested rows, and their parts as tables again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelog.functions.accounts import reference

from . import incidents

COUNTS = ["events", "failures", "sources", "destinations", "new_destinations", "new_sources", "new_hosts", "ntlm", "network", "logon"]
#: Edges of a day that a record shows, and references of an edge.
TOP_EDGES, EDGE_REFERENCES = 3, 3


def _in_order(rows: Column, *drop: str) -> Column:
    """An array of collected structs in order of their fields."""
    return F.array_sort(F.collect_list(rows))


def graph_days(edges: DataFrame, threshold: float, top: int = TOP_EDGES) -> DataFrame:
    """Scored edges (acting_user, window_end, destination_computer, score, is_new, successes, failures, lines) -> a row per user and day.

    day, score, is_alert, new_edges, degree, nodes (the computers of alert edges) and top_edges, in order of score.
    A user's edges of a day are bounded by the computers it met.
    """
    edge = F.struct((-F.col("score")).alias("order"), "destination_computer", "score", "is_new", "successes", "failures", F.slice("lines", 1, EDGE_REFERENCES).alias("lines"), (F.col("events") > EDGE_REFERENCES).alias("truncated"))
    g = edges.groupBy(F.col("acting_user").alias("user"), ((F.col("window_end") - 2) / 86_400).cast("int").alias("__d")).agg(
        F.max("score").alias("score"), F.count_if("is_new").alias("new_edges"), F.count("*").alias("degree"), F.slice(_in_order(edge), 1, top).alias("top_edges"),
        F.array_sort(F.collect_set(F.when(F.col("score") >= threshold, F.col("destination_computer")))).alias("nodes"),
    )
    return g.select("user", (F.col("__d") + 1).alias("day"), "score", (F.col("score") >= threshold).alias("is_alert"), "new_edges", "degree", "top_edges", "nodes")


def incident_records(queue: DataFrame, events: DataFrame, days: DataFrame, labels: DataFrame, split: str, chunks: DataFrame | None = None, gap: int = incidents.GAP) -> DataFrame:
    """A nested record for each incident of a daily queue.

    queue: alert hours (user, hour, day, score, rank, tied, percentile, alert_id and COUNTS); events: the log; days: graph_days();
    labels (user, hour): labelled hours; chunks (user, hour, lines): the lines of each hour's evidence chunk. Hours are in order
    of time, references in order of time and line, each once; the graph is context and decides nothing. An incident that has
    an hour above its day's cut-off is HIGH, others are MEDIUM. Null values stand for what is not there.
    """
    queue = queue.join(labels.select("user", "hour").distinct().withColumn("labelled", F.lit(True)), ["user", "hour"], "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))
    if chunks is None:
        queue = queue.withColumn("chunk", F.array().cast("array<bigint>"))
    else:
        queue = queue.join(chunks.select("user", "hour", F.col("lines").alias("chunk")), ["user", "hour"], "left")
    at = F.transform(_in_order(F.struct("timestamp", "source_line")), lambda x: x["source_line"])
    lines = incidents.alert_events(queue.select("alert_id", "user", "hour", "day"), events).groupBy("alert_id").agg(at.alias("lines"))
    hours = incidents.group_hours(queue, gap).join(lines, "alert_id", "left")
    counts = F.struct(*[F.col(c).cast("long").alias(c) for c in COUNTS])
    hour = F.struct("hour", "alert_id", (F.col("hour") + 3600).alias("end"), "rank", "tied", "score", "percentile", counts.alias("counts"), "labelled", "lines", "chunk")
    grouped = hours.groupBy("user", "incident_seq").agg(
        F.min("hour").alias("start"), (F.max("hour") + 3600).alias("end"), F.min("day").alias("day"), F.array_sort(F.collect_set("day")).alias("days"), _in_order(hour).alias("alert_hours"),
        F.when(F.bool_or(~F.col("tied")), "HIGH").otherwise("MEDIUM").alias("priority"), F.min("rank").alias("best_rank"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"), F.max("percentile").alias("max_percentile"),
    )
    each = grouped.select("user", "incident_seq", F.explode("days").alias("day"))
    dated = F.struct("day", "score", "is_alert", "new_edges", "degree", "top_edges", "nodes")
    context = each.join(days, ["user", "day"]).groupBy("user", "incident_seq").agg(_in_order(dated).alias("graph_days"))
    out = grouped.join(context, ["user", "incident_seq"], "left")
    lines_of = lambda c: F.array_distinct(F.flatten(F.transform("alert_hours", lambda h: F.coalesce(h[c], F.array().cast("array<bigint>")))))
    refs = lambda c: F.transform(lines_of(c), lambda x: reference("auth.txt", x))
    of_days = lambda f: F.transform("graph_days", f)
    total = lambda f: F.aggregate(of_days(f), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        incidents.incident_id(split, F.col("day"), F.col("user"), F.col("incident_seq")).alias("incident_id"), "user", "start", "end", (F.col("end") - F.col("start")).alias("duration_seconds"), "day", F.lit(split).alias("split"), "priority", "best_rank", "max_score", "mean_score",
        F.transform("alert_hours", lambda h: h.dropFields("lines", "chunk")).alias("alert_hours"),
        F.struct(F.struct(F.col("max_percentile").alias("max_score")).alias("sequence"), F.struct(F.array_max(of_days(lambda d: d["score"])).alias("max_score"), F.exists("graph_days", lambda d: d["is_alert"]).alias("any_alert")).alias("graph")).alias("detector_scores"),
        F.struct(F.lit(False).alias("decides"), total(lambda d: d["new_edges"]).alias("new_edges"), F.array_max(of_days(lambda d: d["degree"])).alias("max_degree"),
                 F.flatten(of_days(lambda d: F.transform(d["top_edges"], lambda e: F.struct(d["day"].alias("day"), e["destination_computer"].alias("destination_computer"), e["score"].alias("score"), e["is_new"].alias("is_new"), e["successes"].alias("successes"), e["failures"].alias("failures"), F.transform(e["lines"], lambda x: reference("auth.txt", x)).alias("references"), e["truncated"].alias("truncated"))))).alias("top_edges")).alias("graph_context"),
        F.array_sort(F.array_distinct(F.flatten(of_days(lambda d: d["nodes"])))).alias("evidence_nodes"), refs("lines").alias("references"), refs("chunk").alias("chunk_references"),
        F.struct(F.exists("alert_hours", lambda h: h["labelled"]).alias("any"), F.size(F.filter("alert_hours", lambda h: h["labelled"])).cast("long").alias("hours")).alias("truth"),
    )


def hour_table(records: DataFrame, answers: bool = False) -> DataFrame:
    """Alert hours of records, a row each; labels only where answers are asked for."""
    each = records.select("incident_id", "user", F.explode("alert_hours").alias("h")).select("incident_id", "user", "h.*")
    out = each.select("incident_id", "user", "alert_id", "hour", "end", "rank", "tied", "score", "percentile", *[F.col(f"counts.{c}").alias(c) for c in COUNTS], "labelled")
    return out if answers else out.drop("labelled")


def edge_table(records: DataFrame) -> DataFrame:
    """The graph edges shown with records, a row each, in their order within the incident."""
    each = records.select("incident_id", "user", F.posexplode("graph_context.top_edges").alias("position", "e"))
    return each.select("incident_id", "user", F.col("position").cast("long").alias("position"), "e.*")


def packages(records: DataFrame, events: DataFrame, observed: DataFrame) -> DataFrame:
    """What an investigator gets of each incident, without labels: sections `facts`, `detectors`, `graph`, `behaviours`, and all references.

    events (incident_id, ...) are the incident's events; observed (incident_id, rule, events): rules that fired.
    """
    fail = F.col("authentication_result") == "Fail"
    facts = events.groupBy("incident_id").agg(F.count("*").alias("events"), F.count_if(fail).alias("failures"), F.countDistinct("source_computer").alias("sources"), F.countDistinct("destination_computer").alias("destinations"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    rules = observed.groupBy("incident_id").agg(_in_order(F.struct("rule", "events")).alias("behaviours"))
    out = records.join(facts.select("incident_id", F.struct("events", "failures", "sources", "destinations", "first", "last").alias("facts")), "incident_id", "left").join(rules, "incident_id", "left")
    detectors = F.struct(F.col("best_rank").alias("best_rank"), F.col("max_score").alias("max_score"), F.col("detector_scores.sequence.max_score").alias("max_percentile"), F.size("alert_hours").cast("long").alias("alert_hours"), F.size(F.filter("alert_hours", lambda h: h["tied"])).cast("long").alias("tied_hours"))
    graph = F.struct(F.col("detector_scores.graph.max_score").alias("max_score"), F.col("detector_scores.graph.any_alert").alias("any_alert"), F.col("graph_context.new_edges").alias("new_edges"), F.col("graph_context.top_edges").alias("top_edges"), "evidence_nodes")
    return out.select("incident_id", "user", "start", "end", "priority", "facts", detectors.alias("detectors"), graph.alias("graph"), F.coalesce("behaviours", F.array().cast("array<struct<rule:string,events:bigint>>")).alias("behaviours"), "references")
