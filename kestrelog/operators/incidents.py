"""Daily alert queues, incidents, and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions import spans, tables
from kestrelog.functions.accounts import clean_user

GAP = 7200
#: Width of the bins by which intervals are joined.
BIN = 86_400
BUDGET = 38


def top_of_day(scored: DataFrame, budget: int = BUDGET, tie: str = "tie", parts: int = 64) -> DataFrame:
    """The best `budget` rows of each day with their rank. Each part of a day keeps its own best first, so that a day's window sees parts x budget rows."""
    dealt = scored.withColumn("__part", F.pmod(F.xxhash64(tie), F.lit(parts)))
    for keys in (["day", "__part"], ["day"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), tie)
        dealt = dealt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)
    return dealt.drop("__part")


def day_percentile(top: DataFrame, scored: DataFrame, column: str, name: str) -> DataFrame:
    """top with name: the share of the day's rows in scored whose column is at or below the row's own; null values count nowhere.

    top has a bounded number of rows a day: their values cut the day into as many ranges, rows are counted by
    range, and shares are running sums over ranges.
    """
    cuts = tables.checked(tables.stored(top.groupBy("day").agg(F.sort_array(F.collect_set(column)).alias("__cuts")), "day-cuts"))
    below = F.size(F.filter("__cuts", lambda c: c < F.col(column)))
    counted = scored.where(F.col(column).isNotNull()).join(cuts, "day").groupBy("day", below.alias("__range")).agg(F.count("*").alias("__n"))
    day = Window.partitionBy("day")
    share = F.sum("__n").over(day.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("__n").over(day)  # a row for each range
    shares = counted.withColumn(name, share).join(cuts, "day").select("day", F.get("__cuts", F.col("__range")).alias(column), name).where(F.col(column).isNotNull())
    return top.join(tables.checked(tables.stored(shares, "day-shares")), ["day", column], "left")


def daily_queue(scored: DataFrame, budget: int = BUDGET, tie: str = "tie", percentiles: dict[str, str] = {"score": "percentile"}) -> DataFrame:  # noqa: B006
    """The top `budget` of each day (user, hour, day, score): rank, cut-off score, tied, id, percentiles of the named columns within the day."""
    fields = scored.columns
    scored = tables.stored(scored, "scored-hours")
    top = tables.stored(top_of_day(scored, budget, tie), "top-hours")
    cut = F.min("score").over(Window.partitionBy("day"))
    for column, name in percentiles.items():
        top = day_percentile(top, scored, column, name)
    top = top.select(*fields, "rank", *percentiles.values())
    return top.withColumns({"cutoff": cut, "tied": F.col("score") == cut, "alert_id": F.format_string("ALR-D%02d-%02d", "day", "rank")})


def group_hours(alerts: DataFrame, gap: int = GAP, keys: list[str] = ["user"]) -> DataFrame:  # noqa: B006
    """Adds incident_seq: a user's hours join while the next starts within `gap` of the end of the one before."""
    w = Window.partitionBy(*keys).orderBy("hour")
    fresh = F.when(F.lag("hour").over(w).isNull() | (F.col("hour") - (F.lag("hour").over(w) + 3600) > gap), 1).otherwise(0)
    return alerts.withColumn("__new", fresh).withColumn("incident_seq", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def incident_id(split: str | Column, day: Column, user: Column, seq: Column) -> Column:
    name = split if isinstance(split, Column) else F.lit(split)
    return F.format_string("INC-%s-D%02d-%s-%03d", F.upper(name), day, clean_user(user), seq)


def priority(max_score: Column, concordant: Column, boosted: Column) -> Column:
    return F.when(concordant | (max_score >= 0.9995), "CRITICAL").when(boosted | (max_score >= 0.999), "HIGH").when(max_score >= 0.99, "MEDIUM").otherwise("LOW")


def eligible(rows: DataFrame, sub_threshold: float | None = None) -> DataFrame:
    """Rows (score, is_alert) that incidents are made of: alerts and, if asked for, others that score sub_threshold or more, with `why`. Rows without a score are none."""
    why = F.when(F.coalesce("is_alert", F.lit(False)), "alert")
    if sub_threshold is not None:
        why = why.when(F.col("score") >= sub_threshold, "sub_threshold")
    return rows.where("score is not null").withColumn("why", why).where("why is not null")


def build(alerts: DataFrame, split: str, gap: int = GAP) -> DataFrame:
    """Alert hours (user, hour, day, score, disagreement, boost, seq_score, graph_score) -> one row per incident."""
    g = group_hours(alerts, gap).groupBy("user", "incident_seq").agg(
        F.min("hour").alias("start"), (F.max("hour") + 3600).alias("end"), F.min("day").alias("day"), F.count("*").alias("alert_hours"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"),
        F.max("seq_score").alias("max_seq"), F.max("graph_score").alias("max_graph"), F.bool_or(F.col("disagreement") == "concordant_alert").alias("c"), F.bool_or(F.col("disagreement") == "sequence_only_alert").alias("s"),
        F.bool_or(F.col("disagreement") == "graph_only_alert").alias("g"), F.bool_or(F.col("boost") > 0).alias("boosted"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("hour")), lambda h: h.cast("string"))).alias("hours"),
    )
    concordance = F.when(F.col("c"), "concordant").when(F.col("s") & F.col("g"), "phased").when(F.col("s"), "sequence").when(F.col("g"), "graph").otherwise("normal")
    return g.withColumns({
        "incident_id": incident_id(split, F.col("day"), F.col("user"), F.col("incident_seq")), "duration_hours": F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / 3600)).cast("long"),
        "concordance": concordance, "priority": priority(F.col("max_score"), F.col("c"), F.col("boosted")),
    }).drop("c", "s", "g")


def apply_signatures(incidents: DataFrame, events: DataFrame, signatures: DataFrame, predicate: Column | None = None) -> DataFrame:
    """incidents (incident_id, user, priority) with events (incident_id, source_computer, destination_computer): a matching signature makes them CRITICAL.

    signatures (kind, user, source, computer): user, node, pair of user and computer, or triple of user, source and computer. predicate,
    a condition on the columns of incidents, is a rule of its own. The kinds that matched are named.
    """
    each = events.join(incidents.select("incident_id", "user"), "incident_id").select("incident_id", "user", F.col("source_computer").alias("source"), F.col("destination_computer").alias("computer")).distinct()
    each, hits = tables.stored(each, "incident-computers"), incidents.where(predicate if predicate is not None else F.lit(False)).select("incident_id", F.lit("rule").alias("kind"))
    for kind, on in (("user", ["user"]), ("node", ["computer"]), ("pair", ["user", "computer"]), ("triple", ["user", "source", "computer"])):
        part = tables.checked(signatures.where(F.col("kind") == kind).select("kind", *on).distinct())
        hits = hits.union(each.join(part, on).select("incident_id", "kind"))
    named = hits.groupBy("incident_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("signatures"))
    return incidents.join(named, "incident_id", "left").withColumn("priority", F.when(F.col("signatures").isNotNull(), "CRITICAL").otherwise(F.col("priority")))


def alert_events(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Events behind each alert (user, hour, day); days prune partitions of events. A user's hour is the key, so no user's history meets in one task."""
    keyed = events.withColumn("hour", (F.floor((F.col("timestamp") - 1) / 3600) * 3600 + 1).cast("long"))
    a = alerts.select("alert_id", F.col("user").alias("acting_user"), "hour", F.col("day").alias("dataset_day"))
    return keyed.join(a, ["acting_user", "hour", "dataset_day"])


def incident_events(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each incident's user within its span [start, end), joined by bins of time."""
    spans_ = incidents.select("incident_id", F.col("user").alias("acting_user"), "start", "end")
    return spans.points_within(spans_, events, ["acting_user"], BIN)


def alert_count_check(alerts: DataFrame, events: DataFrame, count: str = "auth_count") -> DataFrame:
    """(alert_id, scored, found, agrees): the scored number of events of each alert against those found behind it."""
    found = alert_events(alerts.select("alert_id", "user", "hour", "day"), events).groupBy("alert_id").agg(F.count("*").alias("found"))
    both = alerts.select("alert_id", F.col(count).cast("long").alias("scored")).join(found, "alert_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.withColumn("agrees", F.col("scored") == F.col("found"))


def require_counts(alerts: DataFrame, events: DataFrame, count: str = "auth_count") -> DataFrame:
    """The events behind alerts; fails if an alert's number of events is not the scored one."""
    wrong = alert_count_check(alerts, events, count).where("not agrees").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].alert_id}: {wrong[0].found} events found, {wrong[0].scored} scored")
    return alert_events(alerts, events)


def records(queue: DataFrame, events: DataFrame, split: str, gap: int = GAP) -> DataFrame:
    """Incident records of a daily queue: alert ids and hours, HIGH if any hour is above its day's cut-off, references in time order."""
    grouped = group_hours(queue, gap)
    lines = alert_events(queue, events).groupBy("alert_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", "source_line"))).alias("at"))
    out = grouped.join(lines, "alert_id", "left").groupBy("user", "incident_seq").agg(
        F.min("day").alias("day"), F.min("hour").alias("start"), (F.max("hour") + 3600).alias("end"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("hour", "alert_id"))), lambda x: x["alert_id"])).alias("alerts"),
        F.when(F.bool_or(~F.col("tied")), "HIGH").otherwise("MEDIUM").alias("priority"), F.sort_array(F.flatten(F.collect_list("at"))).alias("at"),
    )
    return out.withColumns({"incident_id": incident_id(split, F.col("day"), F.col("user"), F.col("incident_seq")), "n_references": F.size("at").cast("long"), "references": F.concat_ws(" ", F.transform("at", lambda x: F.concat(F.lit("auth.txt:"), x["source_line"].cast("string"))))}).drop("at")


def triage(incidents: DataFrame, label_hours: DataFrame) -> DataFrame:
    """One row: incidents that overlap a labelled hour of their user, hours reviewed, label hours met, compression of alerts."""
    labels = label_hours.select("user", F.col("hour").alias("lh"), F.col("hour").alias("their_start"), (F.col("hour") + 3600).alias("their_end"))
    joined = spans.overlapping(incidents, labels, ["user"], BIN, "left").withColumn("meets", F.col("lh").isNotNull())
    per = joined.groupBy("incident_id").agg(F.max("meets").alias("meets"), F.first("alert_hours").alias("alert_hours"), F.countDistinct(F.when(F.col("meets"), F.col("lh"))).alias("met"))
    return per.agg(F.count("*").alias("incidents"), F.count_if("meets").alias("true_incidents"), F.sum("alert_hours").alias("alerts"), F.sum("met").alias("label_hours_met"), (1 - F.count("*") / F.sum("alert_hours")).alias("compression"))


RANKS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def priority_rank(p: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RANKS)), p)


def queue_view(incidents: DataFrame, text: str | None = None, priorities: list[str] | None = None, start: int | None = None, end: int | None = None, order: str = "priority") -> DataFrame:
    """Filters by user text, priorities and overlap with [start, end), and one of four orders."""
    if text:
        incidents = incidents.where(F.lower("user").contains(text.lower()))
    if priorities:
        incidents = incidents.where(F.col("priority").isin(priorities))
    if start is not None:
        incidents = incidents.where((F.col("end") > start) & (F.col("start") < end))
    orders = {"priority": [priority_rank(F.col("priority")), F.desc("max_score")], "score": [F.desc("max_score")], "newest": [F.desc("start")], "oldest": [F.col("start")]}
    return incidents.orderBy(*orders[order], "incident_id")


def unresolved(records_: DataFrame, events: DataFrame) -> DataFrame:
    """(incident_id, source_line) of references that name no event; a sound package has none."""
    each = records_.select("incident_id", F.explode(F.split("references", " ")).alias("r")).where("r <> ''").select("incident_id", F.substring_index("r", ":", -1).cast("long").alias("source_line"))
    return each.join(events.select("source_line"), "source_line", "left_anti")


def package_counts(queue: DataFrame, events: DataFrame, records_: DataFrame, split: str) -> DataFrame:
    """One row of counts of a package; the test split is refused."""
    if split == "test":
        raise ValueError("no package is made of the test split")
    one = F.lit(True)  # each side is one row
    return queue.agg(F.count("*").alias("alerts"), F.countDistinct("user").alias("users"), F.countDistinct("day").alias("days")).join(events.agg(F.count("*").alias("events")), one).join(records_.agg(F.count("*").alias("incidents"), F.countDistinct("incident_id").alias("distinct_ids")), one)
