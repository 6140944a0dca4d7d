"""Behaviours of incidents, technique retrieval, evidence packages, and checks of replies by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions import spans, tables

REFERENCES = 20
RULE_EVENTS, PACKAGE_EVENTS = 40, 60
RULES = ["failed_logons", "ntlm_logon_to_new_destination", "network_logon_to_new_destination", "logon_from_new_source"]


def not_logoff() -> Column:
    """Log-offs are recorded on the machine being left, so they never count as new."""
    return F.col("authentication_orientation") != "LogOff"


def rule_columns() -> dict[str, Column]:
    """The behaviour rules as conditions on events; a destination is new to the user or to the source computer."""
    network = (F.col("logon_type") == "Network") & (F.col("is_new_user_destination") | F.col("is_new_host_connection")) & not_logoff()
    return {
        "failed_logons": F.col("authentication_result") == "Fail",
        "ntlm_logon_to_new_destination": (F.col("authentication_type") == "NTLM") & network,
        "network_logon_to_new_destination": network,
        "logon_from_new_source": F.col("is_new_user_source") & not_logoff(),
    }


def rule_matches(events: DataFrame) -> DataFrame:
    """One row per event and rule that it meets, with the rule's index."""
    tests = F.array(*[F.when(c, F.struct(F.lit(i).alias("rule_index"), F.lit(n).alias("rule"))) for i, (n, c) in enumerate(rule_columns().items())])
    return events.withColumn("__m", F.explode(F.array_compact(tests))).select("*", "__m.rule_index", "__m.rule").drop("__m")


def observed(events: DataFrame, limit: int = REFERENCES) -> DataFrame:
    """Per incident and rule: events, the first references in time order, whether they were cut."""
    w = Window.partitionBy("incident_id", "rule").orderBy("timestamp", "source_line")
    m = rule_matches(events).withColumn("__n", F.row_number().over(w))
    lines = F.sort_array(F.collect_list(F.when(F.col("__n") <= limit, F.struct("__n", "source_line"))))
    return m.groupBy("incident_id", "rule").agg(F.count("*").alias("events"), F.concat_ws(" ", F.transform(lines, lambda x: x["source_line"].cast("string"))).alias("lines"), (F.count("*") > limit).alias("truncated"))


def event_flags() -> Column:
    """Plain-language flags of an event."""
    new = lambda c: F.col(c) & not_logoff()
    return F.concat_ws("; ", F.array_compact(F.array(
        F.when(new("is_new_user_destination"), "user is new at this computer"), F.when(new("is_new_host_connection"), "computers are new to each other"),
        F.when(new("is_new_user_source"), "user is new at this source"), F.when(F.col("authentication_result") == "Fail", "failed"),
    )))


def select_events(events: DataFrame, rule_limit: int = RULE_EVENTS, total: int = PACKAGE_EVENTS) -> DataFrame:
    """The events of an incident's package: up to rule_limit round-robin over rules, then an even sample in time up to total."""
    per_rule = Window.partitionBy("incident_id", "rule").orderBy("timestamp", "source_line")
    m = rule_matches(events).withColumn("__p", F.row_number().over(per_rule) - 1)
    once = m.groupBy("incident_id", "source_line").agg(F.min(F.struct("__p", "rule_index")).alias("o"))
    taken = once.withColumn("__n", F.row_number().over(Window.partitionBy("incident_id").orderBy("o", "source_line"))).where(F.col("__n") <= rule_limit).select("incident_id", "source_line", F.lit("rule").alias("why"))
    used = taken.groupBy("incident_id").agg(F.count("*").alias("used"))
    others = events.join(once.select("incident_id", "source_line"), ["incident_id", "source_line"], "left_anti").join(used, "incident_id", "left")
    w = Window.partitionBy("incident_id")
    others = others.withColumns({"i": F.row_number().over(w.orderBy("timestamp", "source_line")) - 1, "n": F.count("*").over(w), "room": F.lit(total) - F.coalesce("used", F.lit(0))})
    # index i is kept if some step k of room - 1 rounds (half to even) to it
    step = (F.col("n") - 1) / F.greatest(F.col("room") - 1, F.lit(1))
    near = F.floor(F.col("i") / step)
    kept = F.exists(F.array(near - 1, near, near + 1), lambda k: (k >= 0) & (k < F.col("room")) & (F.bround(k * step) == F.col("i")))
    sampled = others.where((F.col("n") <= F.col("room")) | ((F.col("room") == 1) & (F.col("i") == 0)) | ((F.col("room") > 1) & kept))
    return taken.union(sampled.select("incident_id", "source_line", F.lit("sample").alias("why")))


def value_counts(events: DataFrame, column: str, name: str) -> DataFrame:
    """Per incident the values of a column with their counts, as value:n, the most frequent first. Few values are expected."""
    n = events.groupBy("incident_id", F.col(column).alias("v")).agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "v")))
    return n.groupBy("incident_id").agg(F.concat_ws(" ", F.transform(order, lambda x: F.concat_ws(":", x["v"], (-x["n"]).cast("string")))).alias(name))


def event_counts(events: DataFrame, top: int = 5) -> DataFrame:
    """Per incident: events by type, failures, distinct hosts, first times, and the top destinations (ties by first seen). Log-offs are neither first times nor destinations reached."""
    new = lambda c: F.count_if(F.col(c) & not_logoff())
    g = events.groupBy("incident_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("authentication_result") == "Fail").alias("failures"), F.countDistinct("source_computer").alias("sources"), F.countDistinct("destination_computer").alias("destinations"),
        new("is_new_user_destination").alias("new_destinations"), new("is_new_host_connection").alias("new_hosts"), new("is_new_user_source").alias("new_sources"),
    )
    d = events.where(not_logoff()).groupBy("incident_id", "destination_computer").agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "source_line")).alias("first"))
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("n"), "first"))).where(F.col("r") <= top)
    listed = d.groupBy("incident_id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("r", "destination_computer", "n"))), lambda x: F.concat_ws(":", x["destination_computer"], x["n"].cast("string")))).alias("top_destinations"))
    for column, name in (("authentication_type", "by_auth_type"), ("logon_type", "by_logon_type"), ("authentication_orientation", "by_orientation")):
        g = g.join(value_counts(events, column, name), "incident_id")
    return g.join(listed, "incident_id", "left").withColumn("top_destinations", F.coalesce("top_destinations", F.lit("")))


def host_pairs(events: DataFrame) -> DataFrame:
    """Per incident and host pair: events, failures, authentication types, the three kinds of novelty (log-offs aside), first line and time; novel pairs first."""
    new = lambda c: F.bool_or(F.col(c) & not_logoff())
    known = F.when(F.col("authentication_type") == "?", "unknown").otherwise(F.col("authentication_type"))
    g = events.groupBy("incident_id", "source_computer", "destination_computer").agg(
        F.count("*").alias("events"), F.count_if(F.col("authentication_result") == "Fail").alias("failures"), F.array_join(F.array_sort(F.collect_set(known)), ", ").alias("types"),
        new("is_new_user_destination").alias("new_destination"), new("is_new_host_connection").alias("new_pair"), new("is_new_user_source").alias("new_source"),
        F.min_by("source_line", F.struct("timestamp", "source_line")).alias("first_line"), F.min("timestamp").alias("first"),
    )
    g = g.withColumn("novel", F.col("new_destination") | F.col("new_pair") | F.col("new_source"))
    return g.orderBy("incident_id", F.desc("novel"), "first", "source_computer", "destination_computer")


def first_time_counts(pairs: DataFrame) -> DataFrame:
    """Per incident: pairs with any novelty, how many of them used NTLM, and all destinations."""
    ntlm = F.col("types").contains("NTLM")
    return pairs.groupBy("incident_id").agg(F.count_if("novel").alias("first_time_pairs"), F.count_if(F.col("novel") & ntlm).alias("with_ntlm"), F.countDistinct(F.when(F.col("novel"), F.col("destination_computer"))).alias("first_time_destinations"), F.countDistinct("destination_computer").alias("destinations"))


def histogram(events: DataFrame, incidents: DataFrame, width: int) -> DataFrame:
    """Events per bin over an incident's span (start, end); empty bins are 0 and the last is cut at the end."""
    bins = incidents.select("incident_id", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start")) / width) - 1))).alias("bin"))
    n = events.join(incidents.select("incident_id", "start"), "incident_id").groupBy("incident_id", F.floor((F.col("timestamp") - F.col("start")) / width).alias("bin")).agg(F.count("*").alias("events"))
    return bins.join(n, ["incident_id", "bin"], "left").select("incident_id", "bin", (F.col("start") + F.col("bin") * width).alias("from"), F.least(F.col("start") + (F.col("bin") + 1) * width, F.col("end")).alias("to"), F.coalesce("events", F.lit(0)).alias("events"))


def next_after(points: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """points (keys, t), distinct -> with `next`: the least t of the same keys that is more than `seconds` later, or null.

    Time is cut into bins of that width. What is sought lies in the next bin, or is the first point of a
    later one; so a window sees the points of one bin, and another a row for each bin.
    """
    bin_ = F.floor((F.col("t") - 1) / seconds)
    points = points.withColumn("__bin", bin_)
    order = Window.partitionBy(*keys).orderBy("__bin")
    ahead = {f"__{what}{k}": F.lead(what, k).over(order) for k in (1, 2) for what in ("__bin", "first")}
    bins = points.groupBy(*keys, "__bin").agg(F.min("t").alias("first")).withColumns(ahead)
    asked = points.select(*keys, (F.col("t") + seconds).alias("__x"), (F.col("__bin") + 1).alias("__in"), F.lit(True).alias("__asks"))
    there = points.select(*keys, F.col("t").alias("__x"), F.col("__bin").alias("__in"), F.lit(False).alias("__asks"))
    later = Window.partitionBy(*keys, "__in").orderBy(F.desc("__x"), F.desc("__asks")).rowsBetween(Window.unboundedPreceding, -1)
    near = asked.union(there).withColumn("near", F.min(F.when(~F.col("__asks"), F.col("__x"))).over(later)).where("__asks")
    near = near.select(*keys, (F.col("__x") - seconds).alias("t"), (F.col("__in") - 1).alias("__bin"), "near")
    far = F.when(F.col("____bin1") == F.col("__bin") + 1, F.col("__first2")).otherwise(F.col("__first1"))
    return near.join(bins, [*keys, "__bin"]).select(*keys, "t", F.coalesce("near", far).alias("next"))


def anchors(points: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """points (keys, t) -> the first times of groups: the least t, and from each the next that is more than `seconds` later.

    Links are followed by pointer doubling: each round joins what was reached with links of twice the length.
    """
    points = tables.stored(points.select(*keys, "t").distinct(), "anchor-points")
    links = tables.stored(next_after(points, keys, seconds).where("next is not null"), "anchor-links")
    reached = tables.stored(points.groupBy(*keys).agg(F.min("t").alias("t")), "anchors")
    while True:
        new = tables.stored(reached.join(links, [*keys, "t"]).select(*keys, F.col("next").alias("t")), "anchors")
        if new.isEmpty():
            return reached
        reached = reached.union(new)
        further = links.select(*keys, F.col("t").alias("next"), F.col("next").alias("__then"))
        links = tables.stored(links.join(further, [*keys, "next"]).select(*keys, "t", F.col("__then").alias("next")), "anchor-links")


def anchored_groups(items: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """items (keys, t) -> (keys, anchor, last, n): an item joins a group while within `seconds` of its first item. Rows without a time are left out."""
    items = items.select(*keys, "t").where("t is not null")
    first = anchors(items, keys, seconds).select(*keys, F.col("t").alias("start"), (F.col("t") + seconds + 1).alias("end"))
    met = spans.points_within(first, items, keys, seconds, "t")
    return met.groupBy(*keys, F.col("start").alias("anchor")).agg(F.max("t").alias("last"), F.count("*").alias("n"))


# ---- text retrieval ----


def clean_description(text: Column) -> Column:
    """Without citations and link targets; runs of blanks and tabs become one blank, ends are trimmed."""
    no_cites = F.regexp_replace(text, r"\s*\(Citation:[^)]*\)", "")
    links = F.regexp_replace(no_cites, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(F.regexp_replace(links, r"[ \t]+", " "), r"^\s+|\s+$", "")


def candidates(behaviours: DataFrame, hits: DataFrame) -> DataFrame:
    """Per incident: the best score of each technique over its behaviours, and those behaviours."""
    joined = behaviours.select("incident_id", "rule").join(hits.withColumnRenamed("query", "rule"), "rule")
    return joined.groupBy("incident_id", "id").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("behaviours"))


# ---- checks of replies ----

REPLY_SCHEMA = "summary string, claims array<struct<id:string, text:string, citations:array<string>>>, techniques array<struct<id:string, citations:array<string>>>"


def validate_replies(replies: DataFrame) -> DataFrame:
    """(incident_id, mode, reply JSON) -> problems: what a reply lacks, in a fixed order."""
    r = F.from_json("reply", REPLY_SCHEMA)
    checked = replies.withColumn("r", r)
    tests = F.array(
        F.when(F.col("r").isNull() | (F.col("r.summary").isNull() & F.col("r.claims").isNull() & F.col("r.techniques").isNull()), "not_json"),
        F.when(F.coalesce(F.trim("r.summary"), F.lit("")) == "", "no_summary"),
        F.when(F.coalesce(F.size("r.claims"), F.lit(-1)) < 1, "no_claims"),
        F.when(F.exists(F.coalesce("r.claims", F.array().cast("array<struct<id:string,text:string,citations:array<string>>>")), lambda c: F.coalesce(F.size(c["citations"]), F.lit(0)) < 1), "claim_without_citation"),
    )
    return checked.select("incident_id", "mode", F.array_join(F.array_compact(tests), ",").alias("problems"))


def answer_key_leaks(packages: DataFrame, names: list[str]) -> DataFrame:
    """Columns whose name, and rows whose text, tells the answer: both counts must be 0."""
    pattern = "(?i)" + "|".join(names)
    columns = sum(1 for c in packages.columns for n in names if n.lower() in c.lower())
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c, t in packages.dtypes if t in ("string", "bigint", "int", "double", "boolean")])
    return packages.agg(F.lit(columns).cast("long").alias("columns"), F.count_if(text.rlike(pattern)).alias("rows"))


def latest(records: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last record of each key."""
    return records.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(position)))).where("__n = 1").drop("__n")


def mode_scores(judged: DataFrame) -> DataFrame:
    """Per mode of (mode, incident_id, technique, verdict, label): valid, parent-valid, uncertain, unsupported, recall."""
    exact = F.col("technique") == F.col("label")
    parent = F.substring_index("technique", ".", 1) == F.substring_index("label", ".", 1)
    kept = F.col("verdict") != "Rejected"
    return judged.groupBy("mode").agg(
        F.count("*").alias("given"), F.count_if(kept & exact).alias("valid"), F.count_if(kept & parent & ~exact).alias("parent_only"), F.count_if(F.col("verdict") == "Uncertain").alias("uncertain"), F.count_if(kept & ~parent).alias("false_mappings"),
        F.countDistinct(F.when(kept & parent, F.col("incident_id"))).alias("incidents_hit"), F.countDistinct("incident_id").alias("incidents"),
    ).withColumn("recall", F.col("incidents_hit") / F.col("incidents"))


def _parents(techniques: Column) -> Column:
    return F.transform(techniques, lambda t: F.substring_index(t, ".", 1))


def judged(records: DataFrame, reference: DataFrame, catalogue: DataFrame) -> DataFrame:
    """records (mode, incident_id, ok, mapped) and reference (incident_id, supported, uncertain) -> a verdict for each mapped technique.

    In order: invalid_id, supported, uncertain, supported_parent, uncertain_parent, unsupported. Only incidents of the reference and replies that are ok count.
    """
    listed = catalogue.select("technique", F.lit(True).alias("listed")).distinct()
    each = records.where("ok").join(reference, "incident_id").withColumn("technique", F.explode("mapped")).join(tables.checked(listed), "technique", "left")
    parent, has = F.substring_index("technique", ".", 1), lambda c, x: F.array_contains(c, x)
    verdict = (
        F.when(F.col("listed").isNull(), "invalid_id").when(has("supported", F.col("technique")), "supported").when(has("uncertain", F.col("technique")), "uncertain")
        .when(has(_parents(F.col("supported")), parent), "supported_parent").when(has(_parents(F.col("uncertain")), parent), "uncertain_parent").otherwise("unsupported")
    )
    return each.select("mode", "incident_id", "technique", verdict.alias("verdict"))


def outcomes(records: DataFrame, reference: DataFrame, modes: DataFrame) -> DataFrame:
    """(mode, incident_id, label, outcome, wanted, found): what a mode made of each incident of the reference.

    label: mapped if the reviewers name any technique, else no_mapping; outcome: empty without a reply that is ok, abstained without
    a technique, else mapped. wanted counts the supported techniques, found those whose parent is mapped. modes (mode) are few.
    """
    held = reference.crossJoin(F.broadcast(modes.select("mode").distinct()))  # every mode is asked about every incident of the reference
    both = held.join(records, ["mode", "incident_id"], "left")
    label = F.when((F.size("supported") > 0) | (F.size("uncertain") > 0), "mapped").otherwise("no_mapping")
    outcome = F.when(~F.coalesce("ok", F.lit(False)), "empty").when(F.size("mapped") > 0, "mapped").otherwise("abstained")
    parents = _parents(F.when(outcome == "mapped", F.col("mapped")).otherwise(F.array().cast("array<string>")))
    found = F.size(F.filter(_parents(F.col("supported")), lambda t: F.array_contains(parents, t)))
    return both.select("mode", "incident_id", label.alias("label"), outcome.alias("outcome"), F.size("supported").alias("wanted"), found.alias("found"))


def review_scores(records: DataFrame, reference: DataFrame, catalogue: DataFrame) -> DataFrame:
    """A row for each mode: shares of mapped techniques by verdict, recall by parent, empty outputs, abstentions right and missed, mappings where none belongs. Null where nothing is counted."""
    modes = records.select("mode").distinct()
    verdicts = judged(records, reference, catalogue).groupBy("mode").agg(F.count("*").alias("mapped"), *[F.count_if(F.col("verdict").isin(*names)).alias(n) for n, names in {
        "valid": ("supported", "uncertain", "supported_parent", "uncertain_parent", "unsupported"), "strict": ("supported",), "by_parent": ("supported", "supported_parent"), "uncertain": ("uncertain",), "unsupported": ("unsupported", "invalid_id")}.items()])
    made = outcomes(records, reference, modes)
    kept, none = F.col("outcome") == "abstained", F.col("label") == "no_mapping"
    counts = made.groupBy("mode").agg(
        F.count("*").alias("incidents"), F.count_if(F.col("outcome") == "empty").alias("empty"), F.count_if(kept & (F.col("wanted") == 0)).alias("abstained_rightly"), F.count_if(kept & (F.col("wanted") > 0)).alias("abstained_wrongly"),
        F.count_if(none & (F.col("outcome") == "mapped")).alias("false_mappings"), F.count_if(none).alias("without_mapping"), F.sum("wanted").alias("wanted"), F.sum("found").alias("found"),
    )
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    rates = {f"{c}_rate": ratio(c, "mapped") for c in ("valid", "strict", "by_parent", "uncertain", "unsupported")}
    return counts.join(verdicts, "mode", "left").withColumns(rates | {"recall": ratio("found", "wanted"), "false_mapping_rate": ratio("false_mappings", "without_mapping")})


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of two reviewers' technique sets (incident_id, techniques), by parent."""
    parents = lambda c: F.array_distinct(F.transform(c, lambda t: F.substring_index(t, ".", 1)))
    j = a.join(b.withColumnRenamed("techniques", "other"), "incident_id").select(parents(F.col("techniques")).alias("x"), parents(F.col("other")).alias("y"))
    return j.agg(F.avg(F.when(F.size(F.array_union("x", "y")) == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")))).alias("agreement"), F.count("*").alias("incidents"))


def citation_summary(cited: DataFrame, events: DataFrame, sections: list[str], k: int) -> DataFrame:
    """cited (incident_id, item, reference) -> a row for each item: distinct references by kind, the first k entries, and how many more there are.

    A reference is an event if its line is among events (incident_id, source_line, timestamp), a package reference if it is one of
    sections, else unknown. Entries are event times first, those of one second as one with its number, then the other references by name.
    """
    from kestrelog.functions.accounts import reference_line

    each = cited.select("incident_id", "item", "reference").distinct().withColumn("source_line", reference_line(F.col("reference")))
    typed = each.join(events.select("incident_id", "source_line", "timestamp").distinct(), ["incident_id", "source_line"], "left")
    kind = F.when(F.col("timestamp").isNotNull(), 0).when(F.col("reference").isin(sections), 1).otherwise(2)
    entries = typed.withColumn("kind", kind).groupBy("incident_id", "item", "kind", "timestamp", F.when(kind > 0, F.col("reference")).alias("name")).agg(F.count("*").alias("n"))
    label = F.coalesce("name", F.concat_ws("x", F.col("timestamp").cast("string"), F.col("n").cast("string")))
    order = Window.partitionBy("incident_id", "item").orderBy("kind", "timestamp", "name")  # the citations of one item
    placed = entries.withColumn("place", F.row_number().over(order))
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= k, F.struct("place", label.alias("label")))))
    count = lambda x: F.coalesce(F.sum(F.when(F.col("kind") == x, F.col("n"))), F.lit(0)).alias
    return placed.groupBy("incident_id", "item").agg(count(0)("events"), count(1)("package"), count(2)("unknown"), F.array_join(F.transform(shown, lambda s: s["label"]), " ").alias("shown"), F.greatest(F.count("*") - k, F.lit(0)).alias("more"))


def quota_report(incidents: DataFrame, strata: dict[str, Column], sample: DataFrame, quota: int) -> DataFrame:
    """(stratum, quota, eligible, taken, unmet): how far a quota sample (stratum, incident_id) fills its strata."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("stratum"), F.coalesce(condition, F.lit(False)).alias("inside")) for name, condition in strata.items()])).alias("s")
    eligible = incidents.select(each).groupBy("s.stratum").agg(F.count_if("s.inside").alias("eligible"))
    taken = sample.groupBy("stratum").agg(F.count("*").alias("taken"))
    out = eligible.join(taken, "stratum", "left").withColumns({"quota": F.lit(quota), "taken": F.coalesce("taken", F.lit(0))})
    return out.select("stratum", "quota", "eligible", "taken", F.greatest(F.col("quota") - F.col("taken"), F.lit(0)).alias("unmet"))


def quota_sample(incidents: DataFrame, strata: dict[str, Column], quota: int, per_day: int, draw: Column) -> DataFrame:
    """Up to quota incidents of each stratum, at most per_day of a day in a stratum, by the draw."""
    out = None
    for name, condition in strata.items():
        w = Window.partitionBy("day").orderBy("draw", "incident_id")
        part = incidents.where(condition).withColumns({"stratum": F.lit(name), "draw": draw}).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_day).orderBy("draw", "incident_id").limit(quota)
        out = part if out is None else out.union(part)
    return out.drop("__n", "draw")
