"""Checks of replies against the events they cite: techniques by rule, claims by the names they use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelog.functions.accounts import mentioned

SUPPORTED, UNCERTAIN, REJECTED = "Supported", "Uncertain", "Rejected"


def logon() -> Column:
    return F.col("authentication_orientation") != "LogOff"


def to_new_destination() -> Column:
    return logon() & (F.col("is_new_user_destination") | F.col("is_new_host_connection"))


@dataclass(frozen=True)
class Rule:
    """What cited events must show. best is the strongest verdict the pattern allows; weaker a partial pattern that leaves it uncertain."""

    shows: Column
    weaker: Column | None = None
    best: str = SUPPORTED
    least: int = 1


def rules() -> dict[str, Rule]:
    """The rule of each technique; a sub-technique without one takes its parent's, and is uncertain at best."""
    failed = F.col("authentication_result") == "Fail"
    ok = F.col("authentication_result") == "Success"
    kind, how = F.col("authentication_type"), F.col("logon_type")
    network = (how == "Network") & to_new_destination()
    return {
        "T1110": Rule(failed, least=3),
        "T1110.001": Rule(failed, least=3),
        "T1110.003": Rule(failed, best=UNCERTAIN),
        "T1110.004": Rule(failed, best=UNCERTAIN),
        "T1550": Rule(kind.isin("NTLM", "Kerberos") & network, best=UNCERTAIN),
        "T1550.002": Rule((kind == "NTLM") & network, weaker=(kind == "NTLM") & logon()),
        "T1550.003": Rule((kind == "Kerberos") & network, best=UNCERTAIN),
        "T1021": Rule(network, weaker=logon() & (how == "Network")),
        "T1021.001": Rule((how == "RemoteInteractive") & to_new_destination(), weaker=(how == "RemoteInteractive") & logon()),
        "T1078": Rule(ok & logon() & (F.col("is_new_user_source") | to_new_destination()), weaker=ok & logon()),
        "T1558": Rule(F.col("authentication_orientation").isin("TGS", "TGT"), best=UNCERTAIN),
    }


#: Techniques that logon records cannot show.
KNOWN_FALSE = ["T1556.004", "T1110.002"]


def technique_verdicts(cited: DataFrame, events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """cited (incident_id, technique, source_line), the events of the packages, and catalogue (technique, parent, observable) -> verdicts.

    A citation is broken if the incident's package has no such event; broken ones leave a
    technique uncertain at best. Rejected: not in the catalogue, no cited event, known to be
    false, no data source in logs, or nothing that the rule asks for. Repeated citations count once.
    """
    known = rules()
    keys = ["incident_id", "technique"]
    j = cited.select(*keys, "source_line").distinct().join(events.withColumn("held", F.lit(True)), ["incident_id", "source_line"], "left")
    j = j.join(F.broadcast(catalogue.select("technique", "parent", "observable", F.lit(True).alias("listed"))), "technique", "left")  # a row for each technique of the catalogue
    own = F.col("technique").isin(*known)
    j = j.withColumn("rule", F.when(own, F.col("technique")).when(F.col("parent").isin(*known), F.col("parent")))

    def by_rule(pick) -> Column:
        out = F.lit(None).cast("boolean")
        for name, rule in known.items():
            if (value := pick(rule)) is not None:
                out = F.when(F.col("rule") == name, value).otherwise(out)
        return out

    held = F.col("held").isNotNull()
    g = j.groupBy(*keys).agg(
        F.count_if(~held).alias("broken"), F.count_if(held).alias("cited"), F.count_if(by_rule(lambda r: r.shows)).alias("matching"), F.coalesce(F.bool_or(by_rule(lambda r: r.weaker)), F.lit(False)).alias("partly"),
        F.first("rule").alias("rule"), F.coalesce(F.first("listed"), F.lit(False)).alias("listed"), F.coalesce(F.first("observable"), F.lit(False)).alias("observable"),
    )
    least, best = F.lit(1), F.lit(SUPPORTED)
    for name, rule in known.items():
        least = F.when(F.col("rule") == name, rule.least).otherwise(least)
        best = F.when(F.col("rule") == name, rule.best).otherwise(best)
    reason = (
        F.when(~F.col("listed"), "unknown_technique").when(F.col("cited") == 0, "no_cited_event").when(F.col("technique").isin(*KNOWN_FALSE), "known_false").when(~F.col("observable"), "no_data_source")
        .when(F.col("rule").isNull(), "no_rule").when(F.col("matching") >= least, "rule_met").when(F.col("matching") > 0, "too_few_events").when(F.col("partly"), "weaker_form").otherwise("no_matching_event")
    )
    g = g.withColumn("reason", reason)
    capped = (F.col("rule") != F.col("technique")) | (F.col("broken") > 0)
    verdict = (
        F.when(F.col("reason").isin("no_rule", "too_few_events", "weaker_form"), UNCERTAIN)
        .when(F.col("reason") == "rule_met", F.when(capped, UNCERTAIN).otherwise(best))
        .otherwise(REJECTED)
    )
    return g.select(*keys, "broken", "cited", "matching", verdict.alias("verdict"), "reason")


def claim_verdicts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims (incident_id, claim, text, lines) against facts (incident_id, source_line, entities), letter case aside.

    Facts without a line hold for every claim of the incident. unsupported: no valid citation, or
    a name that no fact of the incident has. partly_supported: a name that only other facts have,
    or a broken citation. A package has a bounded number of facts, so they are gathered.
    """
    keys = ["incident_id", "claim"]
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    low = facts.select("incident_id", "source_line", lower(F.col("entities")).alias("entities"))
    package = low.groupBy("incident_id").agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("all"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("source_line").isNull(), F.col("entities"))))).alias("always"))
    cited = claims.select(*keys, F.explode(F.array_distinct("lines")).alias("source_line")).join(low.where("source_line is not null"), ["incident_id", "source_line"], "left")
    cited = cited.groupBy(*keys).agg(F.count("entities").alias("valid"), F.count_if(F.col("entities").isNull()).alias("broken"), F.flatten(F.collect_list("entities")).alias("near"))
    none = F.array().cast("array<string>")
    j = claims.join(cited, keys, "left").join(package, "incident_id", "left")
    names = lower(mentioned(F.col("text")))
    j = j.withColumn("missing", F.array_except(names, F.concat(F.coalesce("near", none), F.coalesce("always", none))))
    j = j.withColumns({"nowhere": F.array_except("missing", F.coalesce("all", none)), "valid": F.coalesce("valid", F.lit(0)), "broken": F.coalesce("broken", F.lit(0))})
    verdict = F.when((F.col("valid") == 0) | (F.size("nowhere") > 0), "unsupported").when((F.size("missing") > 0) | (F.col("broken") > 0), "partly_supported").otherwise("supported")
    return j.select(*keys, verdict.alias("verdict"), F.array_join(F.sort_array("missing"), ",").alias("missing"), "broken")


def outcomes(verdicts: DataFrame) -> DataFrame:
    """Per incident: what verification leaves and takes out, and the outcome by the best verdict left."""
    has = lambda v: F.count_if(F.col("verdict") == v)
    g = verdicts.groupBy("incident_id").agg(has(SUPPORTED).alias("supported"), has(UNCERTAIN).alias("uncertain"), has(REJECTED).alias("removed"))
    outcome = F.when(F.col("supported") > 0, "supported_mapping").when(F.col("uncertain") > 0, "uncertain_mapping").otherwise("no_supported_mapping")
    return g.withColumns({"outcome": outcome, "emptied": (F.col("removed") > 0) & (F.col("supported") + F.col("uncertain") == 0)})


JUDGEMENTS = ["Supported", "Uncertain", "No supported mapping"]


def label_problems(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """Reviewers' rows (row, incident_id, judgement, technique) against the sampled incidents -> every problem, (row or null, incident_id, problem)."""
    none = JUDGEMENTS[2]
    technique = F.upper(F.coalesce("technique", F.lit("")))
    known = rows.join(sample.select("incident_id").distinct().withColumn("known", F.lit(True)), "incident_id", "left").withColumn("technique", technique)
    fine = F.col("technique").rlike(r"^T[0-9]{4}(\.[0-9]{3})?$")
    problem = (
        F.when(F.col("known").isNull(), "unknown_incident").when(~F.col("judgement").isin(*JUDGEMENTS) | F.col("judgement").isNull(), "bad_judgement")
        .when((F.col("judgement") == none) & (F.col("technique") != ""), "technique_without_mapping").when((F.col("judgement") != none) & ~fine, "malformed_technique")
    )
    checked = known.withColumn("problem", problem)
    each = checked.where("problem is not null").select("row", "incident_id", "problem")
    counted = checked.where((F.col("problem").isNull()) | (F.col("problem") == "technique_without_mapping"))
    mapped = counted.where(F.col("judgement") != none)
    both = mapped.groupBy("incident_id", "technique").agg(F.countDistinct("judgement").alias("n")).where("n > 1").select("incident_id").distinct()
    mixed = counted.groupBy("incident_id").agg(F.bool_or(F.col("judgement") == none).alias("none"), F.bool_or(F.col("judgement") != none).alias("some")).where("none and some").select("incident_id")
    missing = sample.select("incident_id").distinct().join(counted.select("incident_id").union(known.where("known and judgement in ('Supported', 'Uncertain')").select("incident_id")), "incident_id", "left_anti")
    whole = lambda df, name: df.select(F.lit(None).cast("long").alias("row"), "incident_id", F.lit(name).alias("problem"))
    return each.union(whole(mixed, "mixes_mapping_and_none")).union(whole(both, "supported_and_uncertain")).union(whole(missing, "without_label"))


def per_mode(generated: DataFrame, checked: DataFrame, incidents: DataFrame, modes: list[str]) -> DataFrame:
    """For every incident and mode: the reply's status joined with its verification's outcome; without a reply it is pending.

    generated (incident_id, mode, status), checked (incident_id, mode, outcome). If nothing was generated at all, everything is not_generated.
    """
    wanted = incidents.select("incident_id").distinct().withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    empty = not generated.limit(1).count()
    status = F.lit("not_generated") if empty else F.coalesce(F.when(F.col("outcome").isNotNull(), "ok"), F.col("status"), F.lit("pending"))
    return wanted.join(generated, ["incident_id", "mode"], "left").join(checked, ["incident_id", "mode"], "left").select("incident_id", "mode", status.alias("status"), "outcome")


def link_techniques(groups: DataFrame, cited: DataFrame) -> DataFrame:
    """Time groups (incident_id, group, lines) with the techniques (incident_id, technique, lines) whose cited events they share."""
    met = groups.join(cited.withColumnRenamed("lines", "cited"), "incident_id").where(F.arrays_overlap("lines", "cited"))
    named = met.groupBy("incident_id", "group").agg(F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques"))
    return groups.select("incident_id", "group").join(named, ["incident_id", "group"], "left").withColumn("techniques", F.coalesce("techniques", F.lit("")))


def run_summary(replies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per mode: replies, those that are ok, mapped techniques by verdict, and distinct technique ids; replies (incident_id, mode, status), verdicts (incident_id, mode, technique, verdict)."""
    r = replies.groupBy("mode").agg(F.count("*").alias("replies"), F.count_if(F.col("status") == "ok").alias("ok"))
    has = lambda v: F.count_if(F.col("verdict") == v)
    v = verdicts.groupBy("mode").agg(F.count("*").alias("mapped"), F.countDistinct("technique").alias("techniques"), F.countDistinct("incident_id").alias("with_techniques"), has(SUPPORTED).alias("supported"), has(UNCERTAIN).alias("uncertain"), has(REJECTED).alias("rejected"))
    zero = {c: 0 for c in ("mapped", "techniques", "with_techniques", "supported", "uncertain", "rejected")}
    return r.join(v, "mode", "left").fillna(zero)


# Techniques that the registered queries map events to: (technique, parent, observable in logs).
CATALOGUE = [
    ("T1110", None, True), ("T1110.001", "T1110", True), ("T1110.002", "T1110", True), ("T1110.003", "T1110", True), ("T1110.004", "T1110", True),
    ("T1550", None, True), ("T1550.002", "T1550", True), ("T1550.003", "T1550", True), ("T1550.004", "T1550", True), ("T1021", None, True), ("T1021.001", "T1021", True), ("T1021.002", "T1021", True),
    ("T1078", None, True), ("T1078.002", "T1078", True), ("T1558", None, True), ("T1556.004", "T1556", True), ("T1003", None, False), ("T1136", None, True),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "technique string, parent string, observable boolean")
