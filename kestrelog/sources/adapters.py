"""The authentication log, its labels and detector scores, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelog.functions.accounts import is_machine
from kestrelog.functions.clock import DAY, day_of, hour_start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an authentication log; seconds count from 2024-01-01 and do not depend on a time zone."""
    ts, u = F.col("ts"), F.col("user_id")
    seconds = (F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")) * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) + 1).cast("long")
    name = F.concat(F.lit("U"), u.cast("string"), F.when(u % 10 == 0, "$").otherwise(""), F.lit("@DOM1"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long").alias("k"), seconds.alias("t"), name.alias("named"))
    k, t, named = F.col("k"), F.col("t"), F.col("named")
    pick = lambda col, values: F.element_at(F.array(*map(F.lit, values)), (col + 1).cast("int"))
    return e.select(
        t.alias("timestamp"),
        (F.col("event_id") + 1).alias("source_line"),
        named.alias("source_user"),
        F.concat(F.lit("U"), ((u * 7 + k) % 150).cast("string"), F.lit("@DOM1")).alias("destination_user"),
        F.concat(F.lit("C"), ((u + k % 3) % 40).cast("string")).alias("source_computer"),
        F.concat(F.lit("C"), (100 + k).cast("string")).alias("destination_computer"),
        pick(k % 4, ["NTLM", "Kerberos", "Negotiate", "?"]).alias("authentication_type"),
        F.when(F.col("event_type").isin("view", "purchase", "error"), "Network").when(F.col("event_type") == "click", "Interactive").otherwise("?").alias("logon_type"),
        pick(k % 5, ["LogOn", "LogOff", "TGS", "TGT", "AuthMap"]).alias("authentication_orientation"),
        F.when(F.col("event_type") == "error", "Fail").otherwise("Success").alias("authentication_result"),
        named.alias("acting_user"),
        day_of(t).alias("dataset_day"),
    )


def red_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: purchases above 150, as (timestamp, user, source_computer, destination_computer, source_line)."""
    rare = table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 150").select((F.col("event_id") + 1).alias("source_line"))
    return auth_events(spark, sf_dir).join(rare, "source_line").select("timestamp", F.col("acting_user").alias("user"), "source_computer", "destination_computer", "source_line")


def log_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The log as text lines (source_line, raw, and more of the events' columns), some of them broken: every 97th lacks a field, every 101st has no number, every 103rd an empty field."""
    a, line = auth_events(spark, sf_dir), F.col("source_line")
    fields = ["source_user", "destination_user", "source_computer", "destination_computer", "authentication_type", "logon_type", "authentication_orientation"]
    raw = F.concat_ws(
        ",",
        F.when(line % 101 == 0, F.lit("x")).otherwise(F.col("timestamp").cast("string")),
        *fields[:6],
        F.when(line % 103 == 0, F.lit("")).otherwise(F.col(fields[6])),
        F.when(line % 97 == 0, F.lit(None)).otherwise(F.col("authentication_result")),
    )
    return a.select("source_line", raw.alias("raw"), *more)


def hour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of user-hours from the counts, for the operators that take scores: (user, hour, day, seq_score, graph_score, is_machine, tie)."""
    a = auth_events(spark, sf_dir)
    g = a.groupBy(F.col("acting_user").alias("user"), hour_start(F.col("timestamp")).alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.col("authentication_result") == "Fail").alias("fails"), F.countDistinct("destination_computer").alias("dests"), F.min("source_line").alias("tie")
    )
    seq = F.round((F.col("n") + 3 * F.col("fails")) / (F.col("n") + 3 * F.col("fails") + 4.0), 6)
    graph = F.round((F.col("dests") + F.col("tie") % 7) / (F.col("dests") + F.col("tie") % 7 + 3.0), 6)
    return g.select("user", "hour", day_of(F.col("hour")).alias("day"), seq.alias("seq_score"), graph.alias("graph_score"), is_machine(F.col("user")).alias("is_machine"), "tie")


#: Data components of the derived catalogue.
COMPONENTS = ["Active Directory Credential Request", "Logon Session Creation", "Logon Session Metadata", "User Account Authentication", "File Access", "Network Traffic Flow"]


def stix_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as STIX objects, a JSON text each (value): a technique, a detection strategy, an analytic and relations for every document, and shared components.

    Some of each are revoked or deprecated; every fifth analytic names components that logs of logons can't show.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    i = F.col("i")
    named = lambda kind, n: F.concat(F.lit(f"{kind}--"), n.cast("string"))
    number = F.concat(F.lit("T"), (1000 + F.floor(i / 1000)).cast("string"), F.lit("."), F.lpad((i % 1000).cast("string"), 3, "0"))
    ref = lambda source, x, url: F.struct(F.lit(source).alias("source_name"), x.alias("external_id"), F.concat(F.lit(url), x).alias("url"))
    phase = lambda chain, x: F.struct(F.lit(chain).alias("kill_chain_name"), x.alias("phase_name"))
    part = lambda n: F.when(i % 5 == 0, 4 + n).otherwise((i + 2 * n) % 6)
    log = lambda n, name, channel: F.struct(named("x-mitre-data-component", part(n)).alias("x_mitre_data_component_ref"), F.lit(name).alias("name"), F.lit(channel).cast("string").alias("channel"))
    relation = lambda kind, to, revoked: F.struct(F.lit("relationship").alias("type"), F.lit(kind).alias("relationship_type"), named(f"relationship--{kind}", i).alias("id"), named("x-mitre-detection-strategy", i).alias("source_ref"), named("attack-pattern", to).alias("target_ref"), revoked.alias("revoked"))
    technique = F.struct(
        F.lit("attack-pattern").alias("type"),
        named("attack-pattern", i).alias("id"),
        F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("name"),
        F.concat("text", F.lit(" (Citation: X "), i.cast("string"), F.lit(") [page](http://x)")).alias("description"),
        (i % 17 == 0).alias("revoked"),
        F.when(i % 19 == 0, True).alias("x_mitre_deprecated"),
        F.array(ref("other", i.cast("string"), "http://other/"), ref("mitre-attack", number, "http://techniques/")).alias("external_references"),
        F.array(phase("mitre-attack", F.coalesce("lang", F.lit("none"))), phase("other-chain", F.lit("x")), phase("mitre-attack", F.lit("access"))).alias("kill_chain_phases"),
        F.array(F.coalesce("source", F.lit("none"))).alias("x_mitre_platforms"),
        F.lit(True).alias("x_mitre_is_subtechnique"),
        F.lit("1.0").alias("x_mitre_version"),
    )
    strategy = F.struct(F.lit("x-mitre-detection-strategy").alias("type"), named("x-mitre-detection-strategy", i).alias("id"), (i % 13 == 0).alias("revoked"), F.array(named("x-mitre-analytic", i), named("x-mitre-analytic", i + 1)).alias("x_mitre_analytic_refs"))
    analytic = F.struct(F.lit("x-mitre-analytic").alias("type"), named("x-mitre-analytic", i).alias("id"), (i % 11 == 0).alias("x_mitre_deprecated"), F.array(log(0, "Windows", "Security"), log(1, "Linux", None)).alias("x_mitre_log_source_references"))
    parts = [technique, strategy, analytic, relation("detects", i, i % 23 == 0), relation("uses", i + 1, F.lit(False))]
    objects = docs.select(F.explode(F.array(*map(F.to_json, parts))).alias("value"))
    shared = [(f"x-mitre-data-component--{k}", "x-mitre-data-component", c, None) for k, c in enumerate(COMPONENTS)] + [("x-mitre-collection--1", "x-mitre-collection", "Techniques", "7.1")]
    shared = spark.createDataFrame(shared, "id string, type string, name string, x_mitre_version string")
    return objects.union(shared.select(F.to_json(F.struct("*")).alias("value")))
