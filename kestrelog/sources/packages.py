"""Incidents and alert packages as files: JSON lines in and out, checked as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelog.operators.incidents import RANKS

INCIDENT_SCHEMA = "incident_id string, user string, start long, end long, priority string, max_score double, references string"
_LINE = f"{INCIDENT_SCHEMA}, _corrupt string"


def write_incidents(incidents: DataFrame, path: str) -> None:
    """One JSON object a line."""
    incidents.write.json(path)


def incident_problems(spark: SparkSession, path: str) -> DataFrame:
    """(line, incident_id, problem) of what keeps a file of incidents from being read: broken JSON, missing or wrong fields, repeated ids."""
    rows = _lines(spark, path)
    text = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    problem = (
        F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "invalid_json").when(text("r.incident_id"), "no_incident_id").when(text("r.user"), "no_user")
        .when(F.col("r.start").isNull() | F.col("r.end").isNull() | (F.col("r.start") < 1) | (F.col("r.end") <= F.col("r.start")), "bad_range")
        .when(~F.coalesce(F.col("r.priority"), F.lit("")).isin(RANKS), "bad_priority").when(F.col("r.max_score").isNotNull() & ~F.col("r.max_score").between(0, 1), "bad_score")
    )
    each = rows.select("line", F.col("r.incident_id").alias("incident_id"), problem.alias("problem")).where("problem is not null")
    twice = rows.where("trim(r.incident_id) <> ''").groupBy(F.col("r.incident_id").alias("incident_id")).agg(F.count("*").alias("n")).where("n > 1")
    return each.union(twice.select(F.lit(None).cast("string"), "incident_id", F.lit("duplicate_incident_id")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(F.col("value").alias("line"), F.from_json("value", _LINE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The incidents of a file of JSON lines; fails with the first problems if there are any."""
    problems = [f"{r.problem}: {r.incident_id}" for r in incident_problems(spark, path).limit(5).collect()]
    if problems:
        raise ValueError("; ".join(problems))
    return _lines(spark, path).select("r.*").drop("_corrupt")


def write_package(alerts: DataFrame, events: DataFrame, incidents: DataFrame, path: str, split: str) -> None:
    """An alert package's three outputs under path: alerts and their events as Parquet, incidents as JSON lines. The test split is refused."""
    if split == "test":
        raise ValueError("no package is made of the test split")
    alerts.write.parquet(f"{path}/alerts")
    events.write.parquet(f"{path}/events")
    write_incidents(incidents, f"{path}/incidents")


def package_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row about a written package: rows of each output, and references of incidents that its events lack."""
    alerts, events = spark.read.parquet(f"{path}/alerts"), spark.read.parquet(f"{path}/events")
    incidents = _lines(spark, f"{path}/incidents").select("r.*")
    wanted = incidents.select(F.explode(F.split("references", " ")).alias("x")).select(F.substring_index("x", ":", -1).cast("long").alias("source_line"))
    one = F.lit(True)  # each side is one row
    return (
        alerts.agg(F.count("*").alias("alerts")).join(events.agg(F.count("*").alias("events")), one).join(incidents.agg(F.count("*").alias("incidents"), F.countDistinct("incident_id").alias("distinct_ids")), one)
        .join(wanted.join(events.select("source_line").distinct(), "source_line", "left_anti").agg(F.count("*").alias("unresolved")), one)
    )


def one_unit(scores: DataFrame, user: str, hour: int) -> DataFrame:
    """The stored row of one unit, no row if it is unknown; fails if the unit is stored twice."""
    found = scores.where((F.col("user") == user) & (F.col("hour") == hour))
    if found.limit(2).count() > 1:
        raise ValueError(f"unit {user} {hour} is stored twice")
    return found


def stored_alerts(scores: DataFrame, threshold: float) -> DataFrame:
    """Stored rows that are alerts, by their own flag or else by the threshold."""
    flag = F.col("score") >= threshold
    return scores.where(F.coalesce(F.col("is_alert"), flag) if "is_alert" in scores.columns else flag)
