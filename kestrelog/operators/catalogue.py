"""A technique catalogue from a STIX bundle, and what can be seen of it in authentication logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelog.functions import tables

from .behaviours import clean_description

#: Data components that authentication logs can show (fixed values).
AUTH_COMPONENTS = ["Active Directory Credential Request", "Logon Session Creation", "Logon Session Metadata", "User Account Authentication"]
#: The parts of STIX objects that are read.
STIX = (
    "id string, type string, name string, description string, revoked boolean, x_mitre_deprecated boolean, x_mitre_version string, modified string, relationship_type string, source_ref string, target_ref string, "
    "external_references array<struct<source_name: string, external_id: string, url: string>>, kill_chain_phases array<struct<kill_chain_name: string, phase_name: string>>, x_mitre_platforms array<string>, "
    "x_mitre_is_subtechnique boolean, x_mitre_analytic_refs array<string>, x_mitre_log_source_references array<struct<x_mitre_data_component_ref: string, name: string, channel: string>>"
)
TECHNIQUE_ID = r"^T[0-9]{4}(\.[0-9]{3})?$"


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """STIX objects from files with an object a line."""
    return spark.read.schema(STIX).json(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """STIX objects from bundles, one JSON document a file."""
    bundle = spark.read.schema(f"type string, objects array<struct<{STIX.replace(' string', ': string').replace(' boolean', ': boolean').replace(' array<', ': array<').replace(':: ', ': ')}>>").option("multiLine", True).json(path)
    return bundle.select(F.explode("objects").alias("o")).select("o.*")


def _active(prefix: str = "") -> Column:
    return ~F.coalesce(F.col(f"{prefix}revoked"), F.lit(False)) & ~F.coalesce(F.col(f"{prefix}x_mitre_deprecated"), F.lit(False))


def collection_info(objects: DataFrame) -> DataFrame:
    """(name, version, modified) of the bundle's one collection; fails if there is not exactly one."""
    found = objects.where("type = 'x-mitre-collection'").select("name", F.col("x_mitre_version").alias("version"), "modified")
    if found.limit(2).count() != 1:
        raise ValueError("a bundle has exactly one collection")
    return found


def detection_chain(objects: DataFrame) -> DataFrame:
    """(technique object, component or null, log source): a strategy detects a technique and names analytics, whose log sources name components.

    Strategies and analytics that are revoked or deprecated, and revoked relations, lead nowhere.
    """
    relations = objects.where("type = 'relationship' and relationship_type = 'detects'").where(~F.coalesce("revoked", F.lit(False))).select(F.col("source_ref").alias("strategy"), F.col("target_ref").alias("id"))
    held = objects.where(F.col("type") != "relationship").where(_active())
    strategies = held.select(F.col("id").alias("strategy"), F.explode("x_mitre_analytic_refs").alias("analytic"))
    analytics = held.select(F.col("id").alias("analytic"), F.explode("x_mitre_log_source_references").alias("log"))
    names = objects.where(F.col("type") != "relationship").select(F.col("id").alias("component"), F.col("name").alias("component_name"))
    chain = relations.join(strategies, "strategy").join(analytics, "analytic").withColumn("component", F.col("log.x_mitre_data_component_ref"))
    source = F.trim(F.concat("log.name", F.lit(" "), F.coalesce("log.channel", F.lit(""))))
    return chain.join(names, "component", "left").select("id", "component_name", source.alias("log_source"))


def extract_techniques(objects: DataFrame) -> DataFrame:
    """STIX objects -> active techniques with tactics, platforms, cleaned description, components and log sources that detect them.

    Fails if an active technique has no reference of the catalogue, a malformed id, or one that another has too.
    """
    mine = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    active = objects.where("type = 'attack-pattern'").where(_active()).withColumn("ref", F.get(mine, F.lit(0)))
    active = tables.stored(active, "techniques")
    technique = F.col("ref.external_id")
    if active.where(technique.isNull() | ~technique.rlike(TECHNIQUE_ID)).limit(1).count():
        raise ValueError("a technique lacks a well-formed id")
    if active.groupBy(technique).count().where("count > 1").limit(1).count():
        raise ValueError("two active techniques have one id")
    found = detection_chain(objects).groupBy("id").agg(F.sort_array(F.collect_set("component_name")).alias("data_components"), F.sort_array(F.collect_set("log_source")).alias("log_sources"))
    none = F.array().cast("array<string>")
    tactics = F.transform(F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    return active.join(found, "id", "left").select(
        technique.alias("technique"),
        "name",
        clean_description(F.coalesce("description", F.lit(""))).alias("description"),
        F.coalesce(F.sort_array(tactics), none).alias("tactics"),
        F.coalesce(F.sort_array("x_mitre_platforms"), none).alias("platforms"),
        F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"),
        F.when(technique.contains("."), F.substring_index(technique, ".", 1)).alias("parent"),
        F.col("ref.url").alias("url"),
        F.col("x_mitre_version").alias("version"),
        "modified",
        F.coalesce("data_components", none).alias("data_components"),
        F.coalesce("log_sources", none).alias("log_sources"),
    )


def observable(techniques: DataFrame, components: list[str] = AUTH_COMPONENTS) -> DataFrame:
    """Techniques of which some data component is among the given ones."""
    return techniques.where(F.arrays_overlap("data_components", F.array(*map(F.lit, components))))
