"""When attacks are noticed, which detector leads, and where alerts go wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions.clock import day_of


def campaigns(labels: DataFrame) -> DataFrame:
    """Label times of each user and day, in order."""
    return labels.groupBy("user", day_of(F.col("timestamp")).alias("day")).agg(F.sort_array(F.collect_list("timestamp")).alias("times"), F.min("timestamp").alias("first_attack"), F.count("*").alias("labels"))


def offset_class(offset: Column) -> Column:
    return F.when(offset.isNull(), "missed").when(offset < 0, "early").when(offset <= 3600, "immediate").otherwise("delayed")


def first_alert_offsets(found: DataFrame, alerts: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """campaigns x alerts (user, day, hour): offset of the first alert's end from the first attack, and its class."""
    first = alerts.groupBy(*keys, "user", "day").agg(F.min("hour").alias("first_alert"))
    base = found if not keys else found.join(F.broadcast(alerts.select(*keys).distinct()), F.lit(True))  # a row for each model
    joined = base.join(first, [*keys, "user", "day"], "left").withColumn("offset", F.col("first_alert") + 3600 - F.col("first_attack"))
    return joined.withColumn("class", offset_class(F.col("offset")))


def attack_hours(found: DataFrame, alerts: DataFrame, label_hours: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Per keys: campaigns whose first alert of the day is on a labelled hour, and those with any such alert."""
    marked = alerts.join(label_hours.select("user", "hour").distinct().withColumn("__on", F.lit(True)), ["user", "hour"], "left").withColumn("__on", F.coalesce("__on", F.lit(False)))
    per = marked.groupBy(*keys, "user", "day").agg(F.min_by("__on", "hour").alias("first_on"), F.bool_or("__on").alias("any_on"))
    base = found.select("user", "day") if not keys else found.select("user", "day").join(F.broadcast(alerts.select(*keys).distinct()), F.lit(True))  # a row for each model
    joined = base.join(per, [*keys, "user", "day"], "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("campaigns"), F.count_if("first_on").alias("first_alert_on_attack_hour"), F.count_if("any_on").alias("campaigns_caught"))


def precedence(seq: Column, graph: Column) -> tuple[Column, Column]:
    """Who alerts first, and by how many seconds."""
    lead = F.when(seq.isNull() & graph.isNull(), "none").when(graph.isNull(), "sequence_only").when(seq.isNull(), "graph_only").when(seq < graph, "sequence").when(graph < seq, "graph").otherwise("simultaneous")
    return lead, F.abs(seq - graph)


def summarise(offsets: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts per class, and mean, median, least, largest and population deviation of the offsets."""
    o = F.col("offset")
    return offsets.groupBy(*keys).agg(
        F.count("*").alias("campaigns"), *[F.count_if(F.col("class") == c).alias(c) for c in ("early", "immediate", "delayed", "missed")],
        F.avg(o).alias("mean"), F.percentile(o, 0.5).alias("median"), F.min(o).alias("least"), F.max(o).alias("largest"), F.stddev_pop(o).alias("deviation"),
    )


def error_analysis(scored: DataFrame, budget: int, tie: str) -> DataFrame:
    """One row: caught and missed labelled hours and false alarms (machine and human), with mean sizes; scored has n_events."""
    r = scored.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), tie)))
    hit, y = F.col("rank") <= budget, F.col("label")
    return r.agg(
        F.count_if(hit & y).alias("caught"), F.count_if(~hit & y).alias("missed"), F.count_if(hit & ~y & F.col("is_machine")).alias("false_machine"), F.count_if(hit & ~y & ~F.col("is_machine")).alias("false_human"),
        F.avg(F.when(hit & y, F.col("n_events"))).alias("caught_events"), F.avg(F.when(~hit & y, F.col("n_events"))).alias("missed_events"),
    )


def pick_cases(scored: DataFrame, budget: int, tie: str) -> DataFrame:
    """The best caught hour, the best false alarm, and the missed hour of middle rank."""
    r = scored.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), tie)))
    kind = F.when((F.col("rank") <= budget) & F.col("label"), "caught").when(F.col("rank") <= budget, "false_alarm").when(F.col("label"), "missed")
    named = r.withColumn("kind", kind).where("kind is not null")
    w = Window.partitionBy("kind")
    placed = named.withColumns({"place": F.row_number().over(w.orderBy("rank", F.desc("score"), tie)) - 1, "n": F.count("*").over(w)})
    return placed.where(F.when(F.col("kind") == "missed", F.col("place") == F.floor(F.col("n") / 2)).otherwise(F.col("place") == 0)).drop("place", "n")


def known_attack_score(units: DataFrame, triples: DataFrame) -> DataFrame:
    """1 for units whose user is in the frozen history, 0 otherwise."""
    flags = triples.select("user").distinct().withColumn("__k", F.lit(1.0))
    return units.join(flags, "user", "left").withColumn("score", F.coalesce("__k", F.lit(0.0))).drop("__k")
