"""Windows of the user-computer graph: edges, node features, propagation, edge and user scores."""

from __future__ import annotations

import math

from pyspark.ml.feature import StringIndexer
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import rolling_distinct

WINDOW = 86_400
SUCCESS_WEIGHT, FAILURE_WEIGHT = 1.0, 0.25
MAX_LINES = 100
EDGE = ["acting_user", "destination_computer"]


def windows_of(t: Column, width: int = WINDOW, stride: int = WINDOW, origin: int = 1) -> Column:
    """All cutoffs c (origin + width, then every stride) whose window [c - width, c) holds t."""
    first = F.greatest(F.lit(0), F.ceil((t - origin - width + 1) / stride))
    last = F.floor((t - origin) / stride)
    return F.transform(F.sequence(first, last), lambda i: i * stride + origin + width)


def assign_windows(events: DataFrame, width: int = WINDOW, stride: int = WINDOW, origin: int = 1) -> DataFrame:
    """events once per window, with window_end; tumbling windows need no copies."""
    t = F.col("timestamp")
    if stride == width:
        return events.withColumn("window_end", (F.floor((t - origin) / width) * width + origin + width).cast("long"))
    return events.withColumn("window_end", F.explode(windows_of(t, width, stride, origin)))


def edges(windowed: DataFrame, width: int = WINDOW) -> DataFrame:
    """(window_end, user, computer): successes, failures (all that is not Success), weight, first 100 lines, novelty.

    An edge is new if the pair was not seen before the window began. The lines of an edge are
    cut by rank before they are gathered, so a busy pair gathers 100 at most.
    """
    keys = ["window_end", *EDGE]
    ok = F.col("authentication_result") == "Success"
    seen = windowed.groupBy(*EDGE).agg(F.min("timestamp").alias("first_seen"))
    ranked = windowed.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "source_line")))
    g = ranked.groupBy(*keys).agg(
        F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.count("*").alias("events"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("__r") <= MAX_LINES, F.struct("__r", "source_line")))), lambda x: x["source_line"]).alias("lines"),
    )
    out = g.withColumns({"weight": SUCCESS_WEIGHT * F.col("successes") + FAILURE_WEIGHT * F.col("failures"), "truncated": F.col("events") > MAX_LINES})
    return out.join(seen, EDGE).withColumn("is_new", F.col("first_seen") >= F.col("window_end") - width).drop("first_seen")


def degrees(edge_rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Per user and window: computers in the window, computers known before it (prior_degrees), and the one less the other."""
    current = edge_rows.groupBy("acting_user", "window_end").agg(F.count("*").alias("degree"))
    return current.join(prior.select("acting_user", "window_end", "prior_degree"), ["acting_user", "window_end"]).withColumn("growth", F.col("degree") - F.col("prior_degree"))


def prior_degrees(events: DataFrame, width: int = WINDOW) -> DataFrame:
    """Computers first seen before each window in which the user is active."""
    first = events.groupBy(*EDGE).agg(F.min("timestamp").alias("t"))
    starts = assign_windows(first.withColumnRenamed("t", "timestamp"), width).groupBy("acting_user", "window_end").agg(F.count("*").alias("fresh"))
    active = assign_windows(events, width).select("acting_user", "window_end").distinct().join(starts, ["acting_user", "window_end"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    w = Window.partitionBy("acting_user").orderBy("window_end").rowsBetween(Window.unboundedPreceding, -1)
    return active.select("acting_user", "window_end", F.coalesce(F.sum("fresh").over(w), F.lit(0)).alias("prior_degree"), "fresh")


def bursts(windowed: DataFrame) -> DataFrame:
    """Per user and window, the peaks of events in 60 s and 300 s and of distinct computers in 300 s, within the window."""
    keys = ["acting_user", "window_end"]
    order = Window.partitionBy(*keys).orderBy("timestamp")
    counted = windowed.withColumns({"c60": F.count("*").over(order.rangeBetween(-59, 0)), "c300": F.count("*").over(order.rangeBetween(-299, 0))})
    others = rolling_distinct(counted.select(*keys, "timestamp", "source_line", "destination_computer", "c60", "c300"), keys, "destination_computer", 299, "d300")
    own = F.lag("timestamp").over(Window.partitionBy(*keys, "destination_computer").orderBy("timestamp", "source_line"))
    here = others.withColumn("d300", F.col("d300") + F.when(own.isNull() | (own < F.col("timestamp") - 299), 1).otherwise(0))
    return here.groupBy(*keys).agg(F.max("c60").alias("peak_60s"), F.max("c300").alias("peak_300s"), F.max("d300").alias("peak_destinations_300s"))


def node_features(edge_rows: DataFrame, peaks: DataFrame, prior: DataFrame) -> DataFrame:
    """Nine features of users and computers: both types, log degree, strength, failures, growth (at least 0) and peaks; growth and peaks of computers are 0."""
    log = lambda c: F.log1p(c.cast("double"))
    users = edge_rows.groupBy("window_end", "acting_user").agg(F.count("*").alias("d"), F.sum("weight").alias("s"), F.sum("failures").alias("f")).join(peaks, ["window_end", "acting_user"]).join(prior, ["window_end", "acting_user"])
    computers = edge_rows.groupBy("window_end", "destination_computer").agg(F.count("*").alias("d"), F.sum("weight").alias("s"), F.sum("failures").alias("f"))
    shared = [log(F.col("d")).alias("log_degree"), log(F.col("s")).alias("log_strength"), log(F.col("f")).alias("log_failures")]
    growth = log(F.greatest(F.col("d") - F.col("prior_degree"), F.lit(0))).alias("log_growth")
    names = {"peak_60s": "log_60s", "peak_300s": "log_300s", "peak_destinations_300s": "log_destinations_300s"}
    left = users.select("window_end", F.col("acting_user").alias("node"), F.lit(1.0).alias("is_user"), F.lit(0.0).alias("is_computer"), *shared, growth, *[log(F.col(c)).alias(n) for c, n in names.items()])
    right = computers.select("window_end", F.col("destination_computer").alias("node"), F.lit(0.0).alias("is_user"), F.lit(1.0).alias("is_computer"), *shared, F.lit(0.0).alias("log_growth"), *[F.lit(0.0).alias(n) for n in names.values()])
    return left.union(right)


def normalised_adjacency(edge_rows: DataFrame) -> DataFrame:
    """(window_end, i, j, a): both directions and self loops, divided by the root of the degrees' product."""
    pairs = edge_rows.select("window_end", F.col("acting_user").alias("i"), F.col("destination_computer").alias("j"), "weight")
    both = pairs.union(pairs.select("window_end", "j", "i", "weight"))
    nodes = both.select("window_end", "i").distinct()
    full = both.union(nodes.select("window_end", "i", F.col("i").alias("j"), F.lit(1.0).alias("weight")))
    degree = full.groupBy("window_end", "i").agg(F.sum("weight").alias("d"))
    out = full.join(degree, ["window_end", "i"]).join(degree.select("window_end", F.col("i").alias("j"), F.col("d").alias("e")), ["window_end", "j"])
    return out.select("window_end", "i", "j", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("a"))


def propagate(adjacency: DataFrame, features: DataFrame, columns: list[str], steps: int = 2) -> DataFrame:
    """Features summed over neighbours by weight, so many times."""
    for _ in range(steps):
        joined = adjacency.join(features.withColumnRenamed("node", "j"), ["window_end", "j"])
        features = joined.groupBy("window_end", F.col("i").alias("node")).agg(*[F.sum(F.col("a") * F.col(c)).alias(c) for c in columns])
    return features


def _draw(seed: int, column: str) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(column)).cast("binary"))


def next_prime(n: int) -> int:
    """The least prime that is n or more and 2 mod 3."""
    n = max(n, 2)
    while n % 3 != 2 or any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def negative_sample(edge_rows: DataFrame, per_user: int, seed: int = 7) -> DataFrame:
    """Pairs without an edge, per window: for each user per_user computers, or all that it has no edge with if they are fewer.

    A window's computers are numbered in a seeded order. Each user of a window goes through the numbers in an
    order of its own, step x being number b (a x + c)^3 + d mod p, with a, b, c and d that follow from seed, user and
    window: a keyed permutation, since third powers are one where p mod 3 is 2. p is the least such prime of size or
    more, a few steps away. Of p - size + degree + per_user steps at most degree are edges and p - size no numbers, so
    that many suffice.
    """
    keys = ["window_end", "acting_user"]
    computers = edge_rows.select("window_end", "destination_computer").distinct()
    order = Window.partitionBy("window_end").orderBy(_draw(seed, "destination_computer"), "destination_computer")
    numbered = computers.withColumn("n", F.row_number().over(order).cast("long") - 1)
    sizes = numbered.groupBy("window_end").agg(F.count("*").alias("size")).collect()  # a row for each window
    sizes = edge_rows.sparkSession.createDataFrame([(r.window_end, r["size"], next_prime(r["size"])) for r in sizes], f"window_end {edge_rows.schema['window_end'].dataType.simpleString()}, size long, p long")
    users = edge_rows.groupBy(*keys).agg(F.count("*").alias("degree")).join(F.broadcast(sizes), "window_end")
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("window_end").cast("string"), "acting_user").cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    last = F.least(F.col("p"), F.col("p") - F.col("size") + F.col("degree") + per_user) - 1
    p = F.col("p")
    factor = lambda at: F.when(p > 2, number(at) % (p - 1) + 1).otherwise(1)
    walked = users.select(*keys, "p", factor(1).alias("a"), factor(9).alias("b"), (number(17) % p).alias("c"), (number(25) % p).alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("step"))
    walked = walked.withColumn("y", (F.col("a") * F.col("step") + F.col("c")) % p)
    place = (F.col("b") * (F.col("y") * F.col("y") % p * F.col("y") % p) + F.col("d")) % p
    met = walked.select(*keys, "step", place.alias("n")).join(numbered, ["window_end", "n"])
    free = met.join(edge_rows.select("window_end", *EDGE), ["window_end", *EDGE], "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("step"))
    return free.withColumn("place", place).where(F.col("place") <= per_user).select("window_end", *EDGE)


def edge_weights(windowed: DataFrame) -> DataFrame:
    """(window_end, user, computer, weight) alone: one aggregate with a map-side part."""
    n = F.when(F.col("authentication_result") == "Success", SUCCESS_WEIGHT).when(F.col("authentication_result").isNotNull(), FAILURE_WEIGHT).otherwise(0.0)
    return windowed.where(F.col("acting_user").isNotNull() & F.col("destination_computer").isNotNull()).groupBy("window_end", *EDGE).agg(F.sum(n).alias("weight"))


def indexed(train: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Tables of edges with u and c, the numbers of users and computers of the training edges."""
    users = StringIndexer(inputCol="acting_user", outputCol="u", handleInvalid="keep").fit(train)
    computers = StringIndexer(inputCol="destination_computer", outputCol="c", handleInvalid="keep").fit(train)
    return [computers.transform(users.transform(df)).withColumns({"u": F.col("u").cast("int"), "c": F.col("c").cast("int")}) for df in tables]


def edge_anomaly(train: DataFrame, scored: DataFrame, rank: int = 8, seed: int = 7) -> DataFrame:
    """scored edges with score = sigmoid(-u.c / sqrt(rank)) from implicit ALS factors of the training edges; nodes without factors count as zero."""
    return indexed_anomaly(*indexed(train, train, scored), rank, seed)


def indexed_anomaly(train: DataFrame, scored: DataFrame, rank: int = 8, seed: int = 7) -> DataFrame:
    """edge_anomaly of edges that carry u and c, so that several ranks share the numbers."""
    model = ALS(userCol="u", itemCol="c", ratingCol="weight", implicitPrefs=True, rank=rank, maxIter=5, seed=seed).fit(train)
    uf = model.userFactors.select(F.col("id").alias("u"), F.col("features").alias("zu"))
    cf = model.itemFactors.select(F.col("id").alias("c"), F.col("features").alias("zc"))
    joined = scored.join(uf, "u", "left").join(cf, "c", "left")
    dot = F.coalesce(F.aggregate(F.zip_with("zu", "zc", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    return joined.withColumn("score", 1 / (1 + F.exp(dot / F.sqrt(F.lit(float(rank)))))).drop("u", "c", "zu", "zc")


def user_scores(scored_edges: DataFrame, top: int = 3) -> DataFrame:
    """Per user and window: the largest edge score and the mean of the top few (all, if there are fewer), with those edges in order."""
    w = Window.partitionBy("acting_user", "window_end").orderBy(F.desc("score"), "destination_computer")
    ranked = scored_edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.groupBy("acting_user", "window_end").agg(F.max("score").alias("max_score"), F.avg("score").alias("top_mean"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("rank", "destination_computer"))), lambda x: x["destination_computer"])).alias("top_edges"))


def day_rows(scores: DataFrame, width: int = WINDOW) -> DataFrame:
    """User-day rows: day = 1 + (window_end - 2) div 86,400, with the warm-up status of the first window."""
    return scores.withColumns({"day": (F.floor((F.col("window_end") - 2) / 86_400) + 1).cast("int"), "status": F.when(F.col("window_end") - width <= 1, "warmup").otherwise("available")})


def label_cutoff(t: Column, stride: int = WINDOW, origin: int = 1) -> Column:
    """The first cutoff strictly later than a label."""
    return ((F.floor((t - origin) / stride) + 1) * stride + origin).cast("long")


# ---- confirmed relationships ----

TRIPLE = ["user", "source_computer", "destination_computer"]


def frozen_triples(labels: DataFrame, before: int) -> DataFrame:
    return labels.where(F.col("timestamp") < before).select(*TRIPLE).distinct()


def triple_matches(events: DataFrame, triples: DataFrame, since: int) -> DataFrame:
    """Events from `since` on whose user and both computers are a frozen triple."""
    return events.withColumn("user", F.col("acting_user")).where(F.col("timestamp") >= since).join(triples, TRIPLE, "left_semi")


def universe_metrics(universe: DataFrame, flagged: DataFrame, positive: DataFrame, keys: list[str]) -> DataFrame:
    """Set metrics of flagged units against positive ones over an explicit universe."""
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    joined = universe.select(*keys).distinct().join(mark(flagged, "hit"), keys, "left").join(mark(positive, "y"), keys, "left").select(F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("y", F.lit(False)).alias("y"))
    h, y = F.col("hit"), F.col("y")
    g = joined.agg(F.count_if(h & y).alias("tp"), F.count_if(h & ~y).alias("fp"), F.count_if(~h & y).alias("fn"), F.count_if(~h & ~y).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0)
    return g.withColumns({"precision": tp / F.nullif(tp + fp, zero), "recall": tp / F.nullif(tp + fn, zero), "f1": 2 * tp / F.nullif(2 * tp + fp + fn, zero)})


def hybrid_rows(graph_days: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """User-days with separate signals, a reason by precedence, and their union."""
    known = matches.groupBy(F.col("acting_user"), F.col("dataset_day").alias("day")).agg(F.count("*").alias("matches"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "source_line"))), lambda x: x["source_line"].cast("string"))).alias("lines"))
    out = graph_days.join(known, ["acting_user", "day"], "left").withColumns({"matches": F.coalesce("matches", F.lit(0)), "graph_alert": F.col("score") >= threshold})
    known_hit = F.col("matches") > 0
    reason = F.when(known_hit & F.col("graph_alert"), "confirmed_and_anomalous").when(known_hit, "confirmed_relationship").when(F.col("graph_alert"), "graph_anomaly").otherwise("none")
    return out.withColumns({"reason": reason, "is_alert": known_hit | F.col("graph_alert")})


def collapse_report(a: DataFrame, b: DataFrame, absolute: float = 0.10, relative: float = 0.50, positives: int = 30) -> DataFrame:
    """Two one-row metric tables (f1, tp, fn), of development and of a later holdout -> the loss of F1 and whether it is a collapse.

    It is one if the loss exceeds both limits, or if the holdout has too few positives to tell.
    """
    both = a.select(F.coalesce("f1", F.lit(0.0)).alias("f1_before")).join(b.select(F.coalesce("f1", F.lit(0.0)).alias("f1_after"), (F.col("tp") + F.col("fn")).alias("holdout_positives")), F.lit(True))  # one row each
    loss = F.greatest(F.lit(0.0), F.col("f1_before") - F.col("f1_after"))
    out = both.withColumns({"absolute_loss": loss, "relative_loss": F.when(F.col("f1_before") == 0, 0.0).otherwise(loss / F.col("f1_before"))})
    out = out.withColumn("dropped", (F.col("absolute_loss") > absolute) & (F.col("relative_loss") > relative))
    return out.withColumn("collapsed", F.col("dropped") | (F.col("holdout_positives") < positives))
