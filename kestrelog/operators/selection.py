"""Choice and trial of detectors: samples, feature tables, repeated fits, grids and success rules."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions import tables

from . import extra_trees, metrics, sequences

TRAIN_DAYS, VALIDATION_DAYS, TEST_DAYS = (8, 12), (13, 16), (17, 30)


def monitor_samples(chunks: DataFrame, cap: int, train: int, monitor: int, draw) -> tuple[DataFrame, DataFrame]:
    """Chunks of units (split, fits, status) -> the drawn rows with their use, and the accounting of both samples.

    The training sample is drawn from eligible units of the training split, the monitor sample
    from scorable units of the validation split, without labels.
    """
    uses = {"train": (F.col("fits"), train), "monitor": ((F.col("split") == "validation") & (F.col("status") == "available"), monitor)}
    rows = stats = None
    for use, (condition, k) in uses.items():
        eligible = chunks.where(condition)
        drawn = sequences.sample_chunks(eligible, cap, k, draw).withColumn("use", F.lit(use))
        found = eligible.agg(F.countDistinct(*sequences.UNIT).alias("units"), F.count("*").alias("chunks"), F.sum("length").alias("events"))
        kept = drawn.agg(F.countDistinct(*sequences.UNIT).alias("sampled_units"), F.count("*").alias("sampled_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("sampled_events"))
        line = found.join(kept, F.lit(True)).select(F.lit(use).alias("use"), "*")  # one row each
        rows, stats = (drawn, line) if rows is None else (rows.unionByName(drawn), stats.union(line))
    return rows, stats


def source_features(events: DataFrame) -> DataFrame:
    """Per user and day: sources, those new to the user and their events, the busiest source, how many users a source has that day, sources known before, first host links and destinations.

    What is new follows from the least (timestamp, source_line) of the pairs, so events need no flags and none is moved by line.
    """
    keys, at = ["acting_user", "dataset_day"], ("timestamp", "source_line")
    per = events.groupBy(*keys, "source_computer").agg(F.count("*").alias("n"), F.min(F.struct(*at)).alias("first"))
    pair = Window.partitionBy("acting_user", "source_computer")  # a row for each day
    per = per.withColumn("fresh", F.col("first") == F.min("first").over(pair)).drop("first")
    links = events.groupBy("source_computer", "destination_computer").agg(F.min(F.struct(*at, *keys)).alias("first"))
    links = links.groupBy("first.acting_user", "first.dataset_day", "source_computer").agg(F.count("*").alias("hosts"))
    per = per.join(links, [*keys, "source_computer"], "left").withColumn("hosts", F.coalesce("hosts", F.lit(0)))
    popular = per.groupBy("dataset_day", "source_computer").agg(F.count("*").alias("users"))
    g = per.join(popular, ["dataset_day", "source_computer"]).groupBy(*keys).agg(
        F.count("*").alias("source_count"), F.count_if("fresh").alias("new_source_count"), F.coalesce(F.sum(F.when(F.col("fresh"), F.col("n"))), F.lit(0)).alias("new_source_auth_count"), F.max("n").alias("max_auth_per_source"),
        F.min("users").alias("min_source_popularity"), F.avg("users").alias("mean_source_popularity"), F.sum("hosts").alias("new_host_connection_events"),
    )
    earlier = Window.partitionBy("acting_user").orderBy("dataset_day").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("prior_source_degree", F.coalesce(F.sum("new_source_count").over(earlier), F.lit(0)))
    return g.join(events.groupBy(*keys).agg(F.countDistinct("destination_computer").alias("destination_count")), keys)


SCORES = ["baseline_score", "burst_score"]
COUNTS = [
    "n_edges", "new_edge_count", "prior_degree", "current_degree", "degree_growth", "peak_60s", "peak_300s", "peak_destinations_300s", "source_count", "new_source_count", "new_source_auth_count",
    "max_auth_per_source", "min_source_popularity", "mean_source_popularity", "prior_source_degree", "new_host_connection_events", "destination_count",
]


def feature_matrix(days: DataFrame) -> DataFrame:
    """User-days with `features`: both scores as they are, the 17 counts as ln(1 + max(x, 0)). Fails if a value is not finite."""
    logged = {f"x_{c}": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in COUNTS} | {f"x_{c}": F.col(c).cast("double") for c in SCORES}
    out = days.withColumns(logged)
    names = [f"x_{c}" for c in (*SCORES, *COUNTS)]
    zero = sum((F.col(c) * 0.0 for c in names), F.lit(0.0))  # null or NaN if a value is not finite
    if out.where(zero.isNull() | F.isnan(zero)).limit(1).count():
        raise ValueError("features must be finite")
    return VectorAssembler(inputCols=names, outputCol="features").transform(out).drop(*names)


def balanced(train: DataFrame) -> DataFrame:
    """Adds y and a weight that gives both classes half of the whole."""
    n, positives = train.agg(F.count("*"), F.count_if("label")).first()
    weight = F.when(F.col("label"), n / (2.0 * max(positives, 1))).otherwise(n / (2.0 * max(n - positives, 1)))
    return train.withColumns({"y": F.col("label").cast("double"), "weight": weight})


def spark_classifier(classifier):
    """A Spark ML classifier as a candidate: fitted with class-balanced weights on `features`."""

    def fit(train: DataFrame):
        model = classifier.setLabelCol("y").setWeightCol("weight").fit(balanced(train))
        return lambda rows: model.transform(rows).select("user", "day", "label", vector_to_array("probability")[1].alias("score"))

    return fit


def tree_classifier(columns: list[str], settings: extra_trees.Settings):
    """Extremely randomised trees over columns as a candidate."""

    def fit(train: DataFrame):
        trees = extra_trees.grow(train, columns, settings)
        return lambda rows: extra_trees.scores(rows, ["user", "day", "label"], columns, trees)

    return fit


def compare_classifiers(rows: DataFrame, candidates: dict) -> DataFrame:
    """rows (user, day, label, inputs) -> a report of each candidate on validation and test days; the chosen one is marked.

    A candidate is a function from training rows to a scorer. Its threshold is the validation days' best by F1 (the lowest of
    equals) and is frozen for the test days. Chosen is the best by average precision, then F1 at the threshold, on validation days.
    """
    inside = lambda days: F.col("day").between(*days)
    train, later, out = rows.where(inside(TRAIN_DAYS)), rows.where(F.col("day") >= VALIDATION_DAYS[0]), None
    for name, fit in candidates.items():
        part = fit(train)(later).select(F.lit(name).alias("model"), F.when(inside(VALIDATION_DAYS), "validation").otherwise("test").alias("part"), "label", "score")
        out = part if out is None else out.unionByName(part)
    out, keys = tables.stored(out, "candidate-scores"), ["model", "part"]
    ranked = tables.stored(metrics.ranking(out, keys, lowest=True), "ranking")
    thresholds = ranked.where("part = 'validation'").select("model", "threshold")
    report = metrics.confusion(out.join(F.broadcast(thresholds), "model"), F.col("threshold"), [*keys, "threshold"])  # a row for each model
    report = report.join(F.broadcast(ranked.select(*keys, "ap", "auc")), keys)
    report = report.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("precision", "recall", "f1")})
    order = Window.orderBy(F.desc_nulls_last("ap"), F.desc("f1"), "model")  # a row for each model
    best = report.where("part = 'validation'").withColumn("place", F.row_number().over(order)).where("place = 1").select(F.col("model").alias("best"))
    return report.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("model") == F.col("best")).drop("best")  # one row


def fitted(rows: DataFrame, columns: list[str], classifier, last_train_day: int = 16):
    """A scaler and a class-balanced classifier on logged columns, fitted on days up to last_train_day -> a function that scores rows."""
    assembler = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="raw")
    logged = lambda df: assembler.transform(df.withColumns({f"__{c}": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in columns}))
    train = logged(rows.where(F.col("day") <= last_train_day))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = classifier.fit(scaler.transform(balanced(train)))
    return lambda df: model.transform(scaler.transform(logged(df))).withColumn("score", vector_to_array("probability")[1]).drop(*[f"__{c}" for c in columns], "raw", "features", "rawPrediction", "probability", "prediction")


#: Neighbours by place that meet as one row where values change places.
BLOCK = 1024


def _blocks(rows: DataFrame, keys: list[str], fields: Column, name: str) -> DataFrame:
    """rows (keys, __n from 1) -> (keys, __block, name): the fields of BLOCK places as an array in their order."""
    at = F.sort_array(F.collect_list(F.struct("__n", fields.alias("v"))))
    return rows.groupBy(*keys, F.floor((F.col("__n") - 1) / BLOCK).alias("__block")).agg(F.transform(at, lambda x: x["v"]).alias(name))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(day, trial, __x), those of a trial's day in their order -> (day, trial, __block, __xs): the values of BLOCK places together."""

    def out(days: pa.Array, trials: pa.Array, values: pa.Array, blocks: list[tuple[int, int, int]]) -> pa.RecordBatch:  # blocks: from, to, number; one after the other
        first = pa.array([b[0] for b in blocks], pa.int64())
        lists = pa.ListArray.from_arrays(pa.array([b[0] for b in blocks] + [blocks[-1][1]], pa.int32()), values)
        return pa.RecordBatch.from_arrays([days.take(first), trials.take(first), pa.array([b[2] for b in blocks], pa.int64()), lists], ["day", "trial", "__block", "__xs"])

    held, last, number = None, None, 0  # rows of a block that is not full, its day and trial, its number
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [pa.concat_arrays([h, c]) for h, c in zip(held, batch.columns)] if held else batch.columns
        day, trial = (c.to_numpy() for c in columns[:2])
        starts = np.flatnonzero(np.concatenate([[True], (day[1:] != day[:-1]) | (trial[1:] != trial[:-1])])).tolist()
        blocks, n = [], len(day)
        for a, b in zip(starts, [*starts[1:], n]):
            if (day[a], trial[a]) != last:
                last, number = (day[a], trial[a]), 0
            whole = b if b < n else a + (b - a) // BLOCK * BLOCK
            for k in range(a, whole, BLOCK):
                blocks.append((k, min(k + BLOCK, whole), number))
                number += 1
        held = [c.slice(whole) for c in columns]
        if blocks:
            yield out(*columns, blocks)
    if held and len(held[0]):
        yield out(*held, [(0, len(held[0]), number)])


def permutation_importance(rows: DataFrame, columns: list[str], score, repeats: int = 5) -> DataFrame:
    """The loss of a fitted model's average precision when an input's values change places, mean and deviation over seeded repeats.

    Values change places within a day, so no more than a day's rows are numbered together. All trials are one table
    that is scored once, so the plan does not grow with them; only an input's values move, and they meet the rows in blocks of places.
    Rows of a trial with the same label and inputs are counted and scored as one, so score sees these columns alone.
    """
    rows = rows.select("day", "label", "tie", *columns)
    types = {f.name: f.dataType for f in rows.schema.fields}
    trials = [(c, seed) for c in columns for seed in range(repeats)]
    base = rows.select(F.lit(-1).alias("trial"), "label", *columns)
    mine = rows.withColumn("__n", F.row_number().over(Window.partitionBy("day").orderBy("tie")))
    mine = _blocks(mine, ["day"], F.struct("label", *columns), "__rows")
    each = F.array(*[F.struct(F.lit(k).alias("trial"), F.lit(f"{c}/{seed}").alias("__named"), F.col(c).cast("double").alias("__x")) for k, (c, seed) in enumerate(trials)])
    others = rows.where("day is not null").select("day", "tie", F.inline(each)).repartition("trial", "day")  # draws are made where they are sorted
    others = others.withColumn("__draw", F.md5(F.concat_ws("/", "__named", "tie").cast("binary")))
    # one number that tells most rows apart: the trial's day and how the draw begins
    key = F.shiftleft(F.col("day").cast("long") * len(trials) + F.col("trial"), 32) + F.conv(F.substring("__draw", 1, 8), 16, 10).cast("long")
    others = others.withColumn("__key", key).sortWithinPartitions("__key", "__draw", "tie").select("day", "trial", "__x")
    others = others.mapInArrow(_placed, f"day {rows.schema['day'].dataType.simpleString()}, trial int, __block long, __xs array<double>")
    moved = others.join(mine, ["day", "__block"]).select("trial", F.inline(F.arrays_zip("__rows", "__xs"))).select("trial", "__rows.*", F.col("__xs").alias("__x"))
    own = lambda k: F.col("trial").between(k * repeats, (k + 1) * repeats - 1)
    moved = moved.withColumns({c: F.when(own(k), F.col("__x").cast(types[c])).otherwise(F.col(c)) for k, c in enumerate(columns)}).drop("__x")
    alike = base.unionByName(moved).groupBy("trial", "label", *columns).agg(F.count("*").alias("times"))
    ap = metrics.average_precision(score(alike).select("trial", "label", "score", "times"), ["trial"], "times")
    named = F.get(F.array(*map(F.lit, columns)), F.floor(F.col("trial") / repeats).cast("int"))
    ap = ap.select(named.alias("feature"), F.col("trial").alias("seed"), "ap")
    ap = tables.stored(ap, "trials")
    whole = ap.where("seed < 0").select(F.col("ap").alias("whole"))
    return ap.where("seed >= 0").join(whole, F.lit(True)).groupBy("feature").agg(F.avg(F.col("whole") - F.col("ap")).alias("loss"), F.stddev_pop("ap").alias("deviation"))  # whole is one row


def noise_stability(rows: DataFrame, column: str, columns: list[str], classifier, seeds: int = 7, sigma: float = 0.05) -> DataFrame:
    """Average precision of a classifier that is fitted again for each seed on column times 1 + N(0, sigma): median, least and largest.

    The noise follows from the row's tie and the seed (by Box and Muller's rule), so it is the same in every run.
    """
    out = None
    for seed in range(seeds):
        uniform = [(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{k}/"), F.col("tie").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32 for k in (0, 1)]
        noise = F.sqrt(-2 * F.log(uniform[0])) * F.cos(2 * math.pi * uniform[1])
        noisy = rows.withColumn(column, F.col(column) * (1 + sigma * noise))
        part = fitted(noisy, columns, classifier)(noisy.where("day > 16")).select(F.lit(seed).alias("seed"), "label", "score")
        out = part if out is None else out.union(part)
    ap = metrics.average_precision(out, ["seed"])
    return ap.agg(F.percentile("ap", 0.5).alias("median"), F.min("ap").alias("least"), F.max("ap").alias("largest"), F.count("*").alias("fits"))


def threshold_evaluation(scored: DataFrame, budget: int) -> DataFrame:
    """Scores (day, score, label, is_machine, tie): the best-F1 threshold of days 8 to 12 alone, and on days 13 to 16 counts at it, average precision and hits at the budget."""
    held = scored.where(F.col("day").between(*VALIDATION_DAYS))
    threshold = metrics.best_f1(scored.where(F.col("day").between(*TRAIN_DAYS))).select("threshold")
    at = held.join(F.broadcast(threshold), F.lit(True))  # one row
    counts = at.agg(F.count("*").alias("units"), F.count_if("label").alias("positives"), F.count_if(F.col("score") >= F.col("threshold")).alias("alerts"), F.count_if((F.col("score") >= F.col("threshold")) & F.col("label")).alias("tp"), F.first("threshold").alias("threshold"))
    one = F.lit(True)  # one row each
    return counts.join(metrics.average_precision(held), one).join(metrics.budget_metrics(held, budget, ["tie"]).select("hits"), one)


def success_rules(per_scorer: DataFrame, reference: str, humans: str | None = None) -> DataFrame:
    """Scorers (scorer, hits, ap) against a reference: primary, at least twice its hits (two where it has none) and a higher average precision; secondary, more hits and higher average precision than its humans-only form."""
    pick = lambda name, tag: per_scorer.where(F.col("scorer") == name).select(F.col("hits").alias(f"{tag}_hits"), F.col("ap").alias(f"{tag}_ap"))
    out = per_scorer.join(F.broadcast(pick(reference, "reference")), F.lit(True))  # one row
    needed = F.greatest(2 * F.col("reference_hits"), F.lit(2))
    out = out.withColumns({"needed": needed, "primary": (F.col("hits") >= needed) & (F.col("ap") > F.col("reference_ap"))})
    if humans is not None:
        out = out.join(F.broadcast(pick(humans, "humans")), F.lit(True)).withColumn("secondary", (F.col("hits") > F.col("humans_hits")) & (F.col("ap") > F.col("humans_ap"))).drop("humans_hits", "humans_ap")
    return out.drop("reference_hits", "reference_ap")
