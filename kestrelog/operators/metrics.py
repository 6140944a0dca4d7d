"""Calibration of scores, and ranking metrics that scale: running counts over distinct scores."""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelog.functions import tables

KNOTS = 1001
P_TOP = 0.999
MIN_REFERENCES = 100


def log_score(raw: Column) -> Column:
    return F.log(F.greatest(raw, F.lit(0.0)) + 1e-12)


def order_statistics(values: DataFrame, probabilities: list[float], ranges: int = 200) -> list[float | None]:
    """Exact percentiles (linear between neighbours) of column x, which has no nulls; None for each without values.

    Values are cut into ranges of about equal numbers by a sketch, counted per distinct value and
    numbered within their range after the sizes of the ranges before, so no task holds all values.
    """
    bounds = sorted(set(values.stat.approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.002)))
    splits = [-math.inf, *([b for b in bounds if math.isfinite(b)] or [0.0]), math.inf]
    each = values.groupBy("x").agg(F.count("*").alias("n"))
    each = Bucketizer(splits=splits, inputCol="x", outputCol="part", handleInvalid="keep").transform(each)
    sizes = each.groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row for each range
    total, before = 0, {}
    for r in sorted(sizes, key=lambda r: r.part):
        before[r.part], total = total, total + r.n
    if not total:
        return [None] * len(probabilities)
    wanted = sorted({f(p * (total - 1)) for p in probabilities for f in (math.floor, math.ceil)})
    offsets = F.create_map(*[F.lit(x) for part, n in before.items() for x in (float(part), n)])
    inside = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = each.withColumn("to", F.sum("n").over(inside) + offsets[F.col("part")])
    places = [(float(part), int(w)) for part, n in sizes for w in wanted[bisect_left(wanted, before[part]) : bisect_left(wanted, before[part] + n)]]
    places = values.sparkSession.createDataFrame(places, "part double, at long")  # two rows a probability
    hit = ended.join(F.broadcast(places), "part").where((F.col("at") < F.col("to")) & (F.col("at") >= F.col("to") - F.col("n")))
    value = {r["at"]: r["x"] for r in hit.select("at", "x").collect()}  # two values a probability
    out = []
    for p in probabilities:
        at = p * (total - 1)
        low, high = value[math.floor(at)], value[math.ceil(at)]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def fit_calibrator(scores: DataFrame, column: str = "score") -> DataFrame:
    """(x, p, scale): quantile knots of the log scores on [0, 0.999], with the tail's scale on every row.

    Equal knots keep the highest probability. Exact percentiles; needs 100 finite references.
    """
    x = tables.stored(scores.where(F.col(column).isNotNull() & ~F.isnan(column)).select(log_score(F.col(column)).alias("x")), "references")
    n, std = x.agg(F.count("*"), F.stddev_pop("x")).first()
    if n < MIN_REFERENCES:
        raise ValueError("too few references")
    grid = [i * P_TOP / (KNOTS - 1) for i in range(KNOTS)]
    *knots, low, high = order_statistics(x, [*grid, 0.99, P_TOP])
    spread = (high - low) / math.log(10.0)
    scale = spread if spread > 0 else max(std, 1e-6) / 10
    highest = {q: i * (P_TOP / (KNOTS - 1)) for i, q in enumerate(knots)}  # the last of equal knots
    return scores.sparkSession.createDataFrame([(q, float(scale), p) for q, p in highest.items()], "x double, scale double, p double")


def save_calibrator(knots: DataFrame, path: str) -> None:
    knots.coalesce(1).write.mode("overwrite").parquet(path)


def load_calibrator(spark: SparkSession, path: str) -> DataFrame:
    """A saved calibrator; fails unless its knots ascend with their probabilities and share one positive scale."""
    knots = spark.read.schema("x double, scale double, p double").parquet(path)
    rows = sorted((r.x, r.p, r.scale) for r in knots.collect())
    if not rows or any(a[1] >= b[1] for a, b in zip(rows, rows[1:])) or {r[2] for r in rows} != {rows[0][2]} or rows[0][2] <= 0:
        raise ValueError("not a calibrator")
    return knots


def calibrate(scores: DataFrame, knots: DataFrame, column: str = "score", name: str = "calibrated") -> DataFrame:
    """Adds the calibrated score: 0 below the first knot, linear between knots, a tail above. knots has 1,001 rows at most.

    The knots' interval is found by binary search in the JVM, its line by a broadcast join.
    """
    rows = sorted((r.x, r.p, r.scale) for r in knots.collect())
    xs, ps, scale = [r[0] for r in rows], [r[1] for r in rows], rows[0][2]
    lines = [(0.0, 0.0, 0.0, 0.0)] + [(i + 1.0, a, p, (q - p) / (b - a)) for i, (a, b, p, q) in enumerate(zip(xs, xs[1:], ps, ps[1:]))] + [(float(len(xs)), xs[-1], ps[-1], None)]
    lines = F.broadcast(scores.sparkSession.createDataFrame(lines, "__i double, __a double, __p double, __slope double"))
    held = scores.withColumn("__x", F.coalesce(log_score(F.col(column)), F.lit(math.nan)))
    held = Bucketizer(splits=[-math.inf, *xs, math.inf], inputCol="__x", outputCol="__i", handleInvalid="keep").transform(held).join(lines, "__i", "left")
    over = F.col("__x") - F.col("__a")
    value = F.when(F.col(column).isNull(), None).when(F.col("__slope").isNull(), 1 - (1 - F.col("__p")) / (1 + over / F.lit(scale))).otherwise(F.col("__p") + F.col("__slope") * over)
    return held.withColumn(name, value).drop("__x", "__i", "__a", "__p", "__slope")


def confusion(scored: DataFrame, threshold: Column, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts and rates of score >= threshold against label (boolean); rates are null where nothing is counted."""
    hit, y = F.col("score") >= threshold, F.col("label")
    g = scored.groupBy(*keys).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)})


def cumulative(scored: DataFrame, keys: list[str] = [], ranges: int = 256, times: str | None = None) -> DataFrame:  # noqa: B006
    """Per distinct score, from the highest: own and running positives (tp) and negatives (fp), and totals.

    Scores are counted by value and stored; ranges that a quantile sketch makes about equal are
    summed apart and joined by the sums of the ranges above, so no task holds all scores however
    close together they lie. Null and NaN scores are left out. With times, a row stands for so many.
    """
    number = lambda c: F.count_if(c) if times is None else F.coalesce(F.sum(F.when(c, F.col(times))), F.lit(0))
    by = scored.where("score is not null and not isnan(score)").groupBy(*keys, F.col("score").cast("double").alias("score")).agg(number(F.col("label")).alias("pos"), number(~F.col("label")).alias("neg"))
    by = tables.stored(by, "score-counts")
    bounds = sorted({b for b in by.stat.approxQuantile("score", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if math.isfinite(b)})
    ranged = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol="score", outputCol="__r").transform(by)
    inner = Window.partitionBy(*keys, "__r").orderBy(F.desc("score"))
    totals = ranged.groupBy(*keys, "__r").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"), F.max("score").alias("__m"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__m")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    everything = Window.partitionBy(*keys)
    offsets = totals.withColumns({"__op": F.coalesce(F.sum("__p").over(above), F.lit(0)), "__on": F.coalesce(F.sum("__n").over(above), F.lit(0)), "P": F.sum("__p").over(everything), "N": F.sum("__n").over(everything)}).drop("__p", "__n", "__m")
    run = ranged.withColumns({"tp": F.sum("pos").over(inner), "fp": F.sum("neg").over(inner)}).join(offsets, [*keys, "__r"])
    return run.withColumns({"tp": F.col("tp") + F.col("__op"), "fp": F.col("fp") + F.col("__on")}).drop("__r", "__op", "__on")


def average_precision(scored: DataFrame, keys: list[str] = [], times: str | None = None) -> DataFrame:  # noqa: B006
    """Step-wise average precision; equal scores are one step. With times, a row stands for so many."""
    return cumulative(scored, keys, times=times).groupBy(*keys).agg(_ap().alias("ap"))


def _ap() -> Column:
    return F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("P"), F.lit(0))


def _auc() -> Column:
    return F.sum(F.col("pos") * ((F.col("N") - F.col("fp")) + F.col("neg") / 2)) / F.nullif(F.max("P") * F.max("N"), F.lit(0))


def _best(epsilon: float = 0.0, lowest: bool = False) -> Column:
    if epsilon:
        p, r = F.col("tp") / (F.col("tp") + F.col("fp") + epsilon), F.col("tp") / (F.col("P") + epsilon)
        f1 = 2 * p * r / (p + r + epsilon)
    else:
        f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P"))
    return F.max(F.struct(f1.alias("f1"), (-F.col("score") if lowest else F.col("score")).alias("tie"), F.col("score").alias("threshold")))


def ranking(scored: DataFrame, keys: list[str] = [], lowest: bool = False) -> DataFrame:  # noqa: B006
    """Average precision, area under the ROC curve and the best F1 with its threshold (the lowest of equals with `lowest`), of one count of the scores."""
    return cumulative(scored, keys).groupBy(*keys).agg(_ap().alias("ap"), _auc().alias("auc"), _best(lowest=lowest).alias("b")).select(*keys, "ap", "auc", "b.f1", "b.threshold")


def roc_auc(scored: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The area under the ROC curve; equal scores count half."""
    return cumulative(scored, keys).groupBy(*keys).agg(_auc().alias("auc"))


def best_f1(scored: DataFrame, keys: list[str] = [], epsilon: float = 0.0, lowest: bool = False) -> DataFrame:  # noqa: B006
    """The threshold with the largest F1, the higher one on ties (the lower with `lowest`); epsilon is added to the denominators in the variant of curves."""
    return cumulative(scored, keys).groupBy(*keys).agg(_best(epsilon, lowest).alias("b")).select(*keys, "b.f1", "b.threshold")


def evaluation_summary(scored: DataFrame, positives: DataFrame, keys: list[str]) -> DataFrame:
    """One row: coverage of positive units, prevalence, AP, lift, AUC, best F1, recall at it counting unscored positives."""
    labelled = tables.stored(label_units(scored, positives, keys), "labelled-units")
    counts = labelled.agg(F.count("*").alias("units"), F.count_if("label").alias("scored_positives"))
    one = F.lit(True)
    row = counts.join(positives.select(*keys).distinct().agg(F.count("*").alias("positives")), one)
    best = tables.stored(ranking(labelled), "ranking")
    hits = labelled.join(F.broadcast(best), F.col("score") >= F.col("threshold")).agg(F.count_if("label").alias("hits"))
    row = row.join(best, one).join(hits, one)  # every side is one row
    share = F.col("scored_positives") / F.col("units")
    return row.select("units", "positives", (F.col("scored_positives") / F.col("positives")).alias("coverage"), share.alias("prevalence"), "ap", (F.col("ap") / share).alias("lift"), "auc", "f1", "threshold", (F.col("hits") / F.col("positives")).alias("recall_with_unscored"))


def label_units(scored: DataFrame, positives: DataFrame, keys: list[str]) -> DataFrame:
    flags = positives.select(*keys).distinct().withColumn("label", F.lit(True))
    return scored.join(flags, keys, "left").withColumn("label", F.coalesce("label", F.lit(False)))


def ranked(scored: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """The rank of every unit within `by`, highest score first."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *tie)).cast("long"))


def budget_metrics(scored: DataFrame, budget: int, tie: list[str], keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The top `budget` of each day: hits, precision, recall, and the split into machines and humans."""
    top = ranked(scored, [*keys, "day"], tie)
    inside = F.col("rank") <= budget
    g = top.groupBy(*keys).agg(F.count_if(inside).alias("selected"), F.count_if(inside & F.col("label")).alias("hits"), F.count_if("label").alias("positives"), F.count_if(inside & F.col("is_machine")).alias("machines"), F.count_if(inside & F.col("label") & ~F.col("is_machine")).alias("human_hits"))
    return g.withColumns({"precision": F.col("hits") / F.nullif(F.col("selected"), F.lit(0)), "recall": F.col("hits") / F.nullif(F.col("positives"), F.lit(0))})


def hits_per_day(scored: DataFrame, budget: int, tie: list[str], keys: list[str]) -> DataFrame:
    """Per scorer and day: hits in the top, and distinct users among them."""
    hit = ranked(scored, [*keys, "day"], tie).where((F.col("rank") <= budget) & F.col("label"))
    return hit.groupBy(*keys, "day").agg(F.count("*").alias("hits"), F.countDistinct("user").alias("users"))


def user_days(scored: DataFrame) -> DataFrame:
    """Units rolled up to (user, day): the largest score, any label."""
    return scored.groupBy("user", "day").agg(F.max("score").alias("score"), F.bool_or("label").alias("label"), F.max("is_machine").alias("is_machine"), F.min("tie").alias("tie"))


def select_candidate(trials: DataFrame, order: list[Column]) -> DataFrame:
    return trials.orderBy(*order).limit(1)
