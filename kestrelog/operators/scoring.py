"""Event losses from training statistics, and their reductions to chunks and units.

Losses come in the families squared error (numbers), binary cross-entropy (flags) and
cross-entropy (categories, alone and given the one before in the hour), with add-one smoothing.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import UNIT, in_hour

LOSSES = ["gap", "new_host", "auth_type", "logon_after"]


def previous_logon() -> Column:
    return F.coalesce(F.lag("logon_type").over(in_hour()), F.lit("<start>"))


def fit(train: DataFrame) -> dict[str, DataFrame]:
    """Statistics of training events (with hour, position, gap, is_new_host_connection): each a small table."""
    numbers = train.agg(F.avg(F.log1p("gap")).alias("mean"), ((F.count_if("is_new_host_connection") + 1) / (F.count("*") + 2)).alias("p_new"), F.count("*").alias("n"), F.countDistinct("authentication_type").alias("d_auth"), F.countDistinct("logon_type").alias("d_logon"))
    types = train.groupBy("authentication_type").agg(F.count("*").alias("n_auth"))
    pairs = train.withColumn("before", previous_logon()).groupBy("before", "logon_type").agg(F.count("*").alias("n_pair"))
    return {"numbers": numbers, "types": types, "pairs": pairs, "before": pairs.groupBy("before").agg(F.sum("n_pair").alias("n_before"))}


def losses(events: DataFrame, fitted: dict[str, DataFrame]) -> DataFrame:
    """events with an array `losses` in the order of LOSSES."""
    s = fitted["numbers"].first()
    joined = events.withColumn("before", previous_logon())
    for name, keys in (("types", ["authentication_type"]), ("pairs", ["before", "logon_type"]), ("before", ["before"])):
        joined = joined.join(F.broadcast(fitted[name]), keys, "left")  # a row for each category or pair of categories
    zero = F.lit(0).cast("long")
    gap = F.coalesce(F.pow(F.log1p("gap") - F.lit(s.mean), F.lit(2.0)), F.lit(0.0))
    flag = F.when(F.col("is_new_host_connection"), -F.log(F.lit(s.p_new))).otherwise(-F.log(F.lit(1 - s.p_new)))
    kind = -F.log((F.coalesce("n_auth", zero) + 1) / F.lit(float(s.n + s.d_auth + 1)))
    after = -F.log((F.coalesce("n_pair", zero) + 1) / (F.coalesce("n_before", zero) + s.d_logon + 1))
    return joined.withColumn("losses", F.array(gap, flag, kind, after)).drop("n_auth", "n_pair", "n_before", "before")


def scaled(scored: DataFrame, means: DataFrame) -> DataFrame:
    """Losses over their mean training loss; means is one row with an array."""
    scale = means.first()[0]
    return scored.withColumn("losses", F.zip_with("losses", F.array(*map(F.lit, scale)), lambda x, m: F.when(m > 0, x / m).otherwise(x)))


def mean_losses(scored: DataFrame) -> DataFrame:
    """One row: the mean of each loss."""
    return scored.agg(F.array(*[F.avg(F.col("losses")[i]) for i in range(len(LOSSES))]).alias("means"))


def event_error(scored: DataFrame) -> DataFrame:
    """The mean loss of an event, and the first feature with the largest."""
    mean = F.aggregate("losses", F.lit(0.0), lambda a, x: a + x) / F.size("losses")
    return scored.withColumns({"error": mean, "top_feature": F.element_at(F.array(*map(F.lit, LOSSES)), F.array_position("losses", F.array_max("losses")).cast("int"))})


def chunk_errors(errors: DataFrame) -> DataFrame:
    """Mean error of each chunk and mean of each loss in it; errors has chunk, error, losses."""
    return errors.groupBy(*UNIT, "chunk").agg(F.avg("error").alias("chunk_mean"), F.count("*").alias("n"), *[F.avg(F.col("losses")[i]).alias(f"loss_{name}") for i, name in enumerate(LOSSES)])


def unit_scores(errors: DataFrame) -> DataFrame:
    """max_chunk_mean, max_event and hour_mean of each unit, with the evidence chunks.

    best_chunk has the highest mean (the lowest index on ties); worst_chunk holds the earliest
    event with the largest error.
    """
    per = errors.groupBy(*UNIT, "chunk").agg(F.avg("error").alias("m"), F.sum("error").alias("s"), F.count("*").alias("n"), F.max("error").alias("x"), F.max_by("position", F.struct("error", -F.col("position"))).alias("at"))
    return per.groupBy(*UNIT).agg(
        F.max("m").alias("max_chunk_mean"), F.max("x").alias("max_event"), (F.sum("s") / F.sum("n")).alias("hour_mean"), F.max_by("chunk", F.struct("m", -F.col("chunk"))).alias("best_chunk"), F.max_by("chunk", F.struct("x", -F.col("at"))).alias("worst_chunk")
    )


def top_events(errors: DataFrame, k: int) -> DataFrame:
    """The k events of a unit with the largest errors, earlier positions first on ties, as (unit, events array)."""
    w = Window.partitionBy(*UNIT).orderBy(F.desc("error"), "position")
    best = errors.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.groupBy(*UNIT).agg(F.sort_array(F.collect_list(F.struct("rank", "source_line", "error", "top_feature"))).alias("events"))


def feature_shares(chunk_rows: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """The k losses with the largest share in a unit's evidence chunk (evidence: unit, chunk)."""
    names = [f"loss_{n}" for n in LOSSES]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    share = lambda n: F.when(total > 0, F.col(n) / total).otherwise(0.0)
    rows = chunk_rows.join(evidence, [*UNIT, "chunk"]).select(*UNIT, F.explode(F.array(*[F.struct(F.lit(n[5:]).alias("feature"), share(n).alias("share")) for n in names])).alias("x"))
    ranked = rows.select(*UNIT, "x.*").withColumn("rank", F.row_number().over(Window.partitionBy(*UNIT).orderBy(F.desc("share"), "feature")))
    return ranked.where(F.col("rank") <= k)


def detector_rows(units: DataFrame, scores: DataFrame, aggregation: str) -> DataFrame:
    """units (status, ...) with the score of one aggregation; null unless available."""
    joined = units.join(scores, UNIT, "left")
    return joined.select(*UNIT, "status", "n_events", F.when(F.col("status") == "available", F.col(aggregation)).alias("score"))


def unpivot_scores(scores: DataFrame, columns: list[str]) -> DataFrame:
    """(unit, model, score) for several scorers of the same units."""
    return scores.unpivot(UNIT, columns, "model", "score")


def case_sample(scored: DataFrame, per_case: int) -> DataFrame:
    """Per day: rows nearest to the day's median score, the highest, and the longest; scored has day, score, n_events."""
    named = scored.join(scored.groupBy("day").agg(F.percentile("score", 0.5).alias("median")), "day")
    cases = {"median": [F.abs(F.col("score") - F.col("median"))], "top": [F.desc("score")], "long": [F.desc("n_events")]}
    out = None
    for case, order in cases.items():
        w = Window.partitionBy("day").orderBy(*order, *UNIT)
        part = named.withColumns({"case": F.lit(case), "rank": F.row_number().over(w)}).where(F.col("rank") <= per_case)
        out = part if out is None else out.union(part)
    return out


def reconstruction_error(df: DataFrame, columns: list[str], k: int, train: DataFrame | None = None) -> DataFrame:
    """df with error: squared distance to its projection on the first k principal components of the standardised training columns."""
    assembler = VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="keep")
    fitted = assembler.transform(train if train is not None else df)
    scaler = StandardScaler(inputCol="__raw", outputCol="__z", withMean=True).fit(fitted)
    pca = PCA(k=k, inputCol="__z", outputCol="__p").fit(scaler.transform(fitted))
    parts = pca.pc.toArray()
    out = pca.transform(scaler.transform(assembler.transform(df))).withColumns({"__za": vector_to_array("__z"), "__pa": vector_to_array("__p")})
    back = [sum((F.col("__pa")[j] * float(parts[i, j]) for j in range(1, k)), F.col("__pa")[0] * float(parts[i, 0])) for i in range(len(columns))]
    error = sum((F.pow(F.col("__za")[i] - b, F.lit(2.0)) for i, b in enumerate(back)), F.lit(0.0))
    return out.withColumn("error", error).drop("__raw", "__z", "__p", "__za", "__pa")
