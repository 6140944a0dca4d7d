"""Alignment of two detectors by time, and fusion of their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE = 86_400
WARMUP_END = 86_401
TAU = 21_600
CAP = 0.9999


def universe(*units: DataFrame) -> DataFrame:
    """The distinct (user, hour) units of all sources."""
    out = units[0].select("user", "hour")
    for u in units[1:]:
        out = out.union(u.select("user", "hour"))
    return out.distinct()


def asof(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], tie: str) -> DataFrame:
    """left with the latest right row at or before its time.

    Both sides run through one window per key, right rows first at equal times; of right rows
    with one time the one with the larger tie is taken.
    """
    fields = left.columns
    one = left.select(F.col(by), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.struct(*fields).alias("__left"), F.lit(None).cast(right.select(F.struct(*values, right_time).alias("x")).schema["x"].dataType).alias("__right"))
    two = right.select(F.col(by), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.lit(None).cast(left.select(F.struct(*fields).alias("x")).schema["x"].dataType).alias("__left"), F.struct(*values, right_time).alias("__right"))
    w = Window.partitionBy(by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    joined = one.unionByName(two).withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    return joined.select("__left.*", *[F.col(f"__found.{v}").alias(v) for v in (*values, right_time)])


def align(sequence: DataFrame, graph: DataFrame, units: DataFrame | None = None, seq_threshold: float = 0.5, graph_threshold: float = 0.5) -> DataFrame:
    """Sequence rows (user, hour, seq_score, seq_status) and graph rows (user, available_at, graph_score, graph_status, tie) -> aligned units.

    A unit sees only graph rows that were available by its end; one older than a day is stale.
    Scores and alert flags of rows that are stale or whose status is not available are null.
    A row's own flag (seq_alert, graph_alert, where such a column is there) counts; without one
    the score is held against the threshold.
    """
    base = (units if units is not None else universe(sequence)).join(sequence, ["user", "hour"], "left").withColumn("window_end", F.col("hour") + 3600)
    own = ["graph_alert"] if "graph_alert" in graph.columns else []
    found = asof(base, graph, "user", "window_end", "available_at", ["graph_score", "graph_status", *own], "tie")
    stale = F.coalesce(F.col("window_end") - F.col("available_at") > STALE, F.lit(False))
    found = found.withColumn("stale", stale)
    seq_ok, graph_ok = F.col("seq_status") == "available", (F.col("graph_status") == "available") & ~F.col("stale")
    found = found.withColumns({"seq_score": F.when(seq_ok, F.col("seq_score")), "graph_score": F.when(graph_ok, F.col("graph_score"))})
    flag = lambda name, default: F.coalesce(F.col(name), default) if name in found.columns else default
    found = found.withColumns({
        "is_seq_alert": F.when(seq_ok, flag("seq_alert", F.col("seq_score") >= seq_threshold)),
        "is_graph_alert": F.when(graph_ok, flag("graph_alert", F.col("graph_score") >= graph_threshold)),
    })
    seq, gra = F.col("seq_score").isNotNull(), F.col("graph_score").isNotNull()
    warm = (F.col("window_end") <= WARMUP_END) | (F.col("seq_status") == "warmup") | ((F.col("graph_status") == "warmup") & ~F.col("stale"))
    status = F.when(F.coalesce(warm, F.lit(False)), "insufficient_history").when(seq & gra, "both").when(seq & F.col("stale"), "stale_graph").when(seq, "sequence_only").when(gra, "graph_only").otherwise("no_activity")
    return found.withColumn("alignment_status", status)


def check_no_leak(aligned: DataFrame) -> DataFrame:
    """Fails if a graph score was used before it was available."""
    if aligned.where("available_at > window_end").limit(1).count():
        raise ValueError("a graph score from the future")
    return aligned


def disagreement(seq_alert: Column, graph_alert: Column) -> Column:
    s, g = F.coalesce(seq_alert, F.lit(False)), F.coalesce(graph_alert, F.lit(False))
    return F.when(seq_alert.isNull() & graph_alert.isNull(), "unavailable").when(s & g, "concordant_alert").when(s, "sequence_only_alert").when(g, "graph_only_alert").otherwise("concordant_normal")


def fuse(aligned: DataFrame, rule: str = "max", seq_weight: float = 0.5, renormalise: bool = True) -> DataFrame:
    """Adds base, weight_seq and weight_graph by max, average or weighted; one score alone is used as it is, or scaled by its weight."""
    s, g = F.col("seq_score"), F.col("graph_score")
    both = s.isNotNull() & g.isNotNull()
    if rule == "max":
        ws = F.when(both, F.when(s >= g, 1.0).otherwise(0.0))
    else:
        ws = F.when(both, F.lit(0.5 if rule == "average" else seq_weight))
    alone = 1.0 if renormalise or rule != "weighted" else None
    ws = F.when(both, ws).when(s.isNotNull(), F.lit(alone if alone is not None else seq_weight)).when(g.isNotNull(), 0.0)
    wg = F.when(both, 1 - ws).when(g.isNotNull(), F.lit(alone if alone is not None else 1 - seq_weight)).when(s.isNotNull(), 0.0)
    base = F.when(s.isNotNull() | g.isNotNull(), F.coalesce(s, F.lit(0.0)) * F.col("weight_seq") + F.coalesce(g, F.lit(0.0)) * F.col("weight_graph"))
    return aligned.withColumns({"weight_seq": ws, "weight_graph": wg}).withColumns({"base": base, "disagreement": disagreement(F.col("is_seq_alert"), F.col("is_graph_alert"))})


def temporal(fused: DataFrame, lookback: int = 86_400, weight: float = 0.15, tau: int = TAU, alert: float = 0.999) -> DataFrame:
    """Adds the boost weight * exp(-gap / tau), who led and by how much, the fused score and its alert.

    gap is the least distance between any sequence alert and any graph alert of the user in the
    last `lookback` seconds, the unit's own included; the lead compares their earliest alerts.
    """
    w = Window.partitionBy("user").orderBy("hour").rangeBetween(-lookback, 0)
    times = lambda c: F.collect_list(F.when(F.col(c), F.col("hour"))).over(w)
    held = fused.withColumns({"__s": times("is_seq_alert"), "__g": times("is_graph_alert")})
    gap = F.array_min(F.transform("__s", lambda a: F.array_min(F.transform("__g", lambda b: F.abs(a - b)))))
    first_s, first_g = F.array_min("__s"), F.array_min("__g")
    lead = F.when(first_s.isNull() | first_g.isNull(), None).when(first_s < first_g, "sequence").when(first_g < first_s, "graph").otherwise("simultaneous")
    boost = F.coalesce(weight * F.exp(-gap / tau), F.lit(0.0))
    out = held.withColumns({"boost": boost, "lead": lead, "lead_seconds": F.abs(first_s - first_g)}).drop("__s", "__g")
    total = F.when(F.col("base").isNotNull(), F.least(F.col("base") + F.col("boost"), F.lit(CAP)))  # without a score there is nothing to alert on
    return out.withColumn("fused", total).withColumn("is_alert", F.col("fused") >= alert)


def day_temporal(days: DataFrame) -> DataFrame:
    """(user, day, seq_score, seq_first_alert, graph_score) -> with the graph score of the day before and the lead in seconds since day start."""
    before = days.select("user", (F.col("day") + 1).alias("day"), F.col("graph_score").alias("graph_before"))
    out = days.join(before, ["user", "day"], "left")
    lead = F.when(F.col("seq_first_alert").isNotNull() & (F.col("graph_before") >= 0.5), F.col("seq_first_alert") - ((F.col("day") - 1) * 86_400 + 1))
    return out.withColumn("lead_seconds", lead)


def grid(aligned: DataFrame, settings: list[tuple[str, str, float, tuple[float, int] | None]]) -> DataFrame:
    """One row per unit and setting (name, rule, seq_weight, (boost, tau) or None): (setting, user, hour, score)."""
    out = None
    for name, rule, weight, boost in settings:
        fused = fuse(aligned, rule, weight)
        score = F.col("base")
        if boost is not None:
            fused, score = temporal(fused, weight=boost[0], tau=boost[1]), F.col("fused")
        part = fused.select(F.lit(name).alias("setting"), "user", "hour", score.alias("score"))
        out = part if out is None else out.union(part)
    return out


def fusion_features(fused: DataFrame) -> DataFrame:
    """The four inputs of a supervised fusion: both scores, boost, log lead; missing values are 0."""
    zero = F.lit(0.0)
    return fused.withColumns({"x_seq": F.coalesce("seq_score", zero), "x_graph": F.coalesce("graph_score", zero), "x_boost": F.coalesce("boost", zero), "x_lead": F.log1p(F.coalesce(F.col("lead_seconds").cast("double"), zero))})
