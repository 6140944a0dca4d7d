"""Hourly counts of users, unit summaries, counting rules and forests of isolation trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions.accounts import is_machine
from kestrelog.functions.clock import day_of, hour_start

COUNTS = ["events", "failures", "sources", "destinations", "new_destinations", "new_sources", "new_hosts", "ntlm", "network", "logon", "either"]
KEYS = ["acting_user", "hour"]


def hourly_counts(events: DataFrame) -> DataFrame:
    """The flagship aggregate: a row per user-hour of events that carry the novelty flags."""
    g = events.withColumn("hour", hour_start(F.col("timestamp"))).groupBy(*KEYS).agg(
        F.count("*").alias("events"), F.count_if(F.col("authentication_result") == "Fail").alias("failures"), F.countDistinct("source_computer").alias("sources"), F.countDistinct("destination_computer").alias("destinations"),
        F.count_if("is_new_user_destination").alias("new_destinations"), F.count_if("is_new_user_source").alias("new_sources"), F.count_if("is_new_host_connection").alias("new_hosts"),
        F.count_if(F.col("authentication_type") == "NTLM").alias("ntlm"), F.count_if(F.col("logon_type") == "Network").alias("network"), F.count_if(F.col("authentication_orientation") == "LogOn").alias("logon"),
        F.count_if(F.col("is_new_user_source") | F.col("is_new_host_connection")).alias("either"), F.min("source_line").alias("tie"),
    )
    return g.withColumns({"day": day_of(F.col("hour")), "is_machine": is_machine(F.col("acting_user"))})


RULES = {"new_user_source": "new_sources", "new_host_connection": "new_hosts", "either": "either"}


def rule_scores(counts: DataFrame) -> DataFrame:
    """(user, hour, day, rule, score): label-free counting rules."""
    renamed = counts.select(F.col("acting_user").alias("user"), "hour", "day", "is_machine", "tie", *[F.col(c).cast("double").alias(r) for r, c in RULES.items()])
    return renamed.unpivot(["user", "hour", "day", "is_machine", "tie"], list(RULES), "rule", "score")


def mode_of(events: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a unit, the first to occur on ties."""
    counted = events.groupBy(*KEYS, column).agg(F.count("*").alias("n"), F.min(F.struct("timestamp", "source_line")).alias("first"))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("n"), "first")
    return counted.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*KEYS, F.col(column).alias(f"mode_{column}"))


def unit_summary(events: DataFrame) -> DataFrame:
    """The 16 values of a user-hour: log count, means, maxima, minimum, rates, three modes, failure rate; besides, the rate of new sources, the machine flag and the lines in order."""
    e = events.withColumn("hour", hour_start(F.col("timestamp")))
    rate = lambda c: F.avg(F.col(c).cast("double"))
    out = e.groupBy(*KEYS).agg(
        F.log1p(F.count("*").cast("double")).alias("log_count"), F.avg("prior_auth_count_1h").alias("mean_prior_auths"), F.max("prior_auth_count_1h").alias("max_prior_auths"), F.avg("prior_failure_count_1h").alias("mean_prior_failures"), F.max("prior_failure_count_1h").alias("max_prior_failures"),
        F.avg("seconds_since_previous_auth").alias("mean_gap"), F.min("seconds_since_previous_auth").alias("min_gap"), F.max("prior_unique_destinations_24h").alias("max_destinations"), F.max("prior_user_destination_count_24h").alias("max_user_destination"), rate("has_user_history").alias("rate_history"),
        rate("is_new_user_destination").alias("rate_new_destination"), rate("is_new_user_source").alias("rate_new_source"), rate("is_new_host_connection").alias("rate_new_host"), rate("is_machine_account").alias("machine"),
        F.avg((F.col("authentication_result") == "Fail").cast("double")).alias("failure_rate"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "source_line"))), lambda x: x["source_line"].cast("string"))).alias("lines"),
    )
    for c in ("authentication_type", "logon_type", "authentication_orientation"):
        out = out.join(mode_of(e, c), KEYS)
    return out


def tie_order(seed: int, *columns: str) -> Column:
    """A fixed order among equal scores: a digest of the seed and the columns."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def compare_scorings(a: DataFrame, b: DataFrame, keys: list[str], k: int, tolerance: float, flag: str | None = None) -> DataFrame:
    """One row about two scorings (keys, score, flag): whether units and flags agree, the largest difference, whether the top k are the same sets. Scores that differ by the tolerance agree."""
    flag = flag or "__flag"
    a, b = (x if flag in x.columns else x.withColumn(flag, F.lit(False)) for x in (a, b))
    both = a.withColumnsRenamed({"score": "a", flag: "fa"}).join(b.withColumnsRenamed({"score": "b", flag: "fb"}), keys, "full_outer")
    stats = both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"), F.count_if(F.col("fa") != F.col("fb")).alias("flags_differ"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"))
    top = [x.orderBy(F.desc("score"), *keys).limit(k).select(*keys) for x in (a, b)]
    differ = top[0].exceptAll(top[1]).union(top[1].exceptAll(top[0])).agg(F.count("*").alias("top_differ"))
    return stats.join(differ, F.lit(True)).withColumn("agrees", (F.col("unmatched") == 0) & (F.col("flags_differ") == 0) & (F.col("largest") <= tolerance) & (F.col("top_differ") == 0))  # one row each


# ---- isolation forest ----

TREES, SAMPLE = 50, 256


def grow_trees(df: DataFrame, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """Trees as a table (tree, node, feature, cut, size): node 1 is the root, 2n and 2n + 1 the sides; leaves have no feature.

    Each tree sees the `sample` rows that its own hash puts first; a row is hashed for a tree only if a
    coin that admits twice the sample on average says so.
    """
    n = df.count()
    chance = min(1.0, 2.0 * sample / max(n, 1))
    key = F.xxhash64(*columns, *[c for c in ("tie",) if c in df.columns])
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], key.alias("__k"), tree).withColumn("__h", F.xxhash64(F.lit(seed), "tree", "__k"))
    rows = rows.where(F.pmod("__h", F.lit(1_000_003)) < F.lit(chance * 1_000_003))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("tree").orderBy("__h"))).where(F.col("__n") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        rng, values, out = np.random.default_rng(seed * 1000 + number), pdf.sort_values("__n")[columns].to_numpy(), []
        depth = int(np.ceil(np.log2(max(sample, 2))))
        stack = [(1, values, 0)]
        while stack:
            node, x, level = stack.pop()
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and level < depth else []
            if not len(spread):
                out.append((number, node, -1, 0.0, len(x)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            side = x[:, f] < cut
            out.append((number, node, f, cut, len(x)))
            stack += [(2 * node, x[side], level + 1), (2 * node + 1, x[~side], level + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size"])

    return rows.select("tree", "__n", *columns).groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, size int")


def _path(n: np.ndarray) -> np.ndarray:
    """The mean path of an unsuccessful search among n."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def isolation_scores(df: DataFrame, trees: DataFrame, columns: list[str], sample: int = SAMPLE) -> DataFrame:
    """df with score in (0, 1): larger is easier to isolate. trees is bounded by its number and sample size."""
    grown = trees.toPandas()
    tables = [g.sort_values("node").reset_index(drop=True) for _, g in grown.groupby("tree")]
    fields = df.schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, total = pdf[columns].to_numpy(float), np.zeros(len(pdf))
            for t in tables:
                nodes, feature, cut, size = (t[c].to_numpy() for c in ("node", "feature", "cut", "size"))
                at, depth, live = np.ones(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), bool)
                while live.any():
                    i = np.searchsorted(nodes, at[live])
                    leaf = feature[i] < 0
                    rows = np.flatnonzero(live)
                    done = rows[leaf]
                    total[done] += depth[done] + _path(size[i[leaf]])
                    live[done] = False
                    rows, i = rows[~leaf], i[~leaf]
                    at[rows] = 2 * at[rows] + (x[rows, feature[i]] >= cut[i])
                    depth[rows] += 1
            yield pdf[fields].assign(score=np.exp2(-total / max(len(tables), 1) / max(float(_path(np.array([sample]))[0]), 1e-9)))

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", score double")
