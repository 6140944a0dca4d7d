"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of token weight. Each round scales the
cells' weights to the target share of every source, then of every language, then of every
topic. A cell's factor is its raked weight over its own; a document is kept with probability
min(1, rate * factor) and carries the rest as a weight, so that kept tokens times weight meet
the targets in expectation. Everything is DataFrame operations; cells, not documents, are raked.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, containment

#: Rounds go on until no share is further from its target than TOLERANCE, ROUNDS at most.
ROUNDS = 200
TOLERANCE = 1e-11
RATE = 1.0
#: Default targets are the corpus's own shares to this power, evened out: 1 keeps them, 0 makes all equal.
TEMPER = 0.7
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A topic by form: tables, legal notices, contact details, else prose. Null texts are prose."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(" | "), "table").when(text.contains("icense"), "legal").when(text.contains("@"), "contact").otherwise("prose")


def token_weight(text: Column) -> Column:
    """Tokens at four bytes each, one at least: what a document weighs."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens); a null source or language is a value of its own."""
    named = [F.coalesce(F.col(c), F.lit(NONE)).alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", *named, topic_of(F.col("text")).alias("topic"), token_weight(F.col("text")).alias("tokens"))


def tempered_targets(cells: DataFrame, power: float = TEMPER) -> dict[str, DataFrame]:
    """For each dimension, (value, share): the corpus's token shares to the power, scaled to sum to one."""
    out = {}
    for c in DIMENSIONS:
        raised = cells.groupBy(F.col(c).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("x"))
        total = raised.agg(F.sum("x")).first()[0]
        out[c] = raised.select("value", (F.col("x") / F.lit(total)).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, strict: bool = False) -> DataFrame:
    """cells (source, lang, topic, tokens) -> the same with factor, the raked share over the cell's own share.

    A value without a target keeps its own share of the weight it had. Where the cells can't meet
    all targets at once the rounds end without agreement: that is an error if strict, else a warning
    that states the largest distance left (see also residual).
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0]
    at = cells.withColumn("own", F.col("tokens") / F.lit(total)).withColumn("w", F.col("own"))
    for c in DIMENSIONS:
        shares = targets[c].select(F.col("value").alias(c), F.col("share").alias(f"share_{c}"))
        at = at.join(containment.checked(shares), c, "left")
    at, left = at.checkpoint(), float("inf")
    for _ in range(rounds):
        for c in DIMENSIONS:
            held = F.sum("w").over(Window.partitionBy(c))
            at = at.withColumn("w", F.col("w") * F.coalesce(F.col(f"share_{c}") / held, F.lit(1.0)))
        at = at.checkpoint()
        each = at.select("w", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.col(f"share_{c}").alias("share")) for c in DIMENSIONS])).alias("d"))
        held = each.where("d.share is not null").groupBy("d").agg(F.sum("w").alias("w"))
        left = held.agg(F.max(F.abs(F.col("w") - F.col("d.share")))).first()[0] or 0.0
        if left <= tolerance:
            break
    else:
        if rounds and strict:
            raise ValueError(f"after {rounds} rounds a share is still {left:.3g} from its target")
        if rounds:
            warnings.warn(f"after {rounds} rounds a share is still {left:.3g} from its target", stacklevel=2)
    return at.select(*DIMENSIONS, "tokens", (F.col("w") / F.col("own")).alias("factor"))


def residual(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest distance of a raked share from its target over all values of all dimensions: how far raking is from done."""
    total = raked.agg(F.sum(F.col("tokens") * F.col("factor"))).first()[0] or 1.0
    worst = 0.0
    for c in DIMENSIONS:
        got = raked.groupBy(F.col(c).alias("value")).agg((F.sum(F.col("tokens") * F.col("factor")) / F.lit(total)).alias("got"))
        worst = max(worst, got.join(targets[c], "value").agg(F.max(F.abs(F.col("got") - F.col("share")))).first()[0] or 0.0)
    return worst


def cell_factors(keys: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """keyed() rows -> (source, lang, topic, factor)."""
    cells = keys.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).checkpoint()
    return rake(cells, targets or tempered_targets(cells), rounds).drop("tokens")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that follows from the id alone; null ids share one."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """documents -> (doc_id, source, lang, topic, tokens, probability, weight) for every row."""
    keys = keyed(docs)
    factors = cell_factors(keys, targets, rounds)
    wanted = F.col("factor") * F.lit(rate)
    joined = keys.join(containment.checked(factors), list(DIMENSIONS))
    chance = F.least(F.lit(1.0), wanted)
    return joined.select("doc_id", *DIMENSIONS, "tokens", chance.alias("probability"), (wanted / chance).alias("weight"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """The sampled rows of calibrated(): those whose uniform number is below their probability.

    The choice follows from the id, so it is the same in every run, and copies of an id are
    chosen together. Null texts weigh one token. An empty table gives no rows. Other columns
    are ignored.
    """
    return calibrated(docs, targets, rate, rounds).where(uniform(F.col("doc_id")) < F.col("probability"))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE) -> DataFrame:
    """docs with its own columns, each row as often as its factor asks, so that the rows themselves meet the targets.

    A row comes floor(rate * factor) times, and once more with the remainder's probability. The
    ids are those of sample(), which keeps a row once and carries the rest as a weight. A null or
    empty text weighs one token; null sources and languages are values of their own; null ids
    share one number and are chosen together, as are repeated ids; an empty table stays empty.
    """
    factors = cell_factors(keyed(docs), targets)
    chance = containment.checked(factors.select(*[F.col(c).alias(f"__{c}") for c in DIMENSIONS], (F.col("factor") * rate).alias("__chance")))
    named = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce("source", F.lit(NONE)).alias("__source"), F.coalesce("lang", F.lit(NONE)).alias("__lang"), topic_of(F.col("text")).alias("__topic"))
    whole = F.floor("__chance").cast("int")
    times = whole + (uniform(F.col("__row.doc_id")) < F.col("__chance") - whole).cast("int")
    joined = named.join(chance, ["__source", "__lang", "__topic"]).withColumn("__times", times).where("__times > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample(common.table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("probability", "weight")})


#: More rounds than the tolerance asks for on the given tables.
SQL_ROUNDS = 20


def _sql() -> str:
    parts = [
        f"""k AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), 'icense') THEN 'legal' WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS topic,
  greatest(1, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT)) AS tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM k GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"t_{d} AS (SELECT {d}, pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) OVER () AS share_{d} FROM c GROUP BY {d})")
    parts.append("w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS own, tokens / sum(tokens) OVER () AS w FROM c " + " ".join(f"JOIN t_{d} USING ({d})" for d in DIMENSIONS) + ")")
    for i in range(SQL_ROUNDS * 3):
        d = DIMENSIONS[i % 3]
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT * REPLACE (w * share_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{i})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, k.tokens AS tokens, round(least(1.0, w / own * {RATE}), 6) AS probability, round(w / own * {RATE} / least(1.0, w / own * {RATE}), 6) AS weight
FROM k JOIN w{SQL_ROUNDS * 3} z USING (source, lang, topic)
WHERE CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < least(1.0, w / own * {RATE})"""


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL = {"op10_mixing": _sql()}
