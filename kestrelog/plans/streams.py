"""Queries that run the streaming forms over a replay of the log, in several micro-batches, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.functions.clock import day_of
from kestrelog.sources import adapters
from kestrelog.streaming import login, stateful

from .base import AUTH, LINES, SCORES, query
from .history import HISTORY

#: The replay comes in so many parts, one a micro-batch.
PARTS = 4
#: A row is at most so late against rows of its time (seconds); the watermarks allow two hours.
DELAY = 5_400
#: Rows of a part for which it gets another file, so that no task writes a part whole.
FILE_ROWS = 50_000
#: Seconds after the last event at which a closing row lets the watermark pass everything.
CLOSING = 40 * 86_400


def replayed(spark, sf_dir, rows: DataFrame | None = None, at: Column | None = None, closing: bool = True) -> DataFrame:
    """The log as a stream of PARTS micro-batches, rows out of order within DELAY, then a row without a user that closes all windows.

    Rows arrive at their time and a delay that follows from their line; parts are ranges of arrival, written one after the other,
    as the same number of files each, which a micro-batch reads.
    """
    path = tables.fresh_path(spark, "replay")
    log = adapters.auth_events(spark, sf_dir) if rows is None else rows
    arrival = F.col("timestamp") + F.pmod(F.xxhash64("source_line"), F.lit(DELAY)) if at is None else at
    log = tables.stored(log.withColumn("__at", arrival), "arrivals")
    low, high = log.agg(F.min("__at"), F.max("__at")).first()
    low, high = low or 0, high or 0
    inside = [(F.col("__at") >= low + (high - low + 1) * k / PARTS) & (F.col("__at") < low + (high - low + 1) * (k + 1) / PARTS) for k in range(PARTS)]
    sizes = log.agg(*[F.count_if(c) for c in inside]).first()
    files = max(1, min(spark.sparkContext.defaultParallelism, min((n for n in sizes if n), default=0) // FILE_ROWS))  # every part has so many
    for rows_there, n in zip(inside, sizes):
        part = log.where(rows_there).drop("__at")
        part = part.coalesce(1) if files == 1 or not n else part.repartition(files)
        for _ in range(1 if n else files):  # a part without rows is written as one file at a time
            part.sortWithinPartitions(F.xxhash64("source_line")).write.mode("append").parquet(path)
    if closing:
        last = {"timestamp": high + CLOSING, "source_line": -1}
        row = spark.range(1).select(*[F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in log.drop("__at").schema])
        row.write.mode("append").parquet(path)
    return login.replay(spark, path, log.drop("__at").schema, files)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has given when its input is read: all rows in append mode, the last result in complete mode. A batch is a folder."""
    spark = stream.sparkSession
    path, checkpoint = tables.fresh_path(spark, "stream"), tables.fresh_path(spark, "stream-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id if mode == 'append' else 0}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(stream.columns)


@query("streaming_hourly_counts", f"WITH {AUTH} SELECT acting_user, hour, count(*) AS events, count(*) FILTER (authentication_result = 'Fail') AS failures, count(DISTINCT destination_computer) AS destinations FROM auth GROUP BY ALL")
def _(spark, sf_dir):
    return finished(login.hourly_counts(replayed(spark, sf_dir)))


@query("streaming_graph_edges", f"WITH {AUTH}, x AS (SELECT *, unnest(range((timestamp - 1) // 43200, (timestamp - 1) // 43200 + 2)) AS i FROM auth) SELECT (i + 1) * 43200 + 1 AS window_end, acting_user, destination_computer, count(*) FILTER (authentication_result = 'Success') AS successes, count(*) FILTER (authentication_result <> 'Success') AS failures FROM x GROUP BY ALL")
def _(spark, sf_dir):
    return finished(login.graph_edges(replayed(spark, sf_dir)))


_FLAGS = ["prior_auth_count_1h", "prior_failure_count_1h", "seconds_since_previous_auth", "prior_unique_destinations_24h", "prior_user_destination_count_24h", "has_user_history", "is_new_user_destination", "is_new_user_source"]


@query("streaming_history_features", f"WITH {HISTORY} SELECT source_line, {', '.join(_FLAGS)} FROM feat")
def _(spark, sf_dir):
    """Rows in time order per user, over several micro-batches."""
    return finished(login.history_features(replayed(spark, sf_dir, at=F.col("timestamp"), closing=False))).select("source_line", *_FLAGS)


@query("streaming_stateful_features", f"WITH {HISTORY} SELECT source_line, {', '.join(_FLAGS)}, is_new_host_connection FROM feat")
def _(spark, sf_dir):
    """All nine features with rows out of order, by keyed state."""
    stateful.use_rocksdb(spark)
    out = finished(stateful.history_features(replayed(spark, sf_dir)))
    return out.where("acting_user <> ''").select("source_line", *_FLAGS, "is_new_host_connection")


@query("streaming_first_pairs", f"WITH {AUTH} SELECT DISTINCT source_computer, destination_computer FROM auth")
def _(spark, sf_dir):
    return finished(login.first_pairs(replayed(spark, sf_dir, closing=False), ["source_computer", "destination_computer"])).select("source_computer", "destination_computer")


@query("streaming_incidents", f"""WITH {SCORES}, alert AS (SELECT user, hour, seq_score AS score FROM hs WHERE seq_score >= 0.5),
g AS (SELECT *, sum(CASE WHEN hour - before > 10800 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user ORDER BY hour) AS seq FROM (SELECT *, lag(hour) OVER (PARTITION BY user ORDER BY hour) AS before FROM alert))
SELECT user, count(*) AS alert_hours, max(score) AS max_score, min(hour) AS start, max(hour) + 3600 AS "end" FROM g GROUP BY user, seq""")
def _(spark, sf_dir):
    """Sessions of alert hours that end within two hours of the next one's start."""
    hours = adapters.hour_scores(spark, sf_dir).where("seq_score >= 0.5").select("user", "hour", F.col("seq_score").alias("score"), F.col("hour").alias("timestamp"), F.xxhash64("user", "hour").alias("source_line"))
    return finished(login.incidents(replayed(spark, sf_dir, hours).withColumn("hour", F.col("timestamp")))).where("user is not null")


# Every 40th line comes with a delay of a day and a half, every other one in order of its time.
_SLOW = 129_600
_LATE = LINES + f""", pa AS (SELECT source_line, raw, timestamp, reason, (SELECT timestamp FROM auth WHERE auth.source_line = parsed.source_line) AS t FROM parsed),
ar AS (SELECT *, t + CASE WHEN source_line % 40 = 0 THEN {_SLOW} ELSE 0 END AS arrived FROM pa), lim AS (SELECT min(arrived) AS low, max(arrived) - min(arrived) + 1 AS width FROM ar),
ba AS (SELECT ar.*, CAST(floor((arrived - low) * {PARTS}.0 / width) AS INTEGER) AS b FROM ar, lim),
nw AS (SELECT b, max(max(timestamp) FILTER (reason IS NULL)) OVER (ORDER BY b) AS newest FROM ba GROUP BY b)"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = adapters.log_lines(spark, sf_dir, "timestamp")
    at = F.col("timestamp") + F.when(F.col("source_line") % 40 == 0, _SLOW).otherwise(0)
    stream = replayed(spark, sf_dir, lines, at, closing=False).select("source_line", "raw")
    good, late, checkpoint = (tables.fresh_path(spark, f"side-{x}") for x in ("good", "late", "state"))
    login.split_late(stream, good, late, checkpoint, 86_400, raw=True).awaitTermination()
    return spark.read.parquet(good), spark.read.parquet(late)


@query("streaming_side_outputs", f"WITH {_LATE} SELECT source_line, raw, coalesce(reason, 'late') AS reason, b AS batch FROM ba JOIN nw USING (b) WHERE reason IS NOT NULL OR timestamp < newest - 86400")
def _(spark, sf_dir):
    """Rejected and late lines with the batch that put them aside."""
    return _sides(spark, sf_dir)[1].select("source_line", "raw", "reason", F.col("batch").cast("int").alias("batch"))


@query("streaming_good_rows", f"WITH {_LATE} SELECT CAST((timestamp - 1) // 86400 + 1 AS INTEGER) AS dataset_day, count(*) AS rows, count(DISTINCT source_line) AS lines FROM ba JOIN nw USING (b) WHERE reason IS NULL AND timestamp >= newest - 86400 GROUP BY ALL")
def _(spark, sf_dir):
    """Lines that were neither late nor rejected, each once."""
    return _sides(spark, sf_dir)[0].groupBy(day_of(F.col("timestamp")).alias("dataset_day")).agg(F.count("*").alias("rows"), F.countDistinct("source_line").alias("lines"))
