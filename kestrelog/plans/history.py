"""Queries over history features, preprocessing and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.functions.clock import clock_text
from kestrelog.operators import history, preprocess, splits
from kestrelog.sources import adapters

from .base import AUTH, RED, query

SPLIT = "CASE WHEN {0} >= 1 AND {0} < 604801 THEN 'train' WHEN {0} >= 604801 AND {0} < 1382401 THEN 'validation' WHEN {0} >= 1382401 AND {0} < 2592001 THEN 'test' END"


def _prior(alias: str, cond: str, agg: str, seconds: int, keys: str = "b.acting_user = a.acting_user") -> str:
    return f"(SELECT {agg} FROM auth b WHERE {keys} AND b.timestamp >= a.timestamp - {seconds} AND (b.timestamp < a.timestamp OR (b.timestamp = a.timestamp AND b.source_line < a.source_line)){cond}) AS {alias}"


def rolled(alias: str, value: str, seconds: int, keys: str, source: str) -> str:
    """A rolling prior sum as SQL: events and their expiries, running sum of the rows before."""
    return f"""SELECT source_line, coalesce(sum(v) OVER (PARTITION BY {keys} ORDER BY tt, kind, source_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS {alias}, kind FROM
(SELECT {keys}, source_line, timestamp AS tt, 0 AS kind, {value} AS v FROM {source} UNION ALL SELECT {keys}, source_line, timestamp + {seconds}, 1, -({value}) FROM {source})"""


HISTORY = AUTH + f""",
h1 AS ({rolled("prior_auth_count_1h", "1", 3600, "acting_user", "auth")}),
h2 AS ({rolled("prior_failure_count_1h", "CASE WHEN authentication_result = 'Fail' THEN 1 ELSE 0 END", 3600, "acting_user", "auth")}),
h3 AS ({rolled("prior_user_destination_count_24h", "1", 86400, "acting_user, destination_computer", "auth")}),
p AS (SELECT *, lag(timestamp) OVER q AS before, lead(timestamp) OVER q AS next FROM auth WINDOW q AS (PARTITION BY acting_user, destination_computer ORDER BY timestamp, source_line)),
h4 AS (SELECT source_line, kind, coalesce(sum(v) OVER (PARTITION BY acting_user ORDER BY tt, kind, source_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_unique_destinations_24h FROM
 (SELECT acting_user, source_line, timestamp AS tt, 0 AS kind, CASE WHEN before IS NULL OR before < timestamp - 86400 THEN 1 ELSE 0 END AS v FROM p
  UNION ALL SELECT acting_user, source_line, timestamp + 86400, 1, -1 FROM p WHERE next IS NULL OR next > timestamp + 86400)),
nov AS (SELECT *, CAST(timestamp - lag(timestamp) OVER (PARTITION BY acting_user ORDER BY timestamp, source_line) AS DOUBLE) AS seconds_since_previous_auth,
 row_number() OVER (PARTITION BY acting_user, destination_computer ORDER BY timestamp, source_line) = 1 AS is_new_user_destination,
 row_number() OVER (PARTITION BY acting_user, source_computer ORDER BY timestamp, source_line) = 1 AS is_new_user_source,
 row_number() OVER (PARTITION BY source_computer, destination_computer ORDER BY timestamp, source_line) = 1 AS is_new_host_connection,
 ends_with(split_part(acting_user, '@', 1), '$') AS is_machine_account FROM auth),
feat AS (SELECT nov.*, seconds_since_previous_auth IS NOT NULL AS has_user_history, h1.prior_auth_count_1h, h2.prior_failure_count_1h, h3.prior_user_destination_count_24h, h4.prior_unique_destinations_24h,
 timestamp >= 3601 AS history_complete_1h, timestamp >= 86401 AS history_complete_24h FROM nov
 JOIN h1 ON h1.source_line = nov.source_line AND h1.kind = 0 JOIN h2 ON h2.source_line = nov.source_line AND h2.kind = 0
 JOIN h3 ON h3.source_line = nov.source_line AND h3.kind = 0 JOIN h4 ON h4.source_line = nov.source_line AND h4.kind = 0)"""
_RAW = ["source_line", "timestamp", "acting_user", *preprocess.NUMERIC, *preprocess.BINARY]


def auth(spark, sf_dir):
    return adapters.auth_events(spark, sf_dir)


def features(spark, sf_dir):
    return history.history_features(auth(spark, sf_dir))


@query("history_features", f"WITH {HISTORY} SELECT {', '.join(_RAW)} FROM feat")
def _(spark, sf_dir):
    return features(spark, sf_dir).select(*_RAW)


@query("history_rolling_counts", f"WITH {AUTH} SELECT source_line, {_prior('auths', '', 'count(*)', 1800)}, {_prior('fails', chr(32) + 'AND b.authentication_result = ' + chr(39) + 'Fail' + chr(39), 'count(*)', 1800)} FROM auth a")
def _(spark, sf_dir):
    out = history.rolling_sum(auth(spark, sf_dir), ["acting_user"], 1800, F.lit(1), "auths")
    failed = F.when(F.col("authentication_result") == "Fail", 1).otherwise(0)
    return history.rolling_sum(out, ["acting_user"], 1800, failed, "fails").select("source_line", "auths", "fails")


@query("history_rolling_distinct", f"WITH {AUTH} SELECT source_line, {_prior('sources', '', 'count(DISTINCT b.source_computer)', 43200)} FROM auth a")
def _(spark, sf_dir):
    return history.rolling_distinct(auth(spark, sf_dir), ["acting_user"], "source_computer", 43_200, "sources").select("source_line", "sources")


@query("history_novelty", f"WITH {HISTORY} SELECT source_line, is_new_user_destination, is_new_user_source, is_new_host_connection, seconds_since_previous_auth, has_user_history, is_machine_account FROM nov JOIN (SELECT source_line, seconds_since_previous_auth IS NOT NULL AS has_user_history FROM nov) USING (source_line)")
def _(spark, sf_dir):
    return history.novelty(auth(spark, sf_dir)).select("source_line", "is_new_user_destination", "is_new_user_source", "is_new_host_connection", "seconds_since_previous_auth", "has_user_history", "is_machine_account")


@query("history_user_shards")
def _(spark, sf_dir):
    return auth(spark, sf_dir).groupBy(history.user_shard(F.col("acting_user"), 12).alias("shard")).agg(F.count("*").alias("events"), F.countDistinct("acting_user").alias("users"))


@query("history_state_sizes", f"WITH {AUTH} SELECT count(DISTINCT acting_user) AS users, count(DISTINCT destination_computer) AS destinations, count(DISTINCT (acting_user, destination_computer)) AS user_destinations, count(DISTINCT (acting_user, source_computer)) AS user_sources, count(DISTINCT (source_computer, destination_computer)) AS host_pairs FROM auth")
def _(spark, sf_dir):
    return history.state_sizes(auth(spark, sf_dir))


def training(spark, sf_dir, f=None):
    f = features(spark, sf_dir) if f is None else f
    return splits.fitting_events(f.where(splits.split_of(F.col("timestamp")) == "train"), splits.excluded_users(adapters.red_team(spark, sf_dir)))


RED_PART = RED[len(AUTH):]
TRAIN = HISTORY + RED_PART + f""",
ex AS (SELECT DISTINCT user FROM red WHERE timestamp < 604801), train AS (SELECT * FROM feat WHERE timestamp < 604801 AND source_user NOT IN (FROM ex) AND destination_user NOT IN (FROM ex))"""
_STATS = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, avg(ln(1 + {c})) AS mean, stddev_pop(ln(1 + {c})) AS std FROM train" for c in preprocess.NUMERIC)
STATS = TRAIN + f", st0 AS ({_STATS}), st AS (SELECT *, CASE WHEN n <= 1 OR std < 1e-12 THEN 1.0 ELSE std END AS scale FROM st0)"
VOCAB = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS feature, {c} AS value FROM train WHERE {c} <> ''" for c in preprocess.CATEGORICAL)


@query("preprocess_moments", f"WITH {STATS} SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(scale, 6) AS scale FROM st")
def _(spark, sf_dir):
    return preprocess.fit_numeric(training(spark, sf_dir)).select("feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "scale")])


@query("preprocess_vocabulary", f"WITH {TRAIN} SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) + 1 AS INTEGER) AS id FROM ({VOCAB})")
def _(spark, sf_dir):
    return preprocess.fit_vocabulary(training(spark, sf_dir))


@query("preprocess_transform", f"WITH {STATS}, vo AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) + 1 AS id FROM ({VOCAB})) SELECT source_line, "
       + ", ".join(f"CASE WHEN abs(coalesce((ln(1 + {c}) - (SELECT mean FROM st WHERE feature = '{c}')) / (SELECT scale FROM st WHERE feature = '{c}'), 0.0)) < 0.00005 THEN 0.0 ELSE round(coalesce((ln(1 + {c}) - (SELECT mean FROM st WHERE feature = '{c}')) / (SELECT scale FROM st WHERE feature = '{c}'), 0.0), 4) END AS {c}_z" for c in preprocess.NUMERIC) + ", " + ", ".join(f"CAST({c} AS FLOAT) AS {c}_f" for c in preprocess.BINARY) + ", "
       + ", ".join(f"CAST(coalesce((SELECT id FROM vo WHERE feature = '{c}' AND value = f.{c}), 0) AS INTEGER) AS {c}_id" for c in preprocess.CATEGORICAL) + " FROM feat f")
def _(spark, sf_dir):
    raw = tables.stored(features(spark, sf_dir), "features")  # fitted on and transformed: computed once
    train = training(spark, sf_dir, raw)
    out = preprocess.standardise(raw, preprocess.fit_numeric(train))
    out = preprocess.encode(preprocess.binary_inputs(out), tables.stored(preprocess.fit_vocabulary(train), "vocabulary"))
    places = lambda x: F.when(F.round(x, 4) == 0, 0.0).otherwise(F.round(x, 4))  # zero has no sign
    return out.select("source_line", *[places(F.col(f"{c}_z").cast("double")).alias(f"{c}_z") for c in preprocess.NUMERIC], *[f"{c}_f" for c in preprocess.BINARY], *[f"{c}_id" for c in preprocess.CATEGORICAL])


@query("preprocess_fitting_counts", f"""WITH {RED}, ex AS (SELECT DISTINCT user FROM red WHERE timestamp < 604801), x AS (SELECT {SPLIT.format('timestamp')} AS split, timestamp < 604801 AND source_user NOT IN (FROM ex) AND destination_user NOT IN (FROM ex) AS fits FROM auth)
SELECT split, count(*) AS rows, count(*) FILTER (fits) AS fitted, count(*) FILTER (NOT fits) AS skipped FROM x GROUP BY split""")
def _(spark, sf_dir):
    flagged = splits.with_eligibility(auth(spark, sf_dir), splits.excluded_users(adapters.red_team(spark, sf_dir)))
    split = splits.split_of(F.col("timestamp"))
    return preprocess.fitting_counts(flagged.select(split.alias("split"), ((split == "train") & ~F.col("touches_excluded")).alias("fits")))


@query("preprocess_fingerprint", f"WITH {TRAIN}, v AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) + 1 AS id FROM ({VOCAB})) SELECT md5(string_agg(feature || '|' || id || '|' || value, chr(10) ORDER BY feature || '|' || id || '|' || value)) AS fingerprint FROM v")
def _(spark, sf_dir):
    return preprocess.fingerprint(preprocess.fit_vocabulary(training(spark, sf_dir)))


@query("splits_timeline", f"WITH {AUTH} SELECT source_line, dataset_day AS day, hour, (timestamp - 1) // 3600 + 1 AS hour_index, {SPLIT.format('timestamp')} AS split, format('Day {{}} {{:02d}}:{{:02d}}:{{:02d}}', dataset_day, ((timestamp - 1) % 86400) // 3600, ((timestamp - 1) % 3600) // 60, (timestamp - 1) % 60) AS clock FROM auth")
def _(spark, sf_dir):
    t = F.col("timestamp")
    return auth(spark, sf_dir).select("source_line", *splits.timeline(t), splits.split_of(t).alias("split"), clock_text(t).alias("clock"))


@query("splits_excluded_users", f"WITH {RED} SELECT DISTINCT user FROM red WHERE timestamp < 604801")
def _(spark, sf_dir):
    return splits.excluded_users(adapters.red_team(spark, sf_dir))


@query("splits_fitting_events", f"WITH {RED}, ex AS (SELECT DISTINCT user FROM red WHERE timestamp < 604801) SELECT source_line, acting_user, timestamp FROM auth WHERE source_user NOT IN (FROM ex) AND destination_user NOT IN (FROM ex)")
def _(spark, sf_dir):
    return splits.fitting_events(auth(spark, sf_dir), splits.excluded_users(adapters.red_team(spark, sf_dir))).select("source_line", "acting_user", "timestamp")


@query("splits_label_hours", f"WITH {RED} SELECT DISTINCT user, 1 + ((timestamp - 1) // 3600) * 3600 AS hour FROM red WHERE timestamp >= 604801 AND timestamp < 1382401")
def _(spark, sf_dir):
    return splits.positive_hours(adapters.red_team(spark, sf_dir), "validation")


@query("splits_deduplicated_labels", f"WITH {RED}, two AS (SELECT * FROM red UNION ALL SELECT timestamp, user, source_computer, destination_computer, source_line + 500000 FROM red) SELECT timestamp, user, source_computer, destination_computer, min(source_line) AS source_line FROM two GROUP BY ALL")
def _(spark, sf_dir):
    r = adapters.red_team(spark, sf_dir)
    return splits.deduplicate_labels(r.union(r.withColumn("source_line", F.col("source_line") + 500_000)))


@query("splits_replay", f"WITH {AUTH} SELECT source_line, timestamp, acting_user FROM auth WHERE timestamp >= 777601 - 7200 AND timestamp < 864001 ORDER BY timestamp, source_line")
def _(spark, sf_dir):
    return splits.replay(auth(spark, sf_dir), 10, 10, 7200).select("source_line", "timestamp", "acting_user")


@query("splits_candidate_status", f"""WITH {AUTH}, u AS (SELECT acting_user, hour, count(*) AS n, bool_and(timestamp >= 86401) AS complete FROM auth GROUP BY ALL),
s AS (SELECT CASE WHEN hour >= 2419201 THEN 'out_of_bounds' WHEN {SPLIT.format('hour')} IS NULL THEN 'outside_splits' WHEN NOT complete THEN 'warmup_incomplete_24h_history' WHEN n < 2 THEN 'fewer_than_min_events' ELSE 'available' END AS status FROM u)
SELECT status, count(*) AS units FROM s GROUP BY status""")
def _(spark, sf_dir):
    t = F.col("timestamp")
    units = auth(spark, sf_dir).groupBy("acting_user", splits.hour_start(t).alias("hour")).agg(F.count("*").alias("n_events"), F.bool_and(t >= 86_401).alias("complete"))
    return splits.candidate_status(units, 2, 28).groupBy("status").agg(F.count("*").alias("units"))


@query("splits_label_statistics", f"""WITH {RED}, n AS (SELECT *, {SPLIT.format('timestamp')} AS split FROM red) SELECT split, count(*) AS rows, count(DISTINCT (timestamp, user, source_computer, destination_computer)) AS unique_labels,
count(DISTINCT (user, (timestamp - 1) // 3600)) AS units, count(DISTINCT user) AS users, count(DISTINCT source_computer) AS sources, count(DISTINCT destination_computer) AS destinations,
array_to_string(list_sort(list(DISTINCT (timestamp - 1) // 86400 + 1)), ',') AS days, count(*) - count(DISTINCT (timestamp, user, source_computer, destination_computer)) AS duplicates FROM n GROUP BY split""")
def _(spark, sf_dir):
    return splits.label_statistics(adapters.red_team(spark, sf_dir)).withColumn("days", F.array_join(F.col("days").cast("array<string>"), ","))


@query("splits_summary", f"""WITH {RED}, ex AS (SELECT DISTINCT user FROM red WHERE timestamp < 604801), x AS (SELECT *, {SPLIT.format('timestamp')} AS split, source_user IN (FROM ex) OR destination_user IN (FROM ex) AS touch FROM auth)
SELECT split, count(*) AS events, count(*) FILTER (touch) AS touching_excluded, count(*) FILTER (timestamp >= 86401) AS graph_eligible, min(timestamp) AS first, max(timestamp) AS last, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM x GROUP BY split""")
def _(spark, sf_dir):
    return splits.split_summary(auth(spark, sf_dir), splits.excluded_users(adapters.red_team(spark, sf_dir)))


@query("splits_matched_labels", f"""WITH {RED}, lab AS (SELECT timestamp, user, source_computer, destination_computer FROM red UNION SELECT timestamp + 1, user, source_computer, destination_computer FROM red WHERE source_line % 3 = 0),
k AS (SELECT DISTINCT timestamp, acting_user AS user, source_computer, destination_computer, true AS found FROM auth)
SELECT {SPLIT.format('timestamp')} AS split, CAST((timestamp - 1) // 86400 + 1 AS INTEGER) AS day, count(*) AS labels, count(*) FILTER (found) AS matched, count(*) FILTER (found IS NULL) AS unmatched FROM lab LEFT JOIN k USING (timestamp, user, source_computer, destination_computer) GROUP BY ALL""")
def _(spark, sf_dir):
    r = adapters.red_team(spark, sf_dir)
    more = r.where("source_line % 3 = 0").withColumn("timestamp", F.col("timestamp") + 1)
    return splits.matched_labels(r.union(more), auth(spark, sf_dir))


@query("splits_attack_events", f"WITH {RED} SELECT r.timestamp, r.user, r.source_line, a.source_line AS event_line, a.authentication_type, a.authentication_result FROM red r LEFT JOIN auth a ON a.timestamp = r.timestamp AND a.acting_user = r.user AND a.source_computer = r.source_computer AND a.destination_computer = r.destination_computer")
def _(spark, sf_dir):
    out = splits.attack_events(adapters.red_team(spark, sf_dir), auth(spark, sf_dir))
    return out.select("timestamp", "user", "source_line", "event_line", "authentication_type", "authentication_result")
