"""Queries over sources: parsing, rejects, reconciliation, profiles, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.functions.accounts import reference
from kestrelog.functions.clock import hour_start
from kestrelog.operators import sketches
from kestrelog.sources import adapters, authlog

from .base import AUTH, LINES, RED, query

CATEGORIES = ["authentication_type", "logon_type", "authentication_orientation", "authentication_result"]


def parsed(spark, sf_dir):
    return authlog.parse(adapters.log_lines(spark, sf_dir))


@query("ingest_rejections", f"WITH {LINES} SELECT source_line, reason, raw AS raw_record FROM parsed WHERE reason IS NOT NULL")
def _(spark, sf_dir):
    return authlog.rejections(parsed(spark, sf_dir))


@query("ingest_reject_reasons", f"WITH {LINES} SELECT reason, count(*) AS n FROM parsed WHERE reason IS NOT NULL GROUP BY reason")
def _(spark, sf_dir):
    return authlog.rejections(parsed(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@query("ingest_accepted", f"""WITH {LINES} SELECT source_line, timestamp, x[2] AS source_user, x[3] AS destination_user, x[4] AS source_computer, x[5] AS destination_computer, x[6] AS authentication_type,
x[7] AS logon_type, x[8] AS authentication_orientation, x[9] AS authentication_result, x[2] AS acting_user, CAST((timestamp - 1) // 86400 + 1 AS INTEGER) AS dataset_day, 'auth.txt:' || source_line AS source_reference,
row_number() OVER (PARTITION BY raw ORDER BY source_line)::INTEGER AS exact_duplicate_ordinal FROM parsed WHERE reason IS NULL AND (timestamp - 1) // 86400 + 1 BETWEEN 1 AND 16""")
def _(spark, sf_dir):
    return authlog.with_duplicate_ordinal(authlog.accepted(parsed(spark, sf_dir), 1, 16)).drop("raw")


@query("ingest_reconcile", f"""WITH {LINES}, ok AS (SELECT raw FROM parsed WHERE reason IS NULL AND (timestamp - 1) // 86400 + 1 BETWEEN 1 AND 16), g AS (SELECT raw, count(*) AS n FROM ok GROUP BY raw HAVING count(*) > 1)
SELECT count(*) AS scanned, count(*) FILTER (reason IS NULL AND (timestamp - 1) // 86400 + 1 BETWEEN 1 AND 16) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected,
count(*) FILTER (reason IS NULL AND (timestamp - 1) // 86400 + 1 NOT BETWEEN 1 AND 16) AS out_of_scope, (SELECT count(*) FROM g) AS duplicate_groups, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM g) AS duplicate_instances FROM parsed""")
def _(spark, sf_dir):
    return authlog.reconcile(parsed(spark, sf_dir), 1, 16)


@query("ingest_order_inversions", f"WITH {AUTH}, x AS (SELECT source_line, CASE WHEN source_line % 500 = 0 THEN greatest(1, timestamp - 900000) ELSE timestamp END AS timestamp FROM auth) SELECT source_line, timestamp, previous FROM (SELECT source_line, timestamp, lag(timestamp) OVER (ORDER BY source_line) AS previous FROM x) WHERE timestamp < previous")
def _(spark, sf_dir):
    """The log with every 500th line set back in time."""
    t = F.when(F.col("source_line") % 500 == 0, F.greatest(F.lit(1), F.col("timestamp") - 900_000)).otherwise(F.col("timestamp"))
    return authlog.order_inversions(adapters.auth_events(spark, sf_dir).withColumn("timestamp", t), 1000)


@query("ingest_text_file", f"WITH {LINES}, o AS (SELECT source_line AS line, raw, row_number() OVER (ORDER BY source_line) AS source_line FROM lines) SELECT source_line, raw FROM o")
def _(spark, sf_dir):
    """The log written as text and read back with its line numbers."""
    path = tables.fresh_path(spark, "auth-text")
    adapters.log_lines(spark, sf_dir).repartitionByRange(4, "source_line").sortWithinPartitions("source_line").select("raw").write.text(path)
    return authlog.read_lines(spark, path)


@query("ingest_line_map", f"WITH {LINES} SELECT source_line * 2 AS source_line, raw FROM lines")
def _(spark, sf_dir):
    lines = adapters.log_lines(spark, sf_dir)
    return authlog.apply_line_map(lines, lines.select("source_line", (F.col("source_line") * 2).alias("mapped")), 1000).select("source_line", "raw")


@query("ingest_rejection_file", f"WITH {LINES} SELECT source_line, reason, raw AS raw_record FROM parsed WHERE reason IS NOT NULL")
def _(spark, sf_dir):
    path = tables.fresh_path(spark, "rejections")
    authlog.write_rejections(parsed(spark, sf_dir), path)
    return authlog.read_rejections(spark, path)


@query("ingest_day_parts", f"WITH {AUTH} SELECT dataset_day, count(*) AS rows, min(timestamp) AS first, max(timestamp) AS last FROM auth GROUP BY 1")
def _(spark, sf_dir):
    """The log written by day, and its parts' manifest summed by day."""
    path = tables.fresh_path(spark, "auth-days")
    authlog.write_days(adapters.auth_events(spark, sf_dir), path)
    day = F.regexp_extract("part", "dataset_day=([0-9]+)", 1).cast("int").alias("dataset_day")
    return authlog.manifest(spark, path).groupBy(day).agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))


@query("ingest_category_counts", "WITH " + AUTH + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM auth GROUP BY {c}" for c in CATEGORIES))
def _(spark, sf_dir):
    return authlog.category_counts(adapters.auth_events(spark, sf_dir), CATEGORIES)


@query("ingest_rows_per_day", f"WITH {AUTH} SELECT dataset_day, count(*) AS n FROM auth GROUP BY ALL")
def _(spark, sf_dir):
    return authlog.rows_per_day(adapters.auth_events(spark, sf_dir))


@query("ingest_day_reconciliation", f"""WITH {LINES}, r AS (SELECT CAST((timestamp - 1) // 86400 + 1 AS INTEGER) AS dataset_day, count(*) AS n FROM parsed WHERE reason IS NULL GROUP BY 1), e AS (SELECT dataset_day, count(*) AS expected FROM auth GROUP BY 1)
SELECT dataset_day, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n = expected, false) AS agrees FROM r FULL JOIN e USING (dataset_day)""")
def _(spark, sf_dir):
    expected = authlog.rows_per_day(adapters.auth_events(spark, sf_dir)).withColumnRenamed("n", "expected")
    return authlog.compare_days(authlog.accepted(parsed(spark, sf_dir)), expected)


@query("ingest_profile", f"""WITH {LINES} SELECT count(*) AS rows, count(*) FILTER (reason IS NOT NULL) AS malformed, count(*) FILTER (reason IS NULL AND (timestamp - 1) // 86400 + 1 > 16) AS out_of_range,
min(timestamp) FILTER (reason IS NULL) AS first, max(timestamp) FILTER (reason IS NULL) AS last, count(DISTINCT x[2]) FILTER (reason IS NULL) AS distinct_source_user, count(DISTINCT x[3]) FILTER (reason IS NULL) AS distinct_destination_user,
count(DISTINCT x[4]) FILTER (reason IS NULL) AS distinct_source_computer, count(DISTINCT x[5]) FILTER (reason IS NULL) AS distinct_destination_computer FROM parsed""")
def _(spark, sf_dir):
    return authlog.profile(parsed(spark, sf_dir), 16)


@query("ingest_cohort", f"""WITH {RED}, c AS (SELECT acting_user, count(*) AS n, ends_with(split_part(acting_user, '@', 1), '$') AS m, acting_user IN (SELECT user FROM red) AS l FROM auth GROUP BY ALL),
u AS (SELECT acting_user FROM c WHERE l AND n <= 90 UNION ALL (SELECT acting_user FROM c WHERE NOT l AND NOT m AND n BETWEEN 20 AND 90 ORDER BY md5(acting_user), acting_user LIMIT 12)
UNION ALL (SELECT acting_user FROM c WHERE NOT l AND m AND n BETWEEN 20 AND 90 ORDER BY md5(acting_user), acting_user LIMIT 4))
SELECT acting_user, count(*) AS n FROM auth WHERE acting_user IN (FROM u) GROUP BY ALL""")
def _(spark, sf_dir):
    kept = authlog.cohort(adapters.auth_events(spark, sf_dir), adapters.red_team(spark, sf_dir), 20, 90, 12, 4, F.md5(F.col("acting_user").cast("binary")))
    return kept.groupBy("acting_user").agg(F.count("*").alias("n"))


@query("ingest_labels", f"WITH {RED} SELECT timestamp, user, source_computer, destination_computer, source_line, 'redteam.txt:' || source_line AS source_reference, CAST((timestamp - 1) // 86400 + 1 AS INTEGER) AS dataset_day FROM red")
def _(spark, sf_dir):
    lines = adapters.red_team(spark, sf_dir).select("source_line", F.concat_ws(",", F.col("timestamp").cast("string"), "user", "source_computer", "destination_computer").alias("raw"))
    return authlog.accepted(authlog.parse(lines, authlog.LABEL_FIELDS, "redteam.txt")).drop("raw", "acting_user")


@query("evidence_lookup", f"""WITH {RED}, q AS (SELECT reference, min(position) AS position FROM (SELECT source_line * 2 AS position, 'auth.txt:' || source_line AS reference FROM red UNION ALL SELECT source_line * 3, 'auth.txt:' || (source_line + 10000000) FROM red) GROUP BY 1)
SELECT position, reference, a.timestamp, a.acting_user, a.destination_computer FROM q LEFT JOIN auth a ON a.source_line = CAST(split_part(reference, ':', 2) AS BIGINT)""")
def _(spark, sf_dir):
    r = adapters.red_team(spark, sf_dir)
    asked = r.select((F.col("source_line") * 2).alias("position"), reference("auth.txt", F.col("source_line")).alias("reference"))
    asked = asked.union(r.select(F.col("source_line") * 3, reference("auth.txt", F.col("source_line") + 10_000_000)))
    return authlog.lookup(asked, adapters.auth_events(spark, sf_dir)).select("position", "reference", "timestamp", "acting_user", "destination_computer")


def _hour_refs(spark, sf_dir):
    events = adapters.auth_events(spark, sf_dir).withColumn("hour", hour_start(F.col("timestamp")))
    return authlog.attach_references(events, ["acting_user", "hour"])


_REFS = f"WITH {AUTH}, r AS (SELECT acting_user, hour, list('auth.txt:' || source_line ORDER BY timestamp, source_line) AS refs FROM auth GROUP BY ALL)"


@query("evidence_sequence_references", f"{_REFS} SELECT acting_user, hour, array_to_string(refs, ' ') AS refs, CAST(len(refs) AS BIGINT) AS n_references FROM r")
def _(spark, sf_dir):
    return _hour_refs(spark, sf_dir).select("acting_user", "hour", F.array_join("references", " ").alias("refs"), "n_references")


@query("evidence_edge_references", f"WITH {AUTH} SELECT acting_user, destination_computer, dataset_day, string_agg('auth.txt:' || source_line, ' ' ORDER BY timestamp, source_line) AS refs, count(*) AS n_references FROM auth GROUP BY ALL")
def _(spark, sf_dir):
    out = authlog.attach_references(adapters.auth_events(spark, sf_dir), ["acting_user", "destination_computer", "dataset_day"])
    return out.select("acting_user", "destination_computer", "dataset_day", F.array_join("references", " ").alias("refs"), "n_references")


@query("evidence_page", f"{_REFS} SELECT acting_user || '/' || hour AS id, CAST(len(refs) AS BIGINT) AS total, CAST(p AS INTEGER) AS position, refs[p + 1] AS reference FROM r, unnest(range(1, 3)) AS g(p) WHERE p < len(refs)")
def _(spark, sf_dir):
    refs = _hour_refs(spark, sf_dir).select(F.concat_ws("/", "acting_user", F.col("hour").cast("string")).alias("id"), "references")
    return authlog.page(refs, 1, 2)


@query("evidence_page_ahead", f"{_REFS} SELECT acting_user || '/' || hour AS id, array_to_string(refs[2:3], ' ') AS items, len(refs) > 3 AS has_more, CASE WHEN len(refs) > 3 THEN 3 END AS next_offset FROM r")
def _(spark, sf_dir):
    refs = _hour_refs(spark, sf_dir).select(F.concat_ws("/", "acting_user", F.col("hour").cast("string")).alias("id"), "references")
    return authlog.page_ahead(refs, 1, 2).withColumn("items", F.array_join("items", " "))


@query("evidence_point_lookup", f"WITH {RED}, w AS (SELECT source_line FROM red ORDER BY md5(CAST(source_line AS VARCHAR)) LIMIT 50) SELECT source_line, timestamp, acting_user, dataset_day FROM auth WHERE source_line IN (FROM w)")
def _(spark, sf_dir):
    """Fifty labelled lines looked up in the log written by day, by Bloom filters and statistics."""
    path = tables.fresh_path(spark, "auth-days")
    authlog.write_days(adapters.auth_events(spark, sf_dir), path)
    draw = F.md5(F.col("source_line").cast("string").cast("binary"))
    lines = [r.source_line for r in adapters.red_team(spark, sf_dir).orderBy(draw).limit(50).collect()]
    return authlog.lookup_lines(spark, path, lines).select("source_line", "timestamp", "acting_user", "dataset_day")


_COUNTED = {"users": "acting_user", "destinations": "destination_computer", "user_destinations": "acting_user || '/' || destination_computer"}
_RANGES = [(d, d + n - 1) for n in (1, 7, 30) for d in range(1, 31, n) if d + n <= 31]


@query("ingest_distinct_sketches", f"WITH {AUTH}, rg AS (SELECT * FROM (VALUES {', '.join(map(str, _RANGES))}) v(first_day, last_day)) " + " UNION ALL ".join(f"SELECT first_day, last_day, '{n}' AS column, count(*) AS events, count(DISTINCT {c}) AS exact, true AS within FROM auth JOIN rg ON dataset_day BETWEEN first_day AND last_day GROUP BY ALL" for n, c in _COUNTED.items()))
def _(spark, sf_dir):
    """Sketches of each day, stored and united over days, weeks and the month, beside exact counts: errors stay below 4 %, five standard errors."""
    columns = {n: F.expr(c) for n, c in _COUNTED.items()}
    log = adapters.auth_events(spark, sf_dir)
    days = tables.stored(sketches.daily(log, columns), "day-sketches")
    ranges = spark.createDataFrame(_RANGES, "first_day int, last_day int")
    found = sketches.measured(sketches.united(days, ranges), log, columns, ranges)
    return found.select("first_day", "last_day", "column", "events", "exact", (F.col("error") < 0.04).alias("within"))
