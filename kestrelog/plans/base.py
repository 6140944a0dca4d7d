"""Registration of queries with their DuckDB SQL, and the SQL of the derived tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

AUTH = """ev AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
  CAST(floor(epoch(ts)) - 1704067200 AS BIGINT) + 1 AS t,
  'U' || user_id || CASE WHEN user_id % 10 = 0 THEN '$' ELSE '' END || '@DOM1' AS who FROM events),
auth AS (SELECT t AS timestamp, event_id + 1 AS source_line, who AS source_user, 'U' || ((user_id * 7 + k) % 150) || '@DOM1' AS destination_user,
  'C' || ((user_id + k % 3) % 40) AS source_computer, 'C' || (100 + k) AS destination_computer,
  CASE k % 4 WHEN 0 THEN 'NTLM' WHEN 1 THEN 'Kerberos' WHEN 2 THEN 'Negotiate' ELSE '?' END AS authentication_type,
  CASE WHEN event_type IN ('view', 'purchase', 'error') THEN 'Network' WHEN event_type = 'click' THEN 'Interactive' ELSE '?' END AS logon_type,
  CASE k % 5 WHEN 0 THEN 'LogOn' WHEN 1 THEN 'LogOff' WHEN 2 THEN 'TGS' WHEN 3 THEN 'TGT' ELSE 'AuthMap' END AS authentication_orientation,
  CASE WHEN event_type = 'error' THEN 'Fail' ELSE 'Success' END AS authentication_result,
  who AS acting_user, CAST((t - 1) // 86400 + 1 AS INTEGER) AS dataset_day, 1 + ((t - 1) // 3600) * 3600 AS hour FROM ev)"""
RED = AUTH + """,
red AS (SELECT a.timestamp, a.acting_user AS user, a.source_computer, a.destination_computer, a.source_line FROM auth a JOIN ev ON ev.event_id + 1 = a.source_line WHERE event_type = 'purchase' AND value > 150)"""
LINES = AUTH + """,
lines AS (SELECT source_line, concat_ws(',', CASE WHEN source_line % 101 = 0 THEN 'x' ELSE CAST(timestamp AS VARCHAR) END, source_user, destination_user, source_computer, destination_computer,
  authentication_type, logon_type, CASE WHEN source_line % 103 = 0 THEN '' ELSE authentication_orientation END, CASE WHEN source_line % 97 = 0 THEN NULL ELSE authentication_result END) AS raw FROM auth),
f AS (SELECT *, string_split(raw, ',') AS x FROM lines),
parsed AS (SELECT *, TRY_CAST(x[1] AS BIGINT) AS timestamp,
  CASE WHEN len(x) <> 9 THEN 'field_count' WHEN TRY_CAST(x[1] AS BIGINT) IS NULL OR TRY_CAST(x[1] AS BIGINT) < 1 THEN 'invalid_timestamp' WHEN list_contains(x, '') THEN 'empty_field' END AS reason FROM f)"""
SCORES = AUTH + """,
hs0 AS (SELECT acting_user AS user, hour, count(*) AS n, count(*) FILTER (authentication_result = 'Fail') AS fails, count(DISTINCT destination_computer) AS dests, min(source_line) AS tie FROM auth GROUP BY ALL),
hs AS (SELECT user, hour, CAST((hour - 1) // 86400 + 1 AS INTEGER) AS day, round((n + 3 * fails) / (n + 3 * fails + 4.0), 6) AS seq_score,
  round((dests + tie % 7) / (dests + tie % 7 + 3.0), 6) AS graph_score, ends_with(split_part(user, '@', 1), '$') AS is_machine, tie FROM hs0)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add
