"""Queries p6 over trace_records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.operators.nested import trace_children, trace_tables
from tracemill.tables import load


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return trace_children(load(spark, d, "trace_records"), values=False).select("record_id", "trace_pos", "child", "child_key")


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: trace_tables(load(spark, d, "trace_records"))[name]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p6_found": p6_found} | {f"p6_{name}": _table(name) for name in ("rewards", "metrics", "calls", "stop_rules")}


_TRACES = """
WITH RECURSIVE payloads AS (SELECT record_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM trace_records),
arrays AS (SELECT record_id, p -> '$.traces' AS traces FROM payloads WHERE json_type(p) = 'OBJECT' AND json_type(p -> '$.traces') = 'ARRAY'),
trace AS (
    SELECT record_id, CAST(i AS INTEGER) AS trace_pos, traces -> i AS t
    FROM arrays, unnest(range(CAST(json_array_length(traces) AS BIGINT))) AS u(i) WHERE json_type(traces -> i) = 'OBJECT'
),
whole AS (
    SELECT record_id, trace_pos, what, CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) END ELSE v END AS v
    FROM (SELECT record_id, trace_pos, what, t -> ('$.' || what) AS v FROM trace, unnest(['rewards', 'metrics', 'calls']) AS u(what))
),
"""

P6 = _TRACES + """
reward AS (
    SELECT record_id, trace_pos, k AS child_key FROM whole, unnest(json_keys(v)) AS u(k)
    WHERE what = 'rewards' AND json_type(v) = 'OBJECT' AND json_type(v -> ('$."' || k || '"')) <> 'NULL'
    UNION ALL
    SELECT record_id, trace_pos, v -> i ->> 'name' FROM whole, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS u(i)
    WHERE what = 'rewards' AND json_type(v) = 'ARRAY' AND json_type(v -> i -> 'name') = 'VARCHAR'
),
leaf AS (
    SELECT record_id, trace_pos, CAST(NULL AS VARCHAR) AS path, v FROM whole WHERE what = 'metrics'
    UNION ALL
    SELECT record_id, trace_pos, CASE WHEN path IS NULL THEN '' ELSE path || '.' END || k, CASE WHEN json_type(v) = 'OBJECT' THEN v -> ('$."' || k || '"') ELSE v -> CAST(k AS BIGINT) END
    FROM leaf, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) ELSE [] END) AS u(k)
),
call AS (
    SELECT record_id, trace_pos, i AS pos, v -> i AS c FROM whole, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS u(i)
    WHERE what = 'calls' AND json_type(v) = 'ARRAY' AND json_type(v -> i) = 'OBJECT'
    UNION ALL
    SELECT record_id, trace_pos, 0, v FROM whole WHERE what = 'calls' AND json_type(v) = 'OBJECT'
),
sampling AS (
    SELECT record_id, trace_pos, pos, CASE WHEN json_type(c -> 'sampling') = 'VARCHAR' THEN CASE WHEN json_valid(c ->> 'sampling') THEN CAST(c ->> 'sampling' AS JSON) END ELSE c -> 'sampling' END AS s
    FROM call
),
rule AS (
    SELECT record_id, trace_pos, pos, r FROM (SELECT record_id, trace_pos, pos, s -> 'stop_rules' AS rules FROM sampling WHERE json_type(s) = 'OBJECT'),
        unnest(range(CASE json_type(rules) WHEN 'ARRAY' THEN CAST(json_array_length(rules) AS BIGINT) WHEN 'OBJECT' THEN 1 ELSE 0 END)) AS u(r)
    WHERE json_type(rules) = 'OBJECT' OR json_type(rules -> r) <> 'NULL'
)
SELECT record_id, trace_pos, 'reward' AS child, child_key FROM reward
UNION ALL SELECT record_id, trace_pos, 'metric', path FROM leaf WHERE path IS NOT NULL AND json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL')
UNION ALL SELECT record_id, trace_pos, 'call', CAST(pos AS VARCHAR) FROM call
UNION ALL SELECT record_id, trace_pos, 'stop_rule', pos || '.' || r FROM rule
"""


_REST = P6[P6.index("leaf AS (") : P6.index("SELECT record_id, trace_pos, 'reward'")]
_ENTRY = _TRACES + """
entry AS (
    SELECT record_id, trace_pos, k AS name, v -> ('$."' || k || '"') AS e FROM whole, unnest(json_keys(v)) AS u(k)
    WHERE what = 'rewards' AND json_type(v) = 'OBJECT' AND json_type(v -> ('$."' || k || '"')) <> 'NULL'
    UNION ALL
    SELECT record_id, trace_pos, v -> i ->> 'name', v -> i FROM whole, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS u(i)
    WHERE what = 'rewards' AND json_type(v) = 'ARRAY' AND json_type(v -> i -> 'name') = 'VARCHAR'
)
"""
TABLES = {
    "p6_rewards": _ENTRY + "SELECT record_id, trace_pos, name, coalesce(TRY_CAST(e ->> '$.score' AS DOUBLE), TRY_CAST(CAST(e AS VARCHAR) AS DOUBLE)) AS score, TRY_CAST(e ->> '$.weight' AS DOUBLE) AS weight FROM entry",
    "p6_metrics": _TRACES + _REST + "SELECT record_id, trace_pos, path AS metric, TRY_CAST(CAST(v AS VARCHAR) AS DOUBLE) AS number, CAST(v AS VARCHAR) AS raw FROM leaf WHERE path IS NOT NULL AND json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL')",
    "p6_calls": _TRACES + _REST + "SELECT record_id, trace_pos, CAST(pos AS INTEGER) AS call_pos, c ->> 'finish_reason' AS finish_reason, TRY_CAST(c -> 'usage' ->> 'completion_tokens' AS BIGINT) AS completion_tokens FROM call",
    "p6_stop_rules": _TRACES + _REST.replace("SELECT record_id, trace_pos, pos, r FROM", "SELECT record_id, trace_pos, pos, r, CASE json_type(rules) WHEN 'ARRAY' THEN rules -> r ELSE rules END AS x FROM")
    + "SELECT record_id, trace_pos, CAST(pos AS INTEGER) AS call_pos, CAST(r AS INTEGER) AS rule_pos, x ->> 'text' AS text, TRY_CAST(x ->> 'after' AS BIGINT) AS after, CASE WHEN json_type(x) <> 'OBJECT' THEN CAST(x AS VARCHAR) END AS raw FROM rule",
}


def sql() -> dict[str, str]:
    return {"p6_found": P6} | TABLES
