"""Queries over the tables of agent work: tasks, messages, records, samples, reports, documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import digests as D
from tracemill.functions import scalars as S
from tracemill.functions import strict_json as J
from tracemill.operators import export as E
from tracemill.operators import relations as R
from tracemill.operators import trajectories as T
from tracemill.operators import verdicts as V
from tracemill.operators.nested import trace_tables
from tracemill.plans.nested import P6
from tracemill.operators.protocol import first_failure
from tracemill.operators.report import measure_report
from tracemill.sources.contracts import bare_name, shuffled, task_list
from tracemill.sources.files import training_losses as losses_of
from tracemill.sources.traces import flatten, read_traces
from tracemill.tables import load, spelled

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    """Of each trace's node the last delivery, as the node frame of the trajectory operators."""
    rows = spelled(load(spark, d, "trace_messages").where("trace_id is not null"), "role", load(spark, d, "spellings"), "role", "means")
    picked = rows.select("trace_id", "node", "msg_id", "run_id", "parent", "sampled", F.col("means").alias("role"), "content", "tool_calls", "tool_call_id", "received_at")
    rest = F.struct("msg_id", "run_id", "parent", "sampled", "role", "content", "tool_calls", "tool_call_id")
    last = picked.groupBy("trace_id", "node").agg(F.max_by(rest, F.struct("received_at", "msg_id")).alias("r"))
    return last.select("trace_id", "node", "r.*")


def tasks_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Tasks, with what ``split`` means in its place."""
    return spelled(load(spark, d, "tasks").withColumnRenamed("split", "given"), "given", load(spark, d, "spellings"), "split", "split").drop("given")


_NODES = """
WITH RECURSIVE node AS (
    SELECT m.*, s.means AS means FROM trace_messages m LEFT JOIN spellings s ON s.field = 'role' AND s.written = lower(trim(m.role))
    WHERE m.trace_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY m.trace_id, m.node ORDER BY m.received_at DESC, m.msg_id DESC) = 1
)
"""


@query(_NODES + "SELECT run_id, count(*) AS nodes, count(*) FILTER (sampled AND means = 'assistant') AS sampled_turns, count(DISTINCT trace_id) AS traces FROM node GROUP BY ALL")
def turn_counts(spark, d):
    n = nodes_of(spark, d)
    return n.groupBy("run_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("sampled") & (F.col("role") == "assistant")).alias("sampled_turns"), F.count_distinct("trace_id").alias("traces"))


@query(_NODES + """,
turn AS (
    SELECT run_id, tool_calls, CASE WHEN json_valid(tool_calls) THEN CAST(tool_calls AS JSON) END AS c FROM node WHERE sampled AND means = 'assistant'
),
sized AS (SELECT run_id, c, tool_calls IS NULL OR coalesce(json_type(c) = 'ARRAY', false) AS listed, CASE WHEN json_type(c) = 'ARRAY' THEN CAST(json_array_length(c) AS BIGINT) ELSE 0 END AS n FROM turn),
call AS (
    SELECT run_id, CASE WHEN json_type(c -> i -> 'function') = 'OBJECT' THEN c -> i -> 'function' ELSE c -> i END AS f FROM sized, unnest(range(n)) AS u(i)
),
parsed AS (
    SELECT run_id, count(*) AS n FROM call WHERE json_type(f -> 'name') = 'VARCHAR' AND (json_type(f -> 'arguments') = 'OBJECT'
        OR json_type(f -> 'arguments') = 'VARCHAR' AND json_valid(f ->> 'arguments') AND json_type(CASE WHEN json_valid(f ->> 'arguments') THEN f ->> 'arguments' END) = 'OBJECT')
    GROUP BY ALL
),
total AS (
    SELECT run_id, count(*) AS sampled_turns, count(*) FILTER (listed AND n > 0) AS parsed_turns, CAST(sum(n + CASE WHEN listed THEN 0 ELSE 1 END) AS BIGINT) AS tool_call_attempts FROM sized GROUP BY ALL
)
SELECT t.run_id, sampled_turns, parsed_turns, tool_call_attempts, coalesce(p.n, 0) AS parsed_calls, tool_call_attempts - coalesce(p.n, 0) AS invalid_calls,
    CASE WHEN tool_call_attempts = 0 THEN 0.0 ELSE CAST(coalesce(p.n, 0) AS DOUBLE) / tool_call_attempts END AS parsed_tool_call_rate
FROM total t LEFT JOIN parsed p ON p.run_id IS NOT DISTINCT FROM t.run_id
""")
def turn_metrics(spark, d):
    rows = T.measure_turns(nodes_of(spark, d), by=("run_id",))
    return rows.select("run_id", "sampled_turns", "parsed_turns", "tool_call_attempts", "parsed_calls", "invalid_calls", "parsed_tool_call_rate")


_TURNS = _NODES + """,
turn AS (
    SELECT trace_id, node, run_id, tool_calls, CASE WHEN json_valid(tool_calls) THEN CAST(tool_calls AS JSON) END AS c FROM node WHERE sampled AND means = 'assistant'
),
sized AS (SELECT *, tool_calls IS NULL OR coalesce(json_type(c) = 'ARRAY', false) AS listed, CASE WHEN json_type(c) = 'ARRAY' THEN CAST(json_array_length(c) AS BIGINT) ELSE 0 END AS n FROM turn),
part AS (
    SELECT trace_id, node, run_id, i, CASE WHEN json_type(c -> i -> 'function') = 'OBJECT' THEN c -> i -> 'function' ELSE c -> i END AS f FROM sized, unnest(range(n)) AS u(i)
),
given AS (
    SELECT trace_id, node, run_id, i, f ->> 'name' AS name, CASE json_type(f -> 'arguments') WHEN 'OBJECT' THEN f -> 'arguments'
        WHEN 'VARCHAR' THEN CASE WHEN json_valid(f ->> 'arguments') THEN CAST(f ->> 'arguments' AS JSON) END END AS a
    FROM part WHERE json_type(f -> 'name') = 'VARCHAR'
),
parsed AS (SELECT * FROM given WHERE json_type(a) = 'OBJECT'),
field AS (
    SELECT trace_id, node, i, name, k, a -> ('$."' || k || '"') AS v FROM parsed, unnest(json_keys(a)) AS u(k) UNION ALL SELECT trace_id, node, i, name, '', NULL FROM parsed
),
signed AS (SELECT trace_id, node, i, name || string_agg(k || '=' || coalesce(json_type(v) || ':' || coalesce(v ->> '$', ''), ''), chr(1) ORDER BY k) AS sig FROM field GROUP BY trace_id, node, i, name),
signature AS (SELECT trace_id, node, string_agg(sig, chr(2) ORDER BY i) AS sigs, count(DISTINCT sig) < count(*) AS twice FROM signed GROUP BY ALL),
repeat AS (
    SELECT trace_id, node, twice OR coalesce(sigs = lag(sigs) OVER (PARTITION BY trace_id ORDER BY node), false) AS repeated FROM signature
)
"""


@query(_TURNS + """
SELECT run_id, count(*) FILTER (listed AND n > 0) AS parsed_turns, count(*) FILTER (repeated) AS repeated_call_turns,
    CASE WHEN count(*) FILTER (listed AND n > 0) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (repeated) AS DOUBLE) / count(*) FILTER (listed AND n > 0) END AS loop_rate
FROM sized LEFT JOIN repeat USING (trace_id, node) GROUP BY run_id
""")
def turn_loops(spark, d):
    """Turns that repeat their calls, by whole signatures."""
    return T.measure_turns(nodes_of(spark, d), by=("run_id",)).select("run_id", "parsed_turns", "repeated_call_turns", "loop_rate")


_RECORDS = """,
record AS (SELECT record_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM trace_records),
listed_trace AS (
    SELECT record_id, i AS ord, p -> 'traces' -> i AS t FROM record, unnest(range(CAST(json_array_length(CASE WHEN json_type(p) = 'OBJECT' AND json_type(p -> 'traces') = 'ARRAY' THEN p -> 'traces' END) AS BIGINT))) AS u(i)
),
trace AS (
    SELECT *, t ->> 'id' AS trace_id FROM listed_trace WHERE json_type(t) = 'OBJECT' AND json_type(t -> 'id') = 'VARCHAR'
    QUALIFY row_number() OVER (PARTITION BY t ->> 'id' ORDER BY record_id, ord) = 1
),
owner AS (SELECT trace_id, min(run_id) AS run_id FROM node GROUP BY trace_id HAVING min(run_id) IS NOT NULL),
number AS (
    SELECT o.run_id, record_id, t, CASE WHEN json_type(t -> '$.rewards.tests.score') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(t ->> '$.rewards.tests.score' AS DOUBLE) END AS reward,
        CASE WHEN json_type(t -> '$.metrics.passed_cases') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(t ->> '$.metrics.passed_cases' AS DOUBLE) END AS passed,
        CASE WHEN json_type(t -> '$.metrics.total_cases') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(t ->> '$.metrics.total_cases' AS DOUBLE) END AS total
    FROM trace JOIN owner o USING (trace_id)
),
head AS (
    SELECT run_id, count(DISTINCT record_id) AS trace_files, count(*) AS traces, CAST(coalesce(sum(CASE WHEN passed = floor(passed) THEN passed END), 0) AS BIGINT) AS passed_cases,
        CAST(coalesce(sum(CASE WHEN total = floor(total) THEN total END), 0) AS BIGINT) AS total_cases, round(avg(reward), 9) AS sealed_validation_reward,
        sha256('[' || string_agg(coalesce(t ->> '$.task.data.task_id', '') || '|' || coalesce(t ->> '$.task.data.split', ''), ',' ORDER BY coalesce(t ->> '$.task.data.task_id', ''), coalesce(t ->> '$.task.data.split', '')) || ']') AS comparison_sha256
    FROM number GROUP BY run_id
),
model_call AS (SELECT run_id, t -> 'calls' -> i ->> 'finish_reason' AS r FROM number, unnest(range(CAST(json_array_length(CASE WHEN json_type(t -> 'calls') = 'ARRAY' THEN t -> 'calls' END) AS BIGINT))) AS u(i)),
model AS (SELECT run_id, count(*) AS model_calls, count(*) FILTER (r IN ('stop', 'tool_calls')) AS completed_model_calls, count(*) FILTER (r = 'length') AS length_limited_calls FROM model_call GROUP BY run_id),
sample AS (SELECT trace_id, tools FROM training_samples QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY created_at DESC, sample_id DESC) = 1),
tool AS (
    SELECT trace_id, x.function.name AS name, CAST(x.function.parameters AS JSON) AS p FROM (SELECT trace_id, unnest(tools) AS x, unnest(range(CAST(len(tools) AS BIGINT))) AS i FROM sample)
    QUALIFY row_number() OVER (PARTITION BY trace_id, x.function.name ORDER BY i DESC) = 1
),
checked AS (
    SELECT c.trace_id, c.node, t.name IS NULL AS unavailable, t.name IS NOT NULL AND len(list_filter(json_keys(a), lambda k: NOT list_contains(json_keys(p -> 'properties'), k)
        OR json_type(a -> ('$."' || k || '"')) IS DISTINCT FROM CASE p -> 'properties' -> k ->> 'type' WHEN 'string' THEN 'VARCHAR' WHEN 'boolean' THEN 'BOOLEAN' END)) > 0 AS misfit
    FROM parsed c LEFT JOIN tool t ON t.trace_id = c.trace_id AND t.name = c.name
),
by_turn AS (SELECT trace_id, node, count(*) AS parsed, count(*) FILTER (unavailable) AS unavailable, count(*) FILTER (misfit) AS misfits FROM checked GROUP BY ALL),
total AS (
    SELECT o.run_id, count(*) AS sampled_turns, count(*) FILTER (listed AND n > 0) AS parsed_turns, CAST(coalesce(sum(b.parsed), 0) AS BIGINT) AS parsed_calls,
        CAST(sum(n + CASE WHEN listed THEN 0 ELSE 1 END) AS BIGINT) AS tool_call_attempts, CAST(coalesce(sum(b.unavailable), 0) AS BIGINT) AS unavailable_tool_calls,
        CAST(sum(n + CASE WHEN listed THEN 0 ELSE 1 END - coalesce(b.parsed, 0) + coalesce(b.unavailable, 0) + coalesce(b.misfits, 0)) AS BIGINT) AS invalid_calls, count(*) FILTER (repeated) AS repeated_call_turns
    FROM sized s JOIN owner o USING (trace_id) LEFT JOIN by_turn b USING (trace_id, node) LEFT JOIN repeat r USING (trace_id, node) GROUP BY o.run_id
),
run AS (SELECT DISTINCT run_id FROM owner WHERE run_id IN (SELECT run_id FROM head) OR run_id IN (SELECT run_id FROM total))
"""


@query(_TURNS + _RECORDS + """
SELECT run_id, 1 AS schema_version, 'native' AS parser, coalesce(trace_files, 0) AS trace_files, coalesce(traces, 0) AS traces, coalesce(sampled_turns, 0) AS sampled_turns, coalesce(parsed_turns, 0) AS parsed_turns,
    coalesce(parsed_calls, 0) AS parsed_calls, coalesce(tool_call_attempts, 0) AS tool_call_attempts, coalesce(invalid_calls, 0) AS invalid_calls, coalesce(unavailable_tool_calls, 0) AS unavailable_tool_calls,
    coalesce(repeated_call_turns, 0) AS repeated_call_turns, coalesce(completed_model_calls, 0) AS completed_model_calls, coalesce(model_calls, 0) AS model_calls, coalesce(length_limited_calls, 0) AS length_limited_calls,
    coalesce(passed_cases, 0) AS passed_cases, coalesce(total_cases, 0) AS total_cases, sealed_validation_reward, CASE WHEN coalesce(tool_call_attempts, 0) = 0 THEN 0.0 ELSE CAST(parsed_calls AS DOUBLE) / tool_call_attempts END AS parsed_tool_call_rate,
    CASE WHEN coalesce(tool_call_attempts, 0) = 0 THEN 0.0 ELSE CAST(invalid_calls AS DOUBLE) / tool_call_attempts END AS invalid_tool_rate, CASE WHEN coalesce(model_calls, 0) = 0 THEN 0.0 ELSE CAST(completed_model_calls AS DOUBLE) / model_calls END AS end_token_rate,
    CASE WHEN coalesce(parsed_turns, 0) = 0 THEN 0.0 ELSE CAST(repeated_call_turns AS DOUBLE) / parsed_turns END AS loop_rate, comparison_sha256
FROM run LEFT JOIN head USING (run_id) LEFT JOIN total USING (run_id) LEFT JOIN model USING (run_id)
""")
def trace_report(spark, d):
    """The metrics report of every run: turns and calls by its messages, tools of its samples, model calls, cases and rewards by its records."""
    nodes = nodes_of(spark, d)
    owner = nodes.groupBy("trace_id").agg(F.min("run_id").alias("run_id")).where("run_id is not null")
    lines = load(spark, d, "trace_records").select("record_id", F.col("payload").alias("line"))
    frames = flatten(read_traces(lines, ["record_id"])[0], ["record_id", "trace_ord"])
    heads = T.first_wins(frames["traces"].where("trace_id is not null"), ["trace_id"], ["record_id", "trace_ord"]).join(owner, "trace_id")
    place = heads.select("record_id", "trace_ord", "run_id")
    samples = load(spark, d, "training_samples").groupBy("trace_id").agg(F.max_by("tools", F.struct("created_at", "sample_id")).alias("tools"))
    tools = samples.select("trace_id", F.posexplode("tools").alias("tool_ord", "t")).select("trace_id", "tool_ord", "t.function.name", "t.function.parameters")
    parts = {"traces": heads, "tools": tools, "nodes": nodes.drop("run_id").join(owner, "trace_id"), "model_calls": frames["model_calls"].join(place, ["record_id", "trace_ord"])}
    task, split = (F.coalesce(c, F.lit("")) for c in ("task_id", "split"))
    entries = heads.select("run_id", task.alias("task_id"), F.concat_ws("|", task, split).alias("entry"))
    report = measure_report(parts, entries, "native", ["trace_id"], "record_id", ("run_id",))
    return report.withColumn("sealed_validation_reward", F.round("sealed_validation_reward", 9))


_CALLS = P6[: P6.index("sampling AS (")].rstrip().rstrip(",")


@query(_CALLS + """
SELECT count(*) AS model_calls, count(*) FILTER (r IN ('stop', 'tool_calls')) AS completed_model_calls, count(*) FILTER (r = 'length') AS length_limited_calls,
    CAST(count(*) FILTER (r IN ('stop', 'tool_calls')) AS DOUBLE) / count(*) AS end_token_rate FROM (SELECT c ->> 'finish_reason' AS r FROM call)
""")
def finish_rates(spark, d):
    return T.measure_model_calls(trace_tables(load(spark, d, "trace_records"))["calls"])


@query(_CALLS[: _CALLS.index("reward AS (")] + """
entry AS (
    SELECT k AS name, v -> ('$."' || k || '"') AS e FROM whole, unnest(json_keys(v)) AS u(k) WHERE what = 'rewards' AND json_type(v) = 'OBJECT' AND json_type(v -> ('$."' || k || '"')) <> 'NULL'
    UNION ALL SELECT v -> i ->> 'name', v -> i FROM whole, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS u(i) WHERE what = 'rewards' AND json_type(v) = 'ARRAY' AND json_type(v -> i -> 'name') = 'VARCHAR'
)
SELECT name, count(*) AS n, CAST(sum(CAST(round(10000 * s) AS BIGINT)) AS BIGINT) AS score_e4 FROM (
    SELECT name, CASE WHEN json_type(e) = 'OBJECT' THEN TRY_CAST(e ->> 'score' AS DOUBLE) ELSE TRY_CAST(e ->> '$' AS DOUBLE) END AS s FROM entry
) GROUP BY ALL
""")
def reward_totals(spark, d):
    """Scores in ten-thousandths, so that sums are exact."""
    return trace_tables(load(spark, d, "trace_records"))["rewards"].groupBy("name").agg(F.count("*").alias("n"), F.sum(F.round(F.col("score") * 10000).cast("bigint")).alias("score_e4"))


@query("""
WITH base AS (SELECT parser, * EXCLUDE (parser) FROM metrics_reports QUALIFY row_number() OVER (PARTITION BY parser ORDER BY report_id) = 1)
SELECT c.report_id, b.report_id AS baseline_id, round(c.sealed_validation_reward - b.sealed_validation_reward, 9) AS reward_delta,
    CASE WHEN c.sealed_validation_reward <= b.sealed_validation_reward OR c.parsed_calls = 0 OR c.parsed_tool_call_rate < b.parsed_tool_call_rate OR c.invalid_tool_rate > b.invalid_tool_rate
        OR c.unavailable_tool_calls > 0 OR c.end_token_rate < b.end_token_rate OR c.loop_rate > b.loop_rate THEN 'rejected' ELSE 'improved' END AS status
FROM metrics_reports c JOIN base b USING (parser)
""")
def compare_gate(spark, d):
    reports = load(spark, d, "metrics_reports")
    base = T.first_wins(reports, ["parser"], ["report_id"])
    return T.compare_reports(base, reports, "parser").select("report_id", "baseline_id", F.round("reward_delta", 9).alias("reward_delta"), "status")


@query("""
SELECT parser, report_id, run_id FROM metrics_reports
QUALIFY row_number() OVER (PARTITION BY parser ORDER BY sealed_validation_reward DESC, parsed_tool_call_rate DESC, end_token_rate DESC, invalid_tool_rate, loop_rate, report_id) = 1
""")
def argmax_candidate(spark, d):
    return T.best_by(load(spark, d, "metrics_reports"), ("parser",), ["sealed_validation_reward", "parsed_tool_call_rate", "end_token_rate"], ["invalid_tool_rate", "loop_rate"], "report_id", ["report_id", "run_id"])


@query("SELECT trace_id, sample_id, turn_index FROM training_samples QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY created_at, sample_id) = 1")
def dedupe_first_wins(spark, d):
    return T.first_wins(load(spark, d, "training_samples").select("trace_id", "created_at", "sample_id", "turn_index"), ["trace_id"], ["created_at", "sample_id"]).select("trace_id", "sample_id", "turn_index")


KINDS = {"sandbox_read": "read", "sandbox_write": "write", "sandbox_edit": "edit", "sandbox_exec": "execute", "run_tests": "test"}


@query(_TURNS + _RECORDS + """,
done AS (
    SELECT trace_id, s.means AS split FROM trace JOIN spellings s ON s.field = 'split' AND s.written = lower(trim(t ->> '$.task.data.split')) WHERE s.means IN ('train', 'validation') AND json_type(t -> 'ok') = 'BOOLEAN' AND t ->> 'ok' = 'true'
        AND t ->> 'stop_condition' = 'agent_completed' AND (json_type(t -> '$.rewards.tests.score') = 'BOOLEAN' AND t ->> '$.rewards.tests.score' = 'true'
            OR json_type(t -> '$.rewards.tests.score') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CAST(t ->> '$.rewards.tests.score' AS DOUBLE) = 1.0)
),
mine AS (SELECT n.*, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM node n WHERE trace_id IN (SELECT trace_id FROM done)),
spoken AS (
    SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN array_to_string(j ->> '$[*].text', chr(10)) ELSE content END AS said, means = 'tool' AND coalesce(json_type(j) = 'OBJECT' AND (json_type(j -> 'ok') = 'BOOLEAN' AND j ->> 'ok' = 'false'
        OR json_type(j -> 'returncode') IN ('BIGINT', 'UBIGINT') AND j ->> 'returncode' <> '0' OR j ->> 'status' IN ('failed', 'error')), false) AS failed FROM mine
),
kind AS (
    SELECT DISTINCT trace_id, node, CASE name WHEN 'sandbox_read' THEN 'read' WHEN 'sandbox_write' THEN 'write' WHEN 'sandbox_edit' THEN 'edit' WHEN 'sandbox_exec' THEN 'execute' WHEN 'run_tests' THEN 'test' END AS kind FROM parsed
    UNION SELECT s.trace_id, s.node, 'final' FROM sized z JOIN spoken s USING (trace_id, node) WHERE z.n = 0 AND trim(said) <> ''
    UNION SELECT s.trace_id, s.node, 'recovery' FROM spoken s JOIN spoken u ON u.trace_id = s.trace_id AND u.node = s.parent WHERE u.failed AND s.sampled AND s.means = 'assistant'
),
useful AS (SELECT * FROM kind WHERE kind IS NOT NULL AND trace_id IN (SELECT trace_id FROM done)),
target AS (SELECT trace_id, max(node) AS node, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM useful GROUP BY trace_id),
way AS (
    SELECT t.trace_id, m.node, m.parent, 1 AS steps FROM target t JOIN mine m USING (trace_id, node)
    UNION ALL SELECT w.trace_id, m.node, m.parent, steps + 1 FROM way w JOIN mine m ON m.trace_id = w.trace_id AND m.node = w.parent WHERE steps < 1000
),
whole AS (SELECT trace_id, count(*) AS n_messages FROM way GROUP BY trace_id HAVING count(*) FILTER (parent IS NULL) = 1)
SELECT t.trace_id, d.split, t.node AS turn_index, t.kinds, CAST(w.n_messages AS INTEGER) AS n_messages FROM target t JOIN whole w USING (trace_id) JOIN done d USING (trace_id)
WHERE NOT EXISTS (SELECT 1 FROM useful u WHERE u.trace_id = t.trace_id AND (u.trace_id, u.node) NOT IN (SELECT trace_id, node FROM way))
""")
def training_export(spark, d):
    """Training rows of successful traces: messages of the tables, outcomes of the records, tools of the samples."""
    lines = load(spark, d, "trace_records").select("record_id", F.col("payload").alias("line"))
    heads = flatten(read_traces(lines, ["record_id"])[0], ["record_id", "trace_ord"])["traces"].where("trace_id is not null")
    heads = spelled(T.first_wins(heads, ["trace_id"], ["record_id", "trace_ord"]).withColumnRenamed("split", "given"), "given", load(spark, d, "spellings"), "split", "split")
    said = J.parse_one(F.col("content"))
    text = F.when(F.coalesce(J.kind(said) == "array", F.lit(False)), J.flat_text(said)).otherwise(F.col("content"))
    nodes = nodes_of(spark, d).withColumn("text", text).withColumn("part", F.lit(0))
    samples = load(spark, d, "training_samples").groupBy("trace_id").agg(F.max_by("tools", F.struct("created_at", "sample_id")).alias("tools"))
    tools = samples.select("trace_id", F.posexplode("tools").alias("tool_ord", "t")).select("trace_id", "tool_ord", "t.function.*", F.lit(0).alias("part"))
    done = heads.where("split in ('train', 'validation')").withColumn("part", F.lit(0))
    rows = E.training_rows(done, nodes, tools, KINDS, ["part"])
    return rows.select("trace_id", "split", "turn_index", F.array_join("target_kinds", ",").alias("kinds"), F.size("messages").alias("n_messages"))


@query("SELECT record_id, coalesce(regexp_full_match(task_id, '[a-z0-9][a-z0-9._/-]{2,127}'), false) AS task_id_fits, coalesce(regexp_full_match(license, '[A-Za-z0-9][A-Za-z0-9.+-]{0,63}'), false) AS license_fits FROM tasks")
def name_forms(spark, d):
    return load(spark, d, "tasks").select("record_id", S.fits(F.col("task_id"), S.TASK_ID).alias("task_id_fits"), S.fits(F.col("license"), S.LICENSE).alias("license_fits"))


@query("""
SELECT report_id, CASE WHEN passed_cases <> total_cases AND abs(passed_cases - total_cases) > 1 THEN 'passed differs' WHEN abs(loop_rate - 0.05) > 0.05 THEN 'loops differs' END AS failure FROM metrics_reports
""")
def case_verdicts(spark, d):
    """Reports as recorded replies: all cases but one are to pass, and loops to be about as many as usual."""
    number = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    near = lambda value, by, how: F.struct(F.lit(how).alias("compare"), value.alias("value"), F.lit(by).alias("absolute"))
    whole = lambda values: F.to_json(F.struct(F.lit("ok").alias("status"), values.alias("values")))
    wanted = F.struct(near(number("int", F.col("total_cases")), 1.0, "close").alias("passed"), near(F.array(number("float", F.lit(0.05))), 0.05, "close_recursive").alias("loops"))
    given = F.struct(number("int", F.col("passed_cases")).alias("passed"), F.array(number("float", F.col("loop_rate").cast("decimal(12,9)"))).alias("loops"))
    return load(spark, d, "metrics_reports").select("report_id", V.case_failure(whole(wanted), whole(given)).alias("failure"))


@query("""SELECT event_id, '{"a":[1.5,true],"k":' || (json_extract_string(props, '$.k')) || ',"é":null}' AS canonical FROM events""")
def canonical_texts(spark, d):
    """Objects written with other spaces and order of names, in canonical form to the byte; numbers as Python writes them."""
    text = F.concat(F.lit('{ "é" : null,'), F.substring("props", 2, 1000).substr(F.lit(1), F.length("props") - 2), F.lit(', "a": [ 1.50 , true ] }'))
    return load(spark, d, "events").select("event_id", D.canonical_json(text).alias("canonical"))


@query("SELECT kind, count(DISTINCT sample_id) AS samples FROM (SELECT sample_id, unnest(target_kinds) AS kind FROM training_samples) GROUP BY ALL")
def action_histogram(spark, d):
    return T.histogram(load(spark, d, "training_samples"), "target_kinds")


@query("""
SELECT w.split, coalesce(n, 0) AS trajectories, CAST(100 AS BIGINT) AS least, coalesce(n, 0) >= 100 AS enough FROM split_targets w LEFT JOIN (
    SELECT s.means AS split, count(DISTINCT record_id) AS n FROM tasks t JOIN spellings s ON s.field = 'split' AND s.written = lower(trim(t.split)) GROUP BY ALL
) USING (split)
""")
def split_counts(spark, d):
    rows = tasks_by_split(spark, d).where("split is not null")
    return E.split_counts(rows.select("split", F.col("record_id").alias("trace_id")), {"train": 100, "validation": 100, "holdout": 100})


@query(_NODES + """,
up AS (SELECT trace_id, node, parent AS above, CAST(1 AS BIGINT) AS depth FROM node UNION ALL SELECT u.trace_id, u.node, n.parent, depth + 1 FROM up u JOIN node n ON n.trace_id = u.trace_id AND n.node = u.above WHERE u.depth < 300)
SELECT trace_id, node, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY ALL HAVING count(*) FILTER (above IS NULL) = 1
""")
def parent_chain(spark, d):
    """The depth of every node that has a way to a root."""
    return T.depths(nodes_of(spark, d)).where("depth is not null")


@query(_NODES + """
SELECT trace_id, count(*) FILTER (failed) AS failures, count(*) FILTER (failed AND nxt = 'assistant') AS answered FROM (
    SELECT trace_id, lead(means) OVER (PARTITION BY trace_id ORDER BY node) AS nxt, means = 'tool' AND coalesce(json_type(j) = 'OBJECT' AND (json_type(j -> 'ok') = 'BOOLEAN' AND j ->> 'ok' = 'false'
        OR json_type(j -> 'returncode') IN ('BIGINT', 'UBIGINT') AND j ->> 'returncode' <> '0' OR j ->> 'status' IN ('failed', 'error')), false) AS failed
    FROM (SELECT *, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM node)
) GROUP BY ALL
""")
def recovery_turns(spark, d):
    """Failed tool results of a trace, and those that an assistant's turn follows."""
    rows = nodes_of(spark, d).select("trace_id", "node", "role", F.coalesce(T.failed_result(F.col("role"), F.col("content")), F.lit(False)).alias("failed"))
    rows = rows.withColumn("next", F.lead("role").over(Window.partitionBy("trace_id").orderBy("node")))
    return rows.groupBy("trace_id").agg(F.count_if("failed").alias("failures"), F.count_if(F.col("failed") & (F.col("next") == "assistant")).alias("answered"))


@query("SELECT least(CAST(ceil(n_chars / 32.0) AS BIGINT) * 32 + 1, 4096) AS padded, count(*) AS n FROM documents WHERE n_chars <= 4096 GROUP BY ALL")
def length_buckets(spark, d):
    """Documents within a length, by padded length."""
    fit = E.within_length(load(spark, d, "documents"), F.col("n_chars"), 4096)
    return fit.groupBy(S.pad_bucket(F.col("n_chars"), 4096).alias("padded")).agg(F.count("*").alias("n"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY ALL")
def word_freq(spark, d):
    return load(spark, d, "documents").select(F.explode(S.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT record_id, trim(regexp_replace(lower(task_id), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM tasks")
def slugify(spark, d):
    return load(spark, d, "tasks").select("record_id", S.slugify(F.col("task_id")).alias("slug"))


@query("SELECT record_id, source IS NOT NULL AND record_id % 4 IN (0, 3) AS fine FROM tasks")
def url_predicate(spark, d):
    """Sources as they are, with a query, over plain http, and with a port."""
    url = F.col("source")
    shapes = F.when(F.col("record_id") % 4 == 1, F.concat(url, F.lit("?a=1"))).when(F.col("record_id") % 4 == 2, F.replace(url, F.lit("https:"), F.lit("http:"))).when(
        F.col("record_id") % 4 == 3, F.replace(url, F.lit("tasks.example"), F.lit("tasks.example:8443"))).otherwise(url)
    return load(spark, d, "tasks").select("record_id", S.is_base_url(shapes).alias("fine"))


@query("SELECT doc_id, path <> '' AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS plain FROM documents WHERE path IS NOT NULL")
def plain_paths(spark, d):
    return load(spark, d, "documents").where("path is not null").select("doc_id", S.is_plain_path(F.col("path")).alias("plain"))


@query("""
SELECT doc_id, CASE WHEN regexp_full_match(path, 'code_files/[^/]+/[^/]+') THEN '/code_files/:area/:file'
    WHEN regexp_full_match(path, 'readmes/.+') THEN '/readmes/*rest' WHEN regexp_full_match(path, '[^/]+/[^/]+/[^/]+') THEN '/:kind/:area/:file' END AS route FROM documents
""")
def route_match(spark, d):
    routes = spark.createDataFrame([("/code_files/:area/:file",), ("/readmes/*rest",), ("/:kind/:area/:file",), ("/code_files/*rest",)], "route string")
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("/"), "path").alias("path"))
    return R.match_routes(docs, routes).select("doc_id", "route")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS total_lines, len(string_split(text, chr(10))) > 4 AS truncated, array_to_string(list_transform(string_split(text, chr(10))[3:4], lambda x, i: (i + 2) || ':' || x), chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def line_ranges(spark, d):
    """Lines 3 and 4 of every text, numbered."""
    x = S.numbered_lines(F.col("text"), 3, 2)
    return load(spark, d, "documents").where("text is not null").select("doc_id", x.alias("x")).select("doc_id", F.col("x.total_lines").cast("bigint").alias("total_lines"), "x.truncated", "x.text")


@query("SELECT record_id, CASE WHEN (length(prompt) - length(replace(prompt, 'Implement', ''))) = 9 THEN replace(prompt, 'Implement', 'Write') END AS prompt FROM tasks")
def replace_once(spark, d):
    return load(spark, d, "tasks").select("record_id", S.replace_once(F.col("prompt"), F.lit("Implement"), F.lit("Write")).alias("prompt"))


@query("""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, regexp_extract(m, '(Train|Val) loss ([^\\s,]+)', 1) AS kind, TRY_CAST(regexp_extract(m, '(Train|Val) loss ([^\\s,]+)', 2) AS DOUBLE) AS loss
FROM (SELECT doc_id, unnest(ms) AS m, unnest(range(1, CAST(len(ms) + 1 AS BIGINT))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?:Train|Val) loss [^\\s,]+') AS ms FROM documents WHERE source = 'training_logs'))
""")
def training_losses(spark, d):
    logs = load(spark, d, "documents").where("source = 'training_logs'").select("doc_id", "text")
    return losses_of(logs, "text").select("doc_id", "place", "kind", "loss")


@query("""
WITH t AS (SELECT family, s.means AS split FROM tasks t JOIN spellings s ON s.field = 'split' AND s.written = lower(trim(t.split)) WHERE family IS NOT NULL)
SELECT DISTINCT family FROM t WHERE split = 'holdout' EXCEPT SELECT family FROM t WHERE split = 'train'
""")
def holdout_only_families(spark, d):
    """Families as they are written, of tasks by what their split means."""
    t = tasks_by_split(spark, d).where("family is not null")
    return t.where("split = 'holdout'").select("family").distinct().join(t.where("split = 'train'").select("family").distinct(), "family", "left_anti")


@query("SELECT record_id, list_has_any(editable_files, context_files) AND len(list_filter(editable_files, lambda x: NOT list_contains(context_files, x))) = 0 AS covered FROM tasks")
def editable_in_context(spark, d):
    t = load(spark, d, "tasks")
    return t.select("record_id", ((F.size(R.lacking("editable_files", "context_files")) == 0) & F.arrays_overlap("editable_files", "context_files")).alias("covered"))


@query("""
SELECT CASE WHEN count(DISTINCT license) = 1 AND count(license) = count(*) THEN min(license) END AS license, CASE WHEN count(DISTINCT runtime) = 1 AND count(runtime) = count(*) THEN min(runtime) END AS runtime,
    CASE WHEN count(DISTINCT sensitive_data) = 1 AND count(sensitive_data) = count(*) THEN min(sensitive_data) END AS sensitive_data FROM tasks
""")
def same_everywhere(spark, d):
    return E.same_everywhere(load(spark, d, "tasks"), ["license", "runtime", "sensitive_data"])


@query("""
SELECT json_type(p) IS NOT NULL AS is_json, CASE json_type(p) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' END AS kind, count(*) AS n
FROM (SELECT CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM trace_records) GROUP BY ALL
""")
def payload_kinds(spark, d):
    kind = J.kind(J.parse_one(F.col("payload")))
    return load(spark, d, "trace_records").select(kind.alias("kind")).groupBy(F.col("kind").isNotNull().alias("is_json"), "kind").agg(F.count("*").alias("n"))


@query("""
SELECT record_id, row_number() OVER (ORDER BY task_id, record_id) - 1 AS idx FROM tasks t JOIN spellings s ON s.field = 'split' AND s.written = lower(trim(t.split))
WHERE s.means = 'validation' AND task_id IS NOT NULL
""")
def task_places(spark, d):
    """The tasks that mean a split, numbered in order."""
    return task_list(tasks_by_split(spark, d).where("task_id is not null").select("record_id", "task_id", "split"), "validation", ["task_id", "record_id"]).select("record_id", "idx")


@query("SELECT sample_id, sha256('7|1|' || sample_id) AS sort_key FROM training_samples")
def shuffle_keys(spark, d):
    """The order of samples in one epoch."""
    samples = load(spark, d, "training_samples")
    return samples.select("sample_id", shuffled(samples, "sample_id", 7, 1).alias("sort_key"))


@query("""
SELECT report_id, CASE WHEN parsed_tool_call_rate < 1 THEN 'calls are not all parsed' WHEN end_token_rate < 1 THEN 'replies are cut' WHEN loop_rate > 0.05 THEN 'there are loops' END AS failure FROM metrics_reports
""")
def report_gate(spark, d):
    """The first rule that a report breaks."""
    checks = [(F.col("parsed_tool_call_rate") >= 1, "calls are not all parsed"), (F.col("end_token_rate") >= 1, "replies are cut"), (F.col("loop_rate") <= 0.05, "there are loops")]
    return load(spark, d, "metrics_reports").select("report_id", first_failure(checks).alias("failure"))


@query("""
SELECT doc_id, regexp_extract(path, '([^/]+)$', 1) AS name FROM documents WHERE path IS NOT NULL
""")
def bare_names(spark, d):
    return load(spark, d, "documents").where("path is not null").select("doc_id", bare_name(F.col("path")).alias("name"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def sql() -> dict[str, str]:
    return {name: s for name, (_, s) in _ALL.items() if s}
