"""The metrics report of traces: one row of counts, rates, the mean reward and a fingerprint.

Frames are those of ``sources.traces``. A trace is told apart by its place (``key``),
not by its id: here, other than in an export, traces of one id all count.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import strict_json as J
from tracemill.functions.digests import canonical
from tracemill.operators.trajectories import fingerprint, measure_model_calls, measure_turns

SCHEMA_VERSION = 1
#: What identifies the task of an entry, with the JSON type each has to have. Fixed values.
IDENTITY = {"task_id": "string", "task_revision": "integer", "task_digest": "string", "prompt": "string", "system_prompt": "string", "split": "string"}
#: The columns of a report, in order. Fixed values.
COLUMNS = (
    "schema_version", "parser", "trace_files", "traces", "sampled_turns", "parsed_turns", "parsed_calls", "tool_call_attempts", "invalid_calls", "unavailable_tool_calls", "repeated_call_turns",
    "completed_model_calls", "model_calls", "length_limited_calls", "passed_cases", "total_cases", "sealed_validation_reward", "parsed_tool_call_rate", "invalid_tool_rate", "end_token_rate", "loop_rate", "comparison_sha256",
)


def trace_faults(traces: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, stage, reason`` of each trace that a strict report can't take: its first fault, stages in order.

    ``traces`` has the VARIANT column ``trace``. Stages: 1 tools, 2 messages, 3 model
    calls, 4 the reward, 5 what the fingerprint needs.
    """
    t = F.col("trace")
    part = lambda path: J.at(t, path)
    lacks = lambda items, test: ~F.coalesce(F.forall(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))
    is_tool = lambda x: (J.kind(J.at(x, "$.name")) == "string") & (J.kind(J.at(x, "$.parameters")) == "object")
    is_node = lambda x: ~J.is_true(J.at(x, "$.sampled")) | (J.kind(J.at(x, "$.message")) == "object")
    same = lambda x: (J.kind(J.at(x, "$.sampling")) == "object")
    tools, nodes, calls = (J.items(part(f"$.{name}")) for name in ("tools", "nodes", "calls"))
    named = F.lit(True)
    for field, kind in IDENTITY.items():
        named = named & F.coalesce(J.kind(part(f"$.task.data.{field}")) == kind, F.lit(False))
    rules = (
        (1, lacks(tools, is_tool), "tools are not valid"),
        (2, lacks(nodes, is_node), "messages are not valid"),
        (3, lacks(calls, lambda x: J.kind(J.at(x, "$.finish_reason")) == "string"), "model calls are not valid"),
        (4, J.number(part("$.rewards.tests.score")).isNull(), "reward is missing"),
        (5, ~named, "task is not identified"),
        (5, (F.size(calls) <= 0) | lacks(calls, same), "sampling is missing"),
    )
    fault = F.coalesce(*(F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))) for stage, broken, reason in rules))
    return traces.select(*keep, fault.alias("__fault")).where("__fault is not null").select(*keep, "__fault.stage", "__fault.reason")


def _entry(trace: dict, parser: str) -> tuple[str | None, str | None, str | None]:
    """``(task_id, entry, fault)``: the canonical entry of a trace that has no fault of an earlier stage."""
    data = trace.get("task", {}).get("data", {}) if isinstance(trace.get("task"), dict) else {}
    settings = [c.get("sampling") if isinstance(c, dict) else None for c in trace.get("calls") or ()] if isinstance(trace.get("calls"), list) else []
    if not isinstance(data, dict) or not settings or not isinstance(settings[0], dict):
        return None, None, "sampling is missing"
    if len({canonical(s) for s in settings}) > 1:
        return None, None, "sampling changed within a trace"
    entry = {k: data.get(k) for k in IDENTITY} | {"tools": trace.get("tools"), "parser": parser, "sampling": settings[0]}
    return str(data.get("task_id")), canonical(entry), None


def comparison_entries(lines: DataFrame, parser: str, keep: list[str]) -> DataFrame:
    """``keep, trace_ord, task_id, entry, fault`` of the traces of lines, entries to the byte (``0`` isn't ``0.0``).

    Settings of sampling have to be the same for all calls of a trace. Lines and
    traces that aren't objects give no row; they are faults of the scan.
    """

    @F.pandas_udf("array<struct<trace_ord: int, task_id: string, entry: string, fault: string>>")
    def entries(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                traces = json.loads(text)["traces"] if text else []
            except (ValueError, TypeError, KeyError, RecursionError):
                return []
            listed = enumerate(traces) if isinstance(traces, list) else ()
            return [dict(zip(("trace_ord", "task_id", "entry", "fault"), (i, *_entry(t, parser)))) for i, t in listed if isinstance(t, dict)]

        return texts.map(one)

    return lines.select(*keep, F.explode(entries("line")).alias("x")).select(*keep, "x.*")


def measure_report(frames: dict[str, DataFrame], entries: DataFrame, parser: str, key: list[str], file: str = "file_ord", by: tuple[str, ...] = ()) -> DataFrame:
    """The report over all traces, or one per group of columns ``by`` that all frames and ``entries`` have.

    ``frames`` are ``traces, nodes, tools, model_calls`` as :func:`sources.traces.flatten`
    gives them, ``entries`` those of :func:`comparison_entries`. Calls of tools that
    aren't there, or whose arguments don't fit the tool's parameters, are invalid.
    A missing number of cases is passed over; the mean reward is that of traces with
    one. Without traces there is no row (``by``), or one of zeros.
    """
    if not parser:
        raise ValueError("the parser needs a name")
    heads = frames["traces"].groupBy(*by).agg(
        F.count_distinct(file).alias("trace_files"), F.count("*").alias("traces"), F.coalesce(F.sum("passed_cases"), F.lit(0)).alias("passed_cases"),
        F.coalesce(F.sum("total_cases"), F.lit(0)).alias("total_cases"), F.avg("reward").alias("sealed_validation_reward"),
    )
    turns = measure_turns(frames["nodes"], frames["tools"], by, tuple(key))
    calls = measure_model_calls(frames["model_calls"], by)
    prints = fingerprint(entries.where("entry is not null"), "task_id", "entry", by).withColumnRenamed("sha256", "comparison_sha256")
    # parts of one group meet in one aggregation, so no join is needed
    parts = heads.unionByName(turns, True).unionByName(calls, True).unionByName(prints, True)
    whole = parts.groupBy(*by).agg(*(F.max(c).alias(c) for c in parts.columns if c not in by))
    made: dict[str, Column] = {"schema_version": F.lit(SCHEMA_VERSION), "parser": F.lit(parser)}
    zero = [c for c in COLUMNS if c not in ("comparison_sha256", "sealed_validation_reward", *made)]
    return whole.select(*by, *((made[c] if c in made else F.coalesce(c, F.lit(0)) if c in zero else F.col(c)).alias(c) for c in COLUMNS))
