"""From traces to training rows: filters, guards, projection, lengths, masks."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracemill.functions import strict_json as J
from tracemill.operators.trajectories import failed_result, first_wins, parsed_calls, sampled_turns, ways
from tracemill.session import cut

DONE = "agent_completed"


def successful(traces: DataFrame) -> DataFrame:
    """Completed traces with ``ok`` true and a score of one."""
    return traces.where(F.col("ok") & (F.col("score") == 1.0) & (F.col("stop_condition") == DONE))


def guard_holdout(traces: DataFrame, split: str = "split") -> DataFrame:
    """The same rows; an error if one is of the holdout split, whatever else it is.

    Looked for at once, up to the first such row: a check within the plan could
    be moved behind a filter that hides the row.
    """
    if traces.where(F.col(split) == "holdout").limit(1).count():
        raise ValueError("holdout traces can't be exported")
    return traces


def message(nodes: DataFrame) -> Column:
    """A node as a message: role, text, calls in one shape, the answered call."""
    calls = J.items(J.parse_one(F.col("tool_calls")))

    def shape(call: Column) -> Column:
        nested = J.at(call, "$.function")
        inner = F.when(J.kind(nested) == "object", nested).otherwise(call)
        function = F.struct(J.text(J.at(inner, "$.name")).alias("name"), F.to_json(J.arguments(J.at(inner, "$.arguments"))).alias("arguments"))
        return F.struct(J.text(J.at(call, "$.id")).alias("id"), F.lit("function").alias("type"), function.alias("function"))

    return F.struct("role", F.col("text").alias("content"), F.transform(calls, shape).alias("tool_calls"), "tool_call_id")


def tool_projection(tools: DataFrame) -> DataFrame:
    """Per trace the tools in order, as ``{type, function{name, description, parameters}}``; incomplete ones are an error."""
    whole = F.col("name").isNotNull() & F.col("description").isNotNull() & F.col("parameters").isNotNull()
    function = F.struct("name", "description", "parameters")
    entry = F.when(whole, F.struct(F.lit("function").alias("type"), function.alias("function")))
    checked = F.coalesce(entry, F.raise_error(F.lit("a tool lacks its name, description or parameters")).cast("struct<type string, function struct<name string, description string, parameters string>>"))
    return tools.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tool_ord", checked.alias("t")))), lambda x: x["t"]).alias("tools"))


ROLES = ("system", "user", "assistant", "tool")


def export_faults(nodes: DataFrame, mapping: dict[str, str], place: list[str]) -> DataFrame:
    """``place, trace_id, node, reason``: nodes that can't be exported, each with its first fault.

    A message has one of four roles and a text. An assistant's calls, where it has any, are a list of
    calls with an id, a name and arguments that are, or parse to, an object (an explicit null is no
    list); those of a sampled turn are of tools in ``mapping``. A tool's message names the call it answers.
    """
    value = J.parse_one(F.col("tool_calls"))
    calls = J.items(value)

    def inner(call: Column) -> Column:
        nested = J.at(call, "$.function")
        return F.when(J.kind(nested) == "object", nested).otherwise(call)

    def whole(call: Column) -> Column:
        return J.text(J.at(call, "$.id")).isNotNull() & J.text(J.at(inner(call), "$.name")).isNotNull() & J.arguments(J.at(inner(call), "$.arguments")).isNotNull()

    known = F.array(*map(F.lit, sorted(mapping))) if mapping else F.array().cast("array<string>")
    strange = F.filter(F.transform(calls, lambda c: J.text(J.at(inner(c), "$.name"))), lambda name: ~F.array_contains(known, name))
    calling = (F.col("role") == "assistant") & F.col("tool_calls").isNotNull()
    reason = (
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role is unknown")
        .when(F.col("text").isNull(), "content is no text")
        .when(calling & calls.isNull(), "calls are no list")
        .when(calling & ~F.forall(calls, lambda c: F.coalesce(whole(c), F.lit(False))), "a call is not whole")
        .when((F.col("role") == "tool") & F.col("tool_call_id").isNull(), "a result names no call")
        .when(calling & F.col("sampled") & (F.size(strange) > 0), F.concat(F.lit("unavailable tool: "), F.get(strange, F.lit(0))))
    )
    return nodes.withColumn("reason", reason).where("reason is not null").select(*dict.fromkeys([*place, "trace_id", "node", "reason"]))


def target_kinds(nodes: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Per sampled turn its kinds: those of its tools, ``final`` for text without calls, ``recovery`` after a failed result."""
    turns = sampled_turns(nodes)
    calls = parsed_calls(turns.select("trace_id", "node", "tool_calls"))
    known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    by_turn = calls.groupBy("trace_id", "node").agg(F.array_sort(F.collect_set(known[F.col("name")])).alias("kinds"), F.count("call_ord").alias("calls"))
    parent = nodes.select("trace_id", F.col("node").alias("parent"), failed_result(F.col("role"), F.col("text")).alias("recovers"))
    joined = turns.select("trace_id", "node", "parent", "text").join(by_turn, ["trace_id", "node"]).join(parent, ["trace_id", "parent"], "left")
    final = F.when((F.col("calls") == 0) & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.array(F.lit("final"))).otherwise(F.array().cast("array<string>"))
    recovery = F.when(F.coalesce("recovers", F.lit(False)), F.array(F.lit("recovery"))).otherwise(F.array().cast("array<string>"))
    return joined.select("trace_id", "node", F.array_sort(F.array_distinct(F.concat("kinds", final, recovery))).alias("kinds"))


def training_rows(traces: DataFrame, nodes: DataFrame, tools: DataFrame, mapping: dict[str, str], order: list[str], strict: bool = False) -> DataFrame:
    """One sample per successful trace: the chain of its last useful turn as messages.

    A turn is useful if it has a kind. Of traces with one id the first in
    ``order`` counts. Traces whose useful turns don't all lie on the chain, or
    without one, give no row. With ``strict`` the first fault of a successful trace
    (see :func:`export_faults`, or a useful turn off the chain) is a ValueError; without it
    calls of other tools have no kind, and traces with faults are to be taken out before.
    """
    kept = cut(first_wins(successful(guard_holdout(traces)), ["trace_id"], order).select("trace_id", "task_id", "split", *order), "kept")
    # all three frames carry the columns of ``order``: another trace of the same id has its own nodes and tools
    place = kept.select("trace_id", *order)
    mine, tools = (part.join(place, ["trace_id", *order], "left_semi") for part in (nodes, tools))
    mine = cut(mine, "nodes")  # read several times
    if strict:
        row = export_faults(mine, mapping, order).orderBy(*order, "node").limit(1).collect()
        if row:
            raise ValueError(f"{row[0]['trace_id']}, node {row[0]['node']}: {row[0]['reason']}")
    useful = cut(target_kinds(mine, mapping).where("size(kinds) > 0"), "useful")
    last = useful.groupBy("trace_id").agg(F.max("node").alias("node"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("target_kinds"))
    way = cut(ways(mine, last).drop("leaf"), "ways")
    on = useful.join(way, ["trace_id", "node"], "left").groupBy("trace_id").agg(F.bool_and(F.col("place").isNotNull()).alias("whole"))
    if strict:
        off = on.where("not whole").agg(F.min("trace_id").alias("trace_id")).first()["trace_id"]
        if off is not None:
            raise ValueError(f"{off}: a useful turn lies off the chain")
    whole = last.join(on.where("whole"), "trace_id", "left_semi")
    steps = way.join(mine.withColumn("message", message(mine)), ["trace_id", "node"])
    messages = steps.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "message"))), lambda x: x["message"]).alias("messages"))
    rows = whole.join(messages, "trace_id").join(kept, "trace_id").join(tool_projection(tools), "trace_id", "left")
    return rows.select(F.lit(2).alias("schema_version"), "task_id", "trace_id", F.col("node").alias("turn_index"), "target_kinds", "messages", "tools", "split")


def split_counts(samples: DataFrame, least: dict[str, int]) -> DataFrame:
    """Distinct traces per split beside the least that is asked for."""
    spark = samples.sparkSession
    asked = spark.createDataFrame(sorted(least.items()), "split string, least bigint")
    counts = samples.groupBy("split").agg(F.count_distinct("trace_id").alias("trajectories"))
    return asked.join(counts, "split", "full").select("split", F.coalesce("trajectories", F.lit(0)).alias("trajectories"), "least", (F.coalesce("trajectories", F.lit(0)) >= F.coalesce("least", F.lit(0))).alias("enough"))


def missing_kinds(samples: DataFrame, required: list[str], kinds: str = "target_kinds") -> DataFrame:
    """Required kinds that no sample has."""
    spark = samples.sparkSession
    return spark.createDataFrame([(k,) for k in required], "kind string").join(samples.select(F.explode(kinds).alias("kind")).distinct(), "kind", "left_anti")


def token_length(texts: str, count: Callable[[str], int]):
    """The tokens of a text column by a given counter, as a column."""

    @F.pandas_udf(LongType())
    def length(values: pd.Series) -> pd.Series:
        return values.map(lambda x: count(x) if x is not None else 0)

    return length(F.col(texts))


def sample_lengths(rows: DataFrame, count: Callable[[list[dict], bool], int]) -> DataFrame:
    """Add ``total_tokens``, ``completion_tokens`` and ``length_fault`` (null if the sample can be trained on).

    ``count(messages, generation)`` gives the tokens of messages, with the opening of a
    reply if ``generation``. The completion is the last message, which has to be an
    assistant's: the tokens of all less those of the prompt, two at least.
    """

    @F.pandas_udf("total_tokens bigint, completion_tokens bigint, length_fault string")
    def measured(messages: pd.Series) -> pd.DataFrame:
        def one(text):
            said = json.loads(text) if text is not None else None
            if not said:
                return None, None, "no messages"
            if not isinstance(said[-1], dict) or said[-1].get("role") != "assistant":
                return None, None, "the last message is not an assistant's"
            total = count(said, False)
            own = total - count(said[:-1], True)
            return total, own, None if own >= 2 else "no completion to train on"

        return pd.DataFrame([one(t) for t in messages], columns=["total_tokens", "completion_tokens", "length_fault"]).astype({"total_tokens": "Int64", "completion_tokens": "Int64"})

    return rows.withColumn("__length", measured(F.to_json("messages"))).select("*", "__length.*").drop("__length")


def prepare_rows(rows: DataFrame, count: Callable[[list[dict], bool], int], longest: int, least: dict[str, int], required: list[str]) -> DataFrame:
    """Samples of at most ``longest`` tokens, without the holdout split, for training.

    Checked before anything is dropped: every sample can be trained on. Checked after:
    each split of ``least`` has so many traces left, and the train split every required
    kind. The first check that fails is a ValueError. Samples are measured once.
    """
    measured = cut(sample_lengths(rows.where(F.col("split") != "holdout"), count), "lengths")
    fault = measured.agg(F.min_by("length_fault", F.when(F.col("length_fault").isNotNull(), F.col("trace_id"))).alias("why")).first()["why"]
    if fault is not None:
        raise ValueError(fault)
    kept = within_length(measured, F.col("total_tokens"), longest).drop("length_fault")
    short = [r["split"] for r in split_counts(kept, least).where("not enough").collect()]  # a row per split
    if short:
        raise ValueError(f"too few traces fit the length: {', '.join(sorted(short))}")
    lacking = [r["kind"] for r in missing_kinds(kept.where("split = 'train'"), required).collect()]  # a row per required kind
    if lacking:
        raise ValueError(f"train samples lack kinds: {', '.join(sorted(lacking))}")
    return kept


def within_length(rows: DataFrame, length: Column, longest: int) -> DataFrame:
    """Rows of at most ``longest`` tokens."""
    return rows.where(length <= longest)


#: Where a prompt's own part ends. A fixed value of the prompts.
MARKER = "\nYou work in an isolated Linux workspace"


def system_core(prompt: Column, marker: str = MARKER) -> Column:
    """A system prompt up to its marker, without its one model line and one date line; null if there aren't one each."""
    head = F.substring_index(prompt, marker, 1)
    once = (F.regexp_count(head, F.lit(r"(?m)^- Model: ")) == 1) & (F.regexp_count(head, F.lit(r"(?m)^Today: ")) == 1) & (F.instr(prompt, marker) > 0)
    return F.when(once, F.regexp_replace(head, r"(?m)^(- Model: |Today: ).*\n?", ""))


def same_everywhere(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the common value of each column, or null where rows differ."""
    return rows.agg(*(F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.min(c)).alias(c) for c in columns))


def row_faults(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows ``messages, tools`` with ``fault``: no system message with text in front, a tool named twice, or other tools than ``names``."""
    first, given = F.get("messages", F.lit(0)), F.transform("tools", lambda t: t["function"]["name"])
    opens = (first["role"] == "system") & (F.trim(first["content"]) != "")
    fault = (
        F.when(~F.coalesce(opens, F.lit(False)), "no system message in front")
        .when(F.size(given) != F.size(F.array_distinct(given)), "a tool is named twice")
        .when(~F.coalesce(F.array_sort(given) == F.array_sort(F.array(*map(F.lit, names))), F.lit(False)), "other tools")
    )
    return rows.withColumn("fault", fault)


def installed_task(data: DataFrame, tasks: DataFrame) -> DataFrame:
    """Task data with ``fault``: no installed task of its id, several, or one of another revision or digest."""
    found = tasks.groupBy("task_id").agg(F.count("*").alias("__n"), F.min(F.struct("task_revision", "task_digest")).alias("__task"))
    same = F.col("__task.task_revision").eqNullSafe(F.col("task_revision")) & F.col("__task.task_digest").eqNullSafe(F.col("task_digest"))
    fault = F.when(F.col("__n").isNull(), "not installed").when(F.col("__n") > 1, "installed twice").when(~same, "another revision")
    return data.join(found, "task_id", "left").withColumn("fault", fault).drop("__n", "__task")
