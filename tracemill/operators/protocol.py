"""Probes of a model's tool protocol: replies held against what was asked for."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tracemill.operators.trajectories import rate
from tracemill.operators.verdicts import argument_faults

CHOICE = StructType([StructField("message", StringType()), StructField("finish_reason", StringType()), StructField("completion_tokens", IntegerType()), StructField("fault", StringType())])
RESULT = StructType(
    [
        StructField("passed", BooleanType()), StructField("parsed_calls", IntegerType()), StructField("invalid_calls", IntegerType()), StructField("ended", BooleanType()),
        StructField("looped", BooleanType()), StructField("reason", StringType()), StructField("signatures", ArrayType(StringType())),
    ]
)


def choice_of(reply: str | None) -> tuple[dict | None, str | None, int, str | None]:
    """``(message, finish reason, completion tokens, fault)`` of a reply with exactly one choice."""
    try:
        value = json.loads(reply or "")
    except ValueError:
        return None, None, 0, "reply is not JSON"
    choices = value.get("choices") if isinstance(value, dict) else None
    if not isinstance(choices, list) or len(choices) != 1 or not isinstance(choices[0], dict):
        return None, None, 0, "not exactly one choice"
    message, reason = choices[0].get("message"), choices[0].get("finish_reason")
    if not isinstance(message, dict) or not isinstance(reason, str):
        return None, None, 0, "choice lacks a message or finish reason"
    usage = value.get("usage")
    tokens = usage.get("completion_tokens") if isinstance(usage, dict) else None
    return message, reason, tokens if isinstance(tokens, int) and not isinstance(tokens, bool) else 0, None


@F.pandas_udf(CHOICE)
def reply_choice(replies: pd.Series) -> pd.DataFrame:
    rows = [choice_of(r) for r in replies]
    return pd.DataFrame([(json.dumps(m) if m is not None else None, r, t, f) for m, r, t, f in rows], columns=[f.name for f in CHOICE])


def probe_result(reply: str | None, tool: str, expected: dict, schemas: dict[str, dict]) -> tuple:
    """How a reply answers a probe that asks for one call of a tool with at least the expected arguments.

    Calls are functions with a name and arguments as JSON text. A call is parsed
    if its arguments fit the schema of a known tool. Reasons in order: the calls
    are no valid list, they aren't the call asked for, the reply didn't finish by it.
    """
    message, finish, _, fault = choice_of(reply)
    if fault:
        return False, 0, 1, False, False, fault, []
    ended = finish in ("stop", "tool_calls")
    calls = message.get("tool_calls")
    if not isinstance(calls, list):
        return False, 0, 1, finish != "length", finish == "length", "calls are not a list", []
    parsed, faults, signatures = [], [], []
    for call in calls:
        function = call.get("function") if isinstance(call, dict) and call.get("type") == "function" else None
        name, text = (function.get("name"), function.get("arguments")) if isinstance(function, dict) else (None, None)
        try:
            arguments = json.loads(text) if isinstance(text, str) else None
        except ValueError:
            arguments = None
        if not isinstance(name, str) or not isinstance(arguments, dict):
            faults.append("malformed call")
            continue
        signatures.append(json.dumps({"arguments": arguments, "name": name}, sort_keys=True))
        why = argument_faults(schemas[name], arguments) if name in schemas else f"no tool {name}"
        if why:
            faults.append(why)
        else:
            parsed.append((name, arguments))
    looped = finish == "length" or len(set(signatures)) < len(signatures)
    fits = len(parsed) == 1 and parsed[0][0] == tool and all(k in parsed[0][1] and parsed[0][1][k] == v for k, v in expected.items())
    reason = faults[0] if faults else None if fits else "not the call asked for"
    reason = reason or (None if finish == "tool_calls" else "reply did not finish by its call")
    invalid = max(len(faults), len(calls) - len(parsed)) if reason else 0
    return reason is None, len(parsed), invalid, ended, looped, reason, signatures


def probe_results(probes: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Probes ``tool, expected, reply`` (JSON texts) with the columns of their result."""

    @F.pandas_udf(RESULT)
    def result(replies: pd.Series, tools: pd.Series, expected: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([probe_result(r, t, json.loads(e), schemas) for r, t, e in zip(replies, tools, expected)], columns=[f.name for f in RESULT])

    return probes.withColumn("r", result("reply", "tool", "expected")).select("*", "r.*").drop("r")


def protocol_rates(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rates over probes: passed, with a parsed call, invalid calls, ended, looped."""
    n, parsed, invalid = F.count("*"), F.sum("parsed_calls"), F.sum("invalid_calls")
    return results.groupBy(*by).agg(
        n.alias("probes"),
        rate(F.count_if("passed"), n).alias("valid_call_rate"),
        rate(F.count_if(F.col("parsed_calls") > 0), n).alias("parsed_call_rate"),
        rate(invalid, parsed + invalid).alias("invalid_tool_rate"),
        rate(F.count_if("ended"), n).alias("end_token_rate"),
        rate(F.count_if("looped"), n).alias("loop_rate"),
    )


def first_failure(checks: list[tuple[Column, str]]) -> Column:
    """The reason of the first check that doesn't hold (a null doesn't), null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks))


def protocol_gate(rates: DataFrame) -> DataFrame:
    """Rates with ``failure``: the first rule that a model breaks."""
    whole, none = F.lit(1.0), F.lit(0.0)
    return rates.withColumn("failure", first_failure([
        (F.col("valid_call_rate") == whole, "not every probe passed"), (F.col("parsed_call_rate") == whole, "not every probe has a parsed call"),
        (F.col("invalid_tool_rate") == none, "there are invalid calls"), (F.col("end_token_rate") == whole, "not every reply ended"), (F.col("loop_rate") == none, "there are loops"),
    ]))
