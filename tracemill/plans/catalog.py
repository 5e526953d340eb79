"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.plans import agents, nested, relational, streams

_MODULES = (nested, relational, agents, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        out |= module.queries()
    return out


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out |= module.sql()
    return out
