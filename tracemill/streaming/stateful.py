"""Stateful operators on streams: the same steps as in batch, in the order of arrival."""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracemill.operators.stateful import Limiter


def in_order(frames: Iterator[pd.DataFrame], columns: list[str], most_rows: int = 100_000, most_runs: int = 32) -> Iterator[tuple]:
    """All rows of a key by the first of ``columns``, equal ones as they come, in whatever frames they come.

    About ``most_rows`` rows are sorted in memory. What is more goes to the local
    disk as sorted runs; ``most_runs`` of them are merged into a longer one.
    """

    def read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def spill(rows: Iterator[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0])
        while part := list(islice(rows, 1000)):
            pickle.dump(part, file)
        file.seek(0)
        return read(file)

    def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
        return heapq.merge(*runs, key=itemgetter(0))

    def in_memory() -> Iterator[tuple]:
        whole = pd.concat(held).sort_values(columns[0], kind="stable")
        held.clear()
        return zip(*(whole[c].tolist() for c in columns))

    held: list[pd.DataFrame] = []
    levels: list[list[Iterator[tuple]]] = [[]]
    n = 0
    for pdf in frames:
        held.append(pdf[columns])
        n += len(pdf)
        if n < most_rows:
            continue
        levels[0].append(spill(in_memory()))
        n = k = 0
        while len(levels[k]) == most_runs:
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(spill(merged(levels[k])))
            levels[k] = []
            k += 1
    older = [run for level in reversed(levels) for run in level]
    return merged([*older, in_memory()] if held else older)


def stream_limiter(calls: DataFrame, key: str, now: str, limit: int, window: float, most_rows: int = 10_000) -> DataFrame:
    """``key, now, allowed, retry_after`` of a stream of calls.

    The state of a key is the times of its live admissions, ``limit`` at most.
    Calls of one batch are taken by time, batches as they come. ``most_rows`` is
    only how many rows of a key are given back at once.
    """

    def step(keys: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = Limiter(limit, window, list(state.get[0]) if state.exists else [])
        calls = in_order(rows, ["now"])
        while part := list(islice(calls, most_rows)):
            out = [(keys[0], now, *limiter.offer(float(now))) for (now,) in part]
            yield pd.DataFrame(out, columns=["key", "now", "allowed", "retry_after"])
        state.update((list(limiter.held),))

    picked = calls.select(F.col(key).cast("string").alias("key"), F.col(now).cast("double").alias("now")).where("key is not null and now is not null")
    return picked.groupBy("key").applyInPandasWithState(step, "key string, now double, allowed boolean, retry_after double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_ledger(events: DataFrame, account: str, most_rows: int = 10_000) -> DataFrame:
    """``account, seq, balance, error`` after each applied event of a stream ``account, seq, kind, amount``.

    Events of one batch are taken by sequence number, batches as they come. A
    number not above the last applied one is passed over without a row: an event
    delivered twice, or in a later batch than a higher one, changes nothing.
    ``most_rows`` is only how many events are handled at once.
    """

    def step(keys: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        balance, last, error = state.get if state.exists else (0, -(1 << 62), None)
        ordered = in_order(rows, ["seq", "kind", "amount"])
        while part := list(islice(ordered, most_rows)):
            out = []
            for seq, kind, amount in part:
                if error is not None or seq <= last:
                    continue
                after = {"deposit": balance + amount, "withdraw": balance - amount, "snapshot": amount}.get(kind)
                if after is None:
                    error = "unknown event"
                elif kind != "snapshot" and amount <= 0:
                    error = "amount must be positive"
                elif kind == "withdraw" and after < 0:
                    error = "insufficient funds"
                else:
                    balance, last = int(after), int(seq)
                out.append((keys[0], int(seq), balance, error))
            yield pd.DataFrame(out, columns=["account", "seq", "balance", "error"])
        state.update((balance, last, error))

    picked = events.select(F.col(account).cast("string").alias("account"), "seq", "kind", F.col("amount").cast("bigint").alias("amount")).where("account is not null and seq is not null")
    return picked.groupBy("account").applyInPandasWithState(step, "account string, seq bigint, balance bigint, error string", "balance bigint, last bigint, error string", "append", GroupStateTimeout.NoTimeout)


def stream_budget(calls: DataFrame, episode: str, tokens: str, budget: int) -> DataFrame:
    """``episode, tokens, spent, stopped`` of each call; after the budget is reached an episode's calls are refused."""

    def step(keys: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        for pdf in rows:
            out = []
            for t in pdf["tokens"]:
                stopped = spent >= budget
                spent += 0 if stopped else int(t)
                out.append((keys[0], int(t), spent, stopped))
            yield pd.DataFrame(out, columns=["episode", "tokens", "spent", "stopped"])
        state.update((spent,))

    picked = calls.select(F.col(episode).cast("string").alias("episode"), F.col(tokens).cast("bigint").alias("tokens")).where("episode is not null and tokens is not null")
    return picked.groupBy("episode").applyInPandasWithState(step, "episode string, tokens bigint, spent bigint, stopped boolean", "spent bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, by: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window of event time; the state of a window goes when the watermark passes it."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    w = F.window("__at", length, slide) if slide else F.window("__at", length)
    return timed.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def first_per_key(rows: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key's first row within the watermark: results kept by digest are computed once."""
    return rows.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(keys).drop("__at")


def capped_calls(rows: DataFrame, episode: str, digest: str, most: int = 20) -> DataFrame:
    """``episode, digest, call, cached, refused`` of a stream of calls, as they come.

    An episode has ``most`` calls; later ones are refused. A call whose digest an earlier
    admitted one had is answered from what is kept (``cached``). The state of an
    episode is its admitted digests, ``most`` at most.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls, known = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        for pdf in frames:
            out = []
            for d in pdf["digest"].tolist():
                refused = calls >= most
                calls += not refused
                out.append((keys[0], d, calls, not refused and d in known, refused))
                if not refused and d not in known:
                    known.append(d)
            yield pd.DataFrame(out, columns=["episode", "digest", "call", "cached", "refused"])
        state.update((calls, known))

    picked = rows.select(F.col(episode).cast("string").alias("episode"), F.col(digest).cast("string").alias("digest")).where("episode is not null")
    return picked.groupBy("episode").applyInPandasWithState(step, "episode string, digest string, call bigint, cached boolean, refused boolean", "calls bigint, known array<string>", "append", GroupStateTimeout.NoTimeout)
