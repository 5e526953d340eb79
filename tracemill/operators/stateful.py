"""Operators whose next step depends on the last: ledgers, limiters, plans, graphs, stack machines."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- ledgers ----------------------------------------------------------------------------------

def replay_ledger(events: DataFrame, account: list[str], arrival: str, upto: Column | None = None) -> DataFrame:
    """``balance, last_seq, error`` of each account from ``seq, kind, amount``.

    Of equal sequence numbers the first to arrive counts; deposits, withdrawals
    and snapshots (which set the balance) apply in sequence; the first error
    stops an account and stays.

    The fold is a running sum that starts anew at each snapshot. What it gives
    up to the first error doesn't depend on errors, so nothing is gathered: an
    account of any length is one sorted, spilling pass.
    """
    rows = events.where(upto) if upto is not None else events
    unique = rows.groupBy(*account, "seq").agg(F.min_by(F.struct("kind", "amount"), arrival).alias("e")).select(*account, "seq", "e.*")
    kind, amount = F.col("kind"), F.col("amount").cast("bigint")
    upto_here = Window.partitionBy(*account).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy(*account, "__era").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(kind.isin("deposit", "snapshot"), amount).when(kind == "withdraw", -amount).otherwise(F.lit(0))
    fault = (
        F.when(~F.coalesce(kind.isin("deposit", "withdraw", "snapshot"), F.lit(False)) | amount.isNull(), "unknown event")
        .when((kind != "snapshot") & (amount <= 0), "amount must be positive")
        .when((kind == "withdraw") & (F.col("__balance") < 0), "insufficient funds")
    )
    folded = (
        unique.withColumn("__era", F.sum((kind == "snapshot").cast("int")).over(upto_here))
        .withColumn("__balance", F.sum(change).over(since))
        .withColumn("__fault", fault)
        .withColumn("__fine", F.count("__fault").over(upto_here) == 0)
    )
    fine = F.col("__fine")
    return folded.groupBy(*account).agg(
        F.coalesce(F.max_by(F.when(fine, F.col("__balance")), F.when(fine, F.col("seq"))), F.lit(0)).alias("balance"),
        F.max(F.when(fine, F.col("seq"))).alias("last_seq"),
        F.min_by("__fault", F.when(F.col("__fault").isNotNull(), F.col("seq"))).alias("error"),
    )


def compact_ledger(events: DataFrame, account: list[str], arrival: str, upto: int) -> DataFrame:
    """Events up to a sequence number as one snapshot, the later ones as they are."""
    state = replay_ledger(events, account, arrival, F.col("seq") <= upto)
    snapshot = state.where("error is null and last_seq is not null").select(*account, F.col("last_seq").alias("seq"), F.lit("snapshot").alias("kind"), F.col("balance").alias("amount"))
    return snapshot.unionByName(events.where(F.col("seq") > upto).select(*account, "seq", "kind", F.col("amount").cast("bigint").alias("amount")))


# -- rate limits --------------------------------------------------------------------------------

class Limiter:
    """Admits at most ``limit`` events in any ``window``; denied ones leave no trace."""

    def __init__(self, limit: int, window: float, held: list[float] | None = None):
        self.limit, self.window, self.held = limit, window, deque(held or ())

    def offer(self, now: float) -> tuple[bool, float]:
        while self.held and now - self.held[0] >= self.window:
            self.held.popleft()
        if len(self.held) < self.limit:
            self.held.append(now)
            return True, 0.0
        return False, self.held[0] + self.window - now


def limit_rate(calls: DataFrame, key: str, now: str, order: list[str], limit: int, window: float) -> DataFrame:
    """Add ``allowed`` and ``retry_after`` to each call, keys apart, in order.

    Sorted partitions are read as a stream; what is held of a key is at most
    ``limit`` times, however many calls it has.
    """
    schema = calls.schema.add("allowed", "boolean").add("retry_after", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = object(), Limiter(limit, window)
        for pdf in batches:
            allowed, after = [], []
            for k, t in zip(pdf[key].tolist(), pdf[now].tolist()):
                if k != current:
                    current, limiter = k, Limiter(limit, window)
                a, r = limiter.offer(float(t))
                allowed.append(a)
                after.append(r)
            yield pdf.assign(allowed=allowed, retry_after=after)

    return calls.where(F.col(key).isNotNull() & F.col(now).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


# -- plans ----------------------------------------------------------------------------------------

_MULTIPLIER, _INCREMENT = 6364136223846793005, 1442695040888963407  # fixed values of a common 64-bit generator


def backoff_delays(base: float, factor: float, max_delay: float, max_elapsed: float, max_attempts: int, seed: int) -> list[float]:
    """Capped exponential delays with jitter, until the elapsed time would cross its limit."""
    out, elapsed, state = [], 0.0, seed & ((1 << 64) - 1)
    for attempt in range(max_attempts):
        state = (state * _MULTIPLIER + _INCREMENT) & ((1 << 64) - 1)
        delay = min(max_delay, base * factor**attempt) * (state >> 11) / (1 << 53)
        elapsed += delay
        if elapsed > max_elapsed:
            break
        out.append(delay)
    return out


def backoff_plans(requests: DataFrame) -> DataFrame:
    """A row per planned attempt of each request ``id, base, factor, max_delay, max_elapsed, max_attempts, seed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.id, i, d) for r in pdf.itertuples() for i, d in enumerate(backoff_delays(r.base, r.factor, r.max_delay, r.max_elapsed, int(r.max_attempts), int(r.seed)))]
            yield pd.DataFrame(rows, columns=["id", "attempt", "delay"])

    return requests.mapInPandas(run, "id bigint, attempt int, delay double")


# -- graphs ---------------------------------------------------------------------------------------

def topological_order(nodes: list[str], edges: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """``(order, cycle)``: the smallest free node first; a cycle if not all can be ordered.

    The cycle starts at its smallest possible node and always goes on to the
    smallest successor from which it can still be closed.
    """
    after: dict[str, set[str]] = {n: set() for n in nodes}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    waiting = dict.fromkeys(after, 0)
    for targets in after.values():
        for b in targets:
            waiting[b] += 1
    free = [n for n, w in waiting.items() if not w]
    heapq.heapify(free)
    order = []
    while free:
        n = heapq.heappop(free)
        order.append(n)
        for b in after[n]:
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(free, b)
    rest = set(after) - set(order)
    if not rest:
        return order, []

    def reach(start: str) -> set[str]:
        seen, todo = set(), [start]
        while todo:
            for b in after[todo.pop()] & rest:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    before: dict[str, set[str]] = {n: set() for n in rest}
    for a in rest:
        for b in after[a] & rest:
            before[b].add(a)
    anchor = next(n for n in sorted(rest) if n in reach(n))
    back, todo = {anchor}, [anchor]
    while todo:
        for a in before[todo.pop()]:
            if a not in back:
                back.add(a)
                todo.append(a)
    cycle, at = [anchor], min(after[anchor] & back)
    while at != anchor and at not in cycle:
        cycle.append(at)
        at = min(after[at] & back)
    return order, cycle


def sort_graphs(edges: DataFrame, graph: str = "graph", source: str = "src", target: str = "dst") -> DataFrame:
    """Each graph's nodes with their ``place``, or those of a cycle (``cyclic``). Repeated edges count once.

    An order is a sequential result, so a graph is one group; graphs run side by side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(a, b) for a, b in zip(pdf[source], pdf[target]) if a is not None and b is not None]
        lone = [x for x in (*pdf[source], *pdf[target]) if x is not None]
        order, cycle = topological_order(lone, pairs)
        names = cycle or order
        return pd.DataFrame({graph: pdf[graph].iloc[0], "node": names, "place": range(len(names)), "cyclic": bool(cycle)})

    kind = dict(edges.dtypes)
    picked = edges.select(graph, source, target).distinct()
    return picked.groupBy(graph).applyInPandas(run, f"{graph} {kind[graph]}, node {kind[source]}, place int, cyclic boolean")


# -- stack machine ---------------------------------------------------------------------------------

def evaluate_rpn(tokens: Column) -> Column:
    """``struct(value, error)`` of postfix tokens over whole numbers; division truncates.

    Errors: ``empty``, ``bad token``, ``stack underflow``, ``division by zero``,
    ``leftover operands``. A result beyond 64 bits is ``overflow``.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("stack"), F.lit(None).cast("string").alias("error"))

    def step(state: Column, token: Column) -> Column:
        stack = state["stack"]
        n = F.size(stack)
        b, a = F.get(stack, n - 1), F.get(stack, n - 2)
        operator = token.isin("+", "-", "*", "/")
        number = F.when(token.rlike(r"^-?[0-9]+\z"), token.try_cast("bigint"))
        result = (
            F.when(token == "+", F.try_add(a, b)).when(token == "-", F.try_subtract(a, b)).when(token == "*", F.try_multiply(a, b))
            .otherwise(F.when(b != 0, F.floor(F.abs(a) / F.abs(b)) * F.signum(a) * F.signum(b)).cast("bigint"))
        )
        error = (
            F.when(~operator & number.isNull(), "bad token")
            .when(operator & (n < 2), "stack underflow")
            .when((token == "/") & (b == 0), "division by zero")
            .when(operator & result.isNull(), "overflow")
        )
        rest = F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0)))
        pushed = F.when(operator, F.concat(rest, F.array(result))).otherwise(F.concat(stack, F.array(number)))
        failed = F.coalesce(state["error"], error)
        return F.struct(F.when(failed.isNull(), pushed).otherwise(stack).alias("stack"), failed.alias("error"))

    end = F.aggregate(tokens, start, step)
    error = F.coalesce(end["error"], F.when(F.size(end["stack"]) == 0, "empty").when(F.size(end["stack"]) > 1, "leftover operands"))
    return F.struct(F.when(error.isNull(), end["stack"][0]).alias("value"), error.alias("error"))
