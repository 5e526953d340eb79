"""Metrics of agent trajectories: turns, calls, loops, rates, fingerprints, comparison.

Inputs are flat frames, as ``sources.traces`` makes them: ``nodes(trace_id, node,
parent, sampled, role, content, tool_calls, tool_call_id)`` with JSON text in
``content`` and ``tool_calls``, ``tools(trace_id, tool_ord, name, parameters)``,
``model_calls(trace_id, call_ord, finish_reason, sampling)`` and ``traces``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracemill.functions import strict_json as J
from tracemill.functions.digests import call_signatures
from tracemill.operators.verdicts import argument_fault


def sampled_turns(nodes: DataFrame) -> DataFrame:
    """Sampled messages of the assistant, in the order of their nodes."""
    return nodes.where(F.col("sampled") & (F.col("role") == "assistant"))


def parsed_calls(turns: DataFrame) -> DataFrame:
    """A row per element of each turn's calls, and one for calls that are no list.

    ``listed`` tells whether the calls are a list (a missing value is an empty
    one), ``call_ord`` the element's place, ``name`` and ``arguments`` (JSON text)
    are null where the element is malformed. A nested ``function`` wins over flat fields.
    """
    value = J.parse_one(F.col("tool_calls"))
    listed = F.col("tool_calls").isNull() | F.coalesce(J.kind(F.col("__calls")) == "array", F.lit(False))
    base = turns.withColumn("__calls", value).withColumn("listed", listed)
    rows = base.select("*", F.posexplode_outer(F.when(F.col("listed"), F.coalesce(J.items(F.col("__calls")), F.array().cast("array<variant>")))).alias("call_ord", "__call"))
    nested = J.at(F.col("__call"), "$.function")
    inner = F.when(J.kind(nested) == "object", nested).otherwise(F.col("__call"))
    name, arguments = J.text(J.at(F.col("__inner"), "$.name")), J.arguments(J.at(F.col("__inner"), "$.arguments"))
    whole = name.isNotNull() & arguments.isNotNull()
    return (
        rows.withColumn("__inner", inner)
        .withColumn("name", F.when(whole, name))
        .withColumn("arguments", F.when(whole, F.to_json(arguments)))
        .drop("__calls", "__call", "__inner")
    )


def tool_lookup(calls: DataFrame, tools: DataFrame, trace: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Calls with the ``parameters`` of their tool, whether it is ``available``, and why the arguments don't fit (``misfit``).

    Of equal names of a trace the last tool counts. ``trace`` are the columns that
    tell traces apart. Arguments are looked at once per distinct call and tool of a task.
    """
    keys = [F.col(c).alias(f"__{c}") for c in trace]
    last = tools.groupBy(*keys, F.col("name").alias("__tool")).agg(F.max_by("parameters", "tool_ord").alias("parameters"), F.lit(True).alias("available"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in trace] + [F.col("name") == F.col("__tool")]
    joined = calls.join(last, on, "left").drop("__tool", *(f"__{c}" for c in trace)).withColumn("available", F.coalesce("available", F.lit(False)))
    return joined.withColumn("misfit", F.when(F.col("available"), argument_fault("parameters", "arguments")))


def repeated(df: DataFrame, entity: list[str], order: list[str], signatures: str) -> DataFrame:
    """Add ``repeated``: a row's list of signatures has duplicates, or is the entity's last non-empty list again.

    Empty and null lists are never repeated and are passed over.
    """
    filled = F.when(F.size(signatures) > 0, F.col(signatures))
    before = F.last(filled, ignorenulls=True).over(Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    twice = F.size(F.array_distinct(filled)) < F.size(filled)
    return df.withColumn("repeated", F.coalesce(twice | (filled == before), twice, F.lit(False)))


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def measure_turns(nodes: DataFrame, tools: DataFrame | None = None, by: tuple[str, ...] = (), trace: tuple[str, ...] = ("trace_id",)) -> DataFrame:
    """Counts and rates of turns and calls, over all traces or by columns of ``nodes``.

    A turn is parsed if its calls are a non-empty list. An attempt is an element
    of a list or calls that are no list; the latter and malformed calls are
    invalid, as are (where ``tools`` are given) calls of tools that aren't there and those
    with arguments that don't fit their tool's parameters. ``trace`` are the columns that tell traces apart.
    """
    keys = list(dict.fromkeys([*by, *trace, "node"]))
    calls = parsed_calls(sampled_turns(nodes).select(*dict.fromkeys([*keys, "tool_calls"])))
    calls = tool_lookup(calls, tools, trace) if tools is not None else calls.withColumns({"available": F.lit(True), "misfit": F.lit(None).cast("string")})
    present = F.col("call_ord").isNotNull()
    turns = calls.groupBy(*keys).agg(
        F.first("listed").alias("listed"),
        F.count_if(present).alias("calls"),
        F.count_if(present & F.col("name").isNotNull()).alias("parsed"),
        F.count_if(present & F.col("name").isNotNull() & ~F.col("available")).alias("unavailable"),
        F.count_if(present & F.col("name").isNotNull() & F.col("misfit").isNotNull()).alias("misfits"),
        F.first("tool_calls").alias("tool_calls"),
    ).withColumn("signatures", call_signatures("tool_calls"))
    turns = repeated(turns, list(trace), ["node"], "signatures")
    attempts = F.col("calls") + F.when(F.col("listed"), 0).otherwise(1)
    sums = turns.groupBy(*by).agg(
        F.count("*").alias("sampled_turns"),
        F.count_if(F.col("listed") & (F.col("calls") > 0)).alias("parsed_turns"),
        F.sum(attempts).alias("tool_call_attempts"),
        F.sum("parsed").alias("parsed_calls"),
        F.sum(attempts - F.col("parsed") + F.col("unavailable") + F.col("misfits")).alias("invalid_calls"),
        F.sum("unavailable").alias("unavailable_tool_calls"),
        F.count_if("repeated").alias("repeated_call_turns"),
    )
    return sums.select(
        "*",
        rate(F.col("parsed_calls"), F.col("tool_call_attempts")).alias("parsed_tool_call_rate"),
        rate(F.col("invalid_calls"), F.col("tool_call_attempts")).alias("invalid_tool_rate"),
        rate(F.col("repeated_call_turns"), F.col("parsed_turns")).alias("loop_rate"),
    )


def measure_model_calls(model_calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Model calls that were completed (stop, tool_calls) or cut by length, and the end-token rate."""
    reason = F.col("finish_reason")
    sums = model_calls.groupBy(*by).agg(
        F.count("*").alias("model_calls"),
        F.count_if(reason.isin("stop", "tool_calls")).alias("completed_model_calls"),
        F.count_if(reason == "length").alias("length_limited_calls"),
    )
    return sums.withColumn("end_token_rate", rate(F.col("completed_model_calls"), F.col("model_calls")))


def fingerprint(entries: DataFrame, sort_by: str, entry: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``sha256`` of the multiset of JSON entries: sorted by key and text, written as one list.

    A digest is taken in order: copies are counted first, then the distinct entries of a group stream
    sorted through one task, which holds none of them. Rows without an entry are passed over; a group
    without any, and no rows at all, give the digest of an empty list.
    """
    counted = entries.groupBy(*by, F.coalesce(sort_by, F.lit("")).alias("__key"), F.col(entry).alias("__entry")).agg(F.count(entry).alias("__n")).where("__n > 0")
    schema = StructType([*(f for f in counted.schema.fields if f.name in by), StructField("sha256", StringType())])
    spread = counted.repartition(*by) if by else counted.repartition(1)
    found = spread.sortWithinPartitions(*by, "__key", "__entry").select(*by, "__entry", "__n").mapInArrow(_digests(schema.names), schema)
    groups = entries.groupBy(*by).agg(F.lit(hashlib.sha256(b"[]").hexdigest()).alias("sha256"))
    return found.unionByName(groups.withColumn("__none", F.lit(True)), True).groupBy(*by).agg(F.min_by("sha256", F.coalesce("__none", F.lit(False))).alias("sha256"))


def _digests(names: list[str]):
    """The digest of each group of sorted rows: the group's columns, an entry, how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, h = None, None
        kinds: list[pa.DataType] = []

        def made(groups: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*groups))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()])], names)

        for batch in batches:
            *keys, texts, counts = (c.to_pylist() for c in batch.columns)
            kinds = [f.type for f in batch.schema][:-2]
            done = []
            for *key, text, n in zip(*keys, texts, counts):
                if key != group:
                    if h is not None:
                        h.update(b"]")
                        done.append((*group, h.hexdigest()))
                    group, h, mark = key, hashlib.sha256(b"["), b""
                one = b"," + text.encode()
                h.update(mark + one[1:])
                for at in range(0, n - 1, 1000):
                    h.update(one * min(n - 1 - at, 1000))
                mark = b","
            if done:
                yield made(done)
        if h is not None:
            h.update(b"]")
            yield made([(*group, h.hexdigest())])

    return run


#: Why a candidate is turned down: a column, how it is held against the baseline, the reason. Order counts.
RULES = (
    ("sealed_validation_reward", "<=", "reward did not increase"),
    ("parsed_calls", "none", "no call was parsed"),
    ("parsed_tool_call_rate", "<", "parsed-call rate fell"),
    ("invalid_tool_rate", ">", "invalid-call rate rose"),
    ("unavailable_tool_calls", "some", "unavailable tools were called"),
    ("end_token_rate", "<", "end-token rate fell"),
    ("loop_rate", ">", "loop rate rose"),
)


def compare_reports(baseline: DataFrame, candidates: DataFrame, on: str = "comparison_sha256") -> DataFrame:
    """Each candidate beside the baseline of its fingerprint: ``status``, ``reward_delta``, ``reasons``."""
    b, c = baseline.alias("b"), candidates.alias("c")
    tests = {"<=": lambda x, y: x <= y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "none": lambda x, _: x == 0, "some": lambda x, _: x > 0}
    reasons = F.array_compact(F.array(*(F.when(tests[op](F.col(f"c.{col}"), F.col(f"b.{col}")), F.lit(why)) for col, op, why in RULES)))
    return c.join(b, on).select(
        F.col("c.report_id").alias("report_id"),
        F.col("b.report_id").alias("baseline_id"),
        (F.col("c.sealed_validation_reward") - F.col("b.sealed_validation_reward")).alias("reward_delta"),
        F.when(F.size(reasons) == 0, "improved").otherwise("rejected").alias("status"),
        reasons.alias("reasons"),
    )


def best_by(df: DataFrame, by: tuple[str, ...], higher: list[str], lower: list[str], order: str, keep: list[str]) -> DataFrame:
    """The row that is best by ``higher`` (more is better), then ``lower``; of equals the first by ``order``."""
    key = F.struct(*(F.col(c) for c in higher), *(-F.col(c) for c in lower), (-F.col(order)).alias("__order"))
    best = F.max_by(F.struct(*keep), key)
    return df.groupBy(*by).agg(best.alias("__best")).select(*by, "__best.*")


def select_best(df: DataFrame, name: str, higher: list[str], lower: list[str], order: str, keep: list[str], least: int = 1, where: Column | None = None) -> DataFrame:
    """The best of all candidates (see :func:`best_by`), or no row if none passes ``where`` (``status = 'improved'``, say).

    Fewer than ``least`` candidates, and two of one name, are errors: a choice needs something to choose from.
    """
    seen = df.agg(F.count("*").alias("n"), F.count_distinct(name).alias("names")).first()
    if seen["n"] < least or seen["names"] < seen["n"]:
        raise ValueError(f"{least} candidates of different names are needed")
    best = best_by(df if where is None else df.where(where), (), higher, lower, order, keep)
    return best.where(F.coalesce(*(F.col(c).isNotNull() for c in keep)) & F.col(keep[0]).isNotNull())


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the first in order; nulls are a key like others.

    One aggregation with partial results, so copies are dropped before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*(F.col(c) for c in rest))
    return df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("__row")).select(*key, "__row.*").select(*df.columns)


#: Nodes of a trace whose pointers are followed together, before any leads out of them.
CHUNK = 256


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows ``trace_id, chunk, ...`` cut only between chunks, and where chunks begin; one is held back at most."""
    rest: pa.RecordBatch | None = None

    def edges(batch: pa.RecordBatch) -> np.ndarray:
        trace, chunk = batch.column(0), np.asarray(batch.column(1))
        other = np.asarray(pc.not_equal(trace.slice(1), trace.slice(0, len(chunk) - 1))) | (chunk[1:] != chunk[:-1])
        return np.r_[0, np.flatnonzero(other) + 1]

    for batch in batches:
        if batch.num_rows:
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            last = int(edges(whole)[-1])
            rest = whole.slice(last)
            if last:
                part = whole.slice(0, last)
                yield part, edges(part)
    if rest is not None:
        yield rest, edges(rest)


def _parents(node: np.ndarray, parent: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The row of each node's parent if it is in the node's chunk (rows of a chunk are by node), else -1."""
    size = np.diff(np.r_[begin, len(node)])
    part = np.repeat(np.arange(len(begin)), size)
    span = 1 + max(int(np.abs(node).max(initial=0)), int(np.abs(parent).max(initial=0)))
    key, want = part * 2 * span + node, part * 2 * span + parent
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return np.where(key[at] == want, at, -1)


def _out_of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node the first ancestor beyond its chunk (``up``), and the ``depth`` from there; null depths in cycles."""
    for batch, begin in _chunks(batches):
        node, has = np.asarray(batch.column(2)).astype(np.int64), np.asarray(batch.column(3).is_valid())
        parent = np.asarray(batch.column(3).fill_null(-1)).astype(np.int64)
        at = np.where(has, _parents(node, parent, begin), -1)
        top, depth = np.arange(len(node)), np.ones(len(node), np.int64)
        jump = at.copy()
        for _ in range(CHUNK.bit_length() + 1):  # pointers double
            inside = jump >= 0
            top, depth = np.where(inside, top[jump], top), np.where(inside, depth + depth[jump], depth)
            jump = np.where(inside, jump[jump], -1)
        cyclic = jump >= 0
        up = pa.array(parent[top], pa.int32(), mask=cyclic | ~has[top])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), up, pa.array(depth, pa.int64(), mask=cyclic)], ["trace_id", "node", "up", "depth"])


def _chunked(rows: DataFrame, *more: str) -> DataFrame:
    """Rows with the ``chunk`` of their node, whole chunks together, in order."""
    return rows.withColumn("chunk", F.expr(f"cast(floor(node / {CHUNK}) as bigint)")).repartition("trace_id", "chunk").sortWithinPartitions("trace_id", "chunk", *more, "node")


def _pointers(nodes: DataFrame) -> DataFrame:
    from tracemill.session import cut

    rows = _chunked(nodes.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("node").cast("int").alias("node"), F.col("parent").cast("int").alias("parent")).where("trace_id is not null and node is not null"))
    return cut(rows.select("trace_id", "chunk", "node", "parent").mapInArrow(_out_of_chunks, "trace_id string, node int, up int, depth bigint"), "pointers")


def depths(nodes: DataFrame, pointers: DataFrame | None = None) -> DataFrame:
    """How many nodes the way from each node up to its root has, as ``depth``; null if it never gets there.

    Pointers are followed within chunks of a trace first, then across chunks by pointer
    jumping: a round doubles the way, so a trace of any depth costs rounds by the logarithm of its
    chunks, a few bytes a node. One that has passed as many chunks as its trace has nodes and goes
    on is in a cycle. Rows without a trace or node are ignored; ``node`` is unique in its trace.
    """
    from tracemill.session import cut

    now = first = _pointers(nodes) if pointers is None else pointers
    most = now.where("up is not null").groupBy("trace_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    passed = 1
    while passed <= most and now.where("up is not null").limit(1).count():
        above = now.select("trace_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = now.join(above, ["trace_id", "up"], "left")
        depth = F.when(F.col("up").isNull(), F.col("depth")).otherwise(F.col("depth") + F.col("more"))
        now = cut(joined.select("trace_id", "node", F.when(depth.isNotNull(), F.col("next")).alias("up"), depth.alias("depth")), "depths", None if now is first else now)
        passed *= 2
    return now.select("trace_id", "node", F.when(F.col("up").isNull(), F.col("depth")).cast("int").alias("depth"))


def _within_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each entry (rows of ``kind`` 1) the nodes (``kind`` 0) up to the chunk's end of the way."""
    for batch, begin in _chunks(batches):
        kind = np.asarray(batch.column(2))
        chunk = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(kind)]))
        nodes, entries = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(nodes) or not len(entries):
            continue
        node, has = np.asarray(batch.column(3)).astype(np.int64), np.asarray(batch.column(4).is_valid())
        other = np.asarray(batch.column(4).fill_null(-1)).astype(np.int64)  # a node's parent, an entry's leaf
        starts = np.flatnonzero(np.r_[True, chunk[nodes][1:] != chunk[nodes][:-1]])
        at = np.where(has[nodes], _parents(node[nodes], other[nodes], starts), -1)
        span = 1 + int(np.abs(node).max())
        key, want = chunk[nodes] * 2 * span + node[nodes], chunk[entries] * 2 * span + node[entries]
        now = np.minimum(np.searchsorted(key, want), len(key) - 1)
        alive = key[now] == want
        now, own = now[alive], entries[alive]
        found = []
        while len(now) and len(found) <= CHUNK:
            found.append((own, now))
            now = at[now]
            own, now = own[now >= 0], now[now >= 0]
        rows, of = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(other[rows].astype(np.int32)), pa.array(node[nodes][of].astype(np.int32))], ["trace_id", "leaf", "node"])


def ways(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """The way from a root to each of ``leaves`` (``trace_id, node``): ``trace_id, leaf, node, place`` (from 0).

    A row per node on the way, none for a leaf that never gets to a root. The chunks
    that a way passes are found by pointer jumping, the nodes within them in one pass.
    """
    from tracemill.session import cut

    pointers = _pointers(nodes)
    depth = cut(depths(nodes, pointers).where("depth is not null"), "depths")
    leaves = leaves.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("node").cast("int").alias("node")).distinct()
    have = cut(leaves.join(depth, ["trace_id", "node"], "left_semi").select("trace_id", F.col("node").alias("leaf"), "node"), "entries")
    jump = first = pointers.select("trace_id", "node", "up")
    while jump.where("up is not null").limit(1).count():
        more = have.join(jump.where("up is not null"), ["trace_id", "node"]).select("trace_id", "leaf", F.col("up").alias("node"))
        if not more.limit(1).count():
            break
        have = cut(have.unionByName(more), "entries", have)
        twice = jump.select("trace_id", F.col("node").alias("up"), F.col("up").alias("next"))
        jump = cut(jump.where("up is not null").join(twice, ["trace_id", "up"]).select("trace_id", "node", F.col("next").alias("up")), "jumps", None if jump is first else jump)
    rows = nodes.select(F.col("trace_id").cast("string").alias("trace_id"), F.lit(0).alias("kind"), F.col("node").cast("int").alias("node"), F.col("parent").cast("int").alias("other")).where("trace_id is not null and node is not null")
    rows = rows.unionByName(have.select("trace_id", F.lit(1).alias("kind"), "node", F.col("leaf").alias("other")))
    passed = _chunked(rows, "kind").select("trace_id", "chunk", "kind", "node", "other").mapInArrow(_within_chunks, "trace_id string, leaf int, node int")
    return passed.join(depth, ["trace_id", "node"]).select("trace_id", "leaf", "node", (F.col("depth") - 1).alias("place"))


def chains(nodes: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """The way to each of ``leaves`` (all nodes without them) as an array ``chain``, root first; null if it never gets there.

    An array for every node is as much as the squares of ways: ask for the leaves that are needed.
    """
    asked = (nodes if leaves is None else leaves).select(F.col("trace_id").cast("string").alias("trace_id"), F.col("node").cast("int").alias("node")).distinct()
    found = ways(nodes, asked).groupBy("trace_id", F.col("leaf").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("chain"))
    return asked.join(found, ["trace_id", "node"], "left")


def off_chain(chain: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets ``trace_id, node`` that don't lie on their trace's chain ``trace_id, chain``: branches."""
    on = chain.select("trace_id", F.explode("chain").alias("node"))
    return targets.join(on, ["trace_id", "node"], "left_anti")


def failed_result(role: Column, content: Column) -> Column:
    """A tool's message that reports a failure: ok false, a return code, or a failed status."""
    value = J.parse_one(content)
    no = (J.kind(J.at(value, "$.ok")) == "boolean") & ~J.at(value, "$.ok").cast("boolean")
    code = (J.kind(J.at(value, "$.returncode")) == "integer") & (J.at(value, "$.returncode").cast("bigint") != 0)
    status = J.text(J.at(value, "$.status")).isin("failed", "error")
    return (role == "tool") & F.coalesce(J.kind(value) == "object", F.lit(False)) & (F.coalesce(no, F.lit(False)) | F.coalesce(code, F.lit(False)) | F.coalesce(status, F.lit(False)))


def histogram(df: DataFrame, kinds: str) -> DataFrame:
    """In how many rows each kind of an array column stands, copies within a row once."""
    return df.select(F.explode(F.array_distinct(kinds)).alias("kind")).groupBy("kind").agg(F.count("*").alias("samples"))


def over_budget(df: DataFrame, entity: list[str], order: list[str], tokens: str, budget: Column) -> DataFrame:
    """Add ``spent`` so far, ``stopped`` (the budget was reached before this row) and ``over`` (it is exceeded)."""
    w = Window.partitionBy(*entity).orderBy(*order)
    upto = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumns({"spent": upto, "stopped": before >= budget, "over": upto > budget})
