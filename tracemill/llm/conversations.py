"""Conversations rebuilt from scattered message rows.

Constraints say what came before what: a message directly before its reply, the
nodes of a trace one after the other, a call before its result. They are
difference constraints on the places of turns; a trace whose constraints can't
all hold is rejected, as is one that breaks a rule of sound traces (roles, calls,
replies, an end).

Senders (roles) have clocks of their own; their offsets are estimated per trace by
least squares over the reply-before constraints that the recorded times break,
with a small ridge that keeps the others in place. Times are corrected by the
offsets, a reply is never earlier than what it replies to, and the turns of the
senders are merged by corrected time, equal ones in the order of replies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.wordhash import list_parts
from tracemill.llm.messages import CHUNK, NO_ANSWER, ROLES, chunk_edges, chunks, flat_messages
from tracemill.session import cut

N = len(ROLES)
_UPPER = [(a, b) for a in range(N) for b in range(a, N)]
_SUMS = [f"m{a}{b}" for a, b in _UPPER] + [f"r{a}" for a in range(N)]
CHUNKS = (
    "trace_id string, chunk bigint, n int, first_node int, last_node int, good boolean, asked boolean, ended boolean, opens tinyint, closes tinyint,"
    " msg_ids array<bigint>, times array<bigint>, roles array<bigint>, left_ids array<bigint>, left_nodes array<bigint>, left_signs array<bigint>, "
    + ", ".join([*(f"{c} double" for c in _SUMS), *(f"latest{a} bigint" for a in range(N))])
)
TURNS = "trace_id string, pos int, msg_id bigint, role tinyint, corrected_at bigint, clock_offset_s double"
#: Weight of the ridge against one broken constraint.
RIDGE = 0.05
#: Before all times: stands for a missing one.
NEVER = -(1 << 62)


def feasible(node: np.ndarray, parent: np.ndarray, has_parent: np.ndarray) -> np.ndarray:
    """Whether the reply and sequence constraints of each turn can hold.

    They ask of places p that p(0) = 0, p(k + 1) = p(k) + 1, and p = p(parent) + 1 for
    a reply; a root has no parent. The first two leave a single solution, p(k) = k, so the
    system has one if and only if it meets each of the others. A node that is missing leaves
    a sequence constraint without an end; that shows in the number of turns of the trace.
    """
    return np.where(node > 0, has_parent & (parent == node - 1), ~has_parent & (node == 0))


def merged_order(corrected: np.ndarray, role: np.ndarray, bounds: np.ndarray, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, times)`` of the turns between bounds, given in the order of replies.

    A turn's time is its corrected one, or that of what it replies to if that is later;
    ``since`` is the latest time before each part. The turns of each sender come in order
    of these times; the senders are merged by them, of equal times in the order of replies.
    """
    size = np.diff(bounds)
    part, place = np.repeat(np.arange(len(size)), size), np.arange(len(corrected)) - np.repeat(bounds[:-1], size)
    times = np.maximum(corrected, np.repeat(since, size))
    ladder = np.unique(times)  # a running maximum within parts, by ranks that rise from part to part
    rank = part << 32 | np.searchsorted(ladder, times)
    times = ladder[np.maximum.accumulate(rank) & 0xFFFFFFFF] if len(rank) else times
    by_sender = np.lexsort((place, times, role, part))
    merge = np.lexsort((place[by_sender], times[by_sender], part[by_sender]))
    return by_sender[merge], times


def _unmatched(seg: np.ndarray, ids: np.ndarray, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Places of calls (1) and results (-1) that find no partner within their chunk and id."""
    order = np.lexsort((node, ids, seg))
    seg, ids, sign = seg[order], ids[order], sign[order]
    n = len(seg)
    if not n:
        return order
    new = np.r_[True, (seg[1:] != seg[:-1]) | (ids[1:] != ids[:-1])]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, n])
    plain = (size == 2) & (sign[start] == 1) & (sign[np.minimum(start + 1, n - 1)] == -1) & (ids[start] != NO_ANSWER)
    out = []
    for s, k in zip(start[~plain].tolist(), size[~plain].tolist()):
        calls = []
        for i in range(s, s + k):
            if sign[i] == 1:
                calls.append(i)
            elif calls and ids[i] != NO_ANSWER:
                calls.pop()
            else:
                out.append(i)
        out += calls
    return order[np.array(sorted(out), np.int64)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        edges = chunk_edges(batch)
        begin, size = edges[:-1], np.diff(edges)
        seg = np.repeat(np.arange(len(begin)), size)
        node = np.asarray(at["node"].fill_null(-1)).astype(np.int64)
        parent = np.asarray(at["parent"].fill_null(-1)).astype(np.int64)
        role, blank, calls = np.asarray(at["role"]).astype(np.int64), np.asarray(at["blank"]), np.asarray(at["n_calls"])
        time = np.asarray(at["recorded_at"].fill_null(NEVER)).astype(np.int64)
        has_parent, has_time = np.asarray(at["parent"].is_valid()), np.asarray(at["recorded_at"].is_valid())
        good = feasible(node, parent, has_parent) & (role >= 0) & (calls >= 0)
        user, answering = role == 1, (role == 2) & ((calls > 0) | ~blank)
        # users without an assistant between them
        turn = np.flatnonzero(user | answering)
        tseg, tuser = seg[turn], user[turn]
        twice = np.zeros(len(begin), bool)
        if len(turn):
            twice[tseg[1:][(tseg[1:] == tseg[:-1]) & tuser[1:] & tuser[:-1]]] = True
        opens, closes = np.zeros(len(begin), np.int8), np.zeros(len(begin), np.int8)
        opens[tseg[::-1]] = np.where(tuser, 1, 2)[::-1]
        closes[tseg] = np.where(tuser, 1, 2)
        end = edges[1:] - 1
        ended = (role[end] == 2) & (calls[end] == 0) & ~blank[end]
        # calls and results
        ids, at_ids = list_parts(at["call_ids"])
        row = np.repeat(np.arange(batch.num_rows), np.diff(at_ids))
        tools = np.flatnonzero(role == 3)
        all_ids = np.concatenate([ids.view(np.int64), np.asarray(at["answers"])[tools]])
        all_rows = np.concatenate([row, tools])
        sign = np.concatenate([np.ones(len(row), np.int64), -np.ones(len(tools), np.int64)])
        left = _unmatched(seg[all_rows], all_ids, node[all_rows], sign)
        left = left[np.argsort(seg[all_rows[left]], kind="stable")]
        left_edges = np.searchsorted(seg[all_rows[left]], np.arange(len(begin) + 1))
        # reply-before constraints that the clocks break
        reply = np.flatnonzero((seg[1:] == seg[:-1]) & (node[1:] == node[:-1] + 1) & has_time[1:] & has_time[:-1] & (role[1:] >= 0) & (role[:-1] >= 0))
        late = (time[reply] - time[reply + 1]) / 1e6
        broken = (late > 0) & (role[reply] != role[reply + 1])
        p, c, late, s = role[reply][broken], role[reply + 1][broken], late[broken], seg[reply][broken]
        m, r = np.zeros((len(begin), N, N)), np.zeros((len(begin), N))
        for a, b, w in ((p, p, 1.0), (c, c, 1.0), (p, c, -1.0), (c, p, -1.0)):
            np.add.at(m, (s, a, b), w)
        np.add.at(r, (s, c), late)
        np.add.at(r, (s, p), -late)
        latest = np.full((len(begin), N), NEVER)
        known = np.flatnonzero(role >= 0)
        np.maximum.at(latest, (seg[known], role[known]), time[known])
        offsets = pa.array(edges, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (np.asarray(at["msg_id"].fill_null(-1)), time, role)]
        lefts = [pa.ListArray.from_arrays(pa.array(left_edges, pa.int32()), pa.array(x)) for x in (all_ids[left], node[all_rows[left]], sign[left])]
        yield pa.RecordBatch.from_arrays(
            [at["trace_id"].take(pa.array(begin)), pa.array(node[begin] // CHUNK), pa.array(size.astype(np.int32)), pa.array(node[begin].astype(np.int32)), pa.array(node[end].astype(np.int32))]
            + [pa.array(np.logical_and.reduceat(good, begin) & ~twice), pa.array(np.logical_or.reduceat(user & ~blank, begin)), pa.array(ended), pa.array(opens), pa.array(closes)]
            + lists
            + lefts
            + [pa.array(m[:, a, b]) for a, b in _UPPER]
            + [pa.array(r[:, a]) for a in range(N)]
            + [pa.array(latest[:, a]) for a in range(N)],
            [x.split()[0] for x in CHUNKS.split(", ")],
        )


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The offset of each sender's clock in microseconds, by least squares per trace."""
    for batch in batches:
        at = {name: np.asarray(batch.column(i)) for i, name in enumerate(batch.schema.names) if i}
        m, r = np.zeros((batch.num_rows, N, N)), np.zeros((batch.num_rows, N))
        for a, b in _UPPER:
            m[:, a, b] = m[:, b, a] = at[f"m{a}{b}"]
        for a in range(N):
            r[:, a] = at[f"r{a}"]
        found = np.round(np.linalg.solve(m + RIDGE * np.eye(N), r[:, :, None])[:, :, 0] * 1e6).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, a]) for a in range(N))], ["trace_id", *(f"offset{a}" for a in range(N))])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of sound traces: those of each sender in order of corrected time, merged."""
    for batch in batches:
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        offset = np.stack([np.asarray(at[f"offset{a}"]) for a in range(N)], axis=1)
        ids, edges = list_parts(at["msg_ids"])
        times, role = list_parts(at["times"])[0].view(np.int64), list_parts(at["roles"])[0].view(np.int64)
        seg = np.repeat(np.arange(batch.num_rows), np.diff(edges))
        corrected = np.where(times == NEVER, NEVER, times + offset[seg, role])
        order, held = merged_order(corrected, role, edges, np.asarray(at["since"]))
        pos = np.asarray(at["base"])[seg] + np.arange(len(seg)) - edges[:-1][seg]
        of = seg[order]
        yield pa.RecordBatch.from_arrays(
            [at["trace_id"].take(pa.array(of)), pa.array(pos.astype(np.int32)), pa.array(ids.view(np.int64)[order]), pa.array(role[order].astype(np.int8))]
            + [pa.array(held[order], mask=held[order] == NEVER), pa.array(offset[of, role[order]] / 1e6)],
            [x.split()[0] for x in TURNS.split(", ")],
        )


def rebuild_conversations(messages: DataFrame, spellings: DataFrame) -> DataFrame:
    """The counting rows of sound traces, as TESTDATA.md defines both, in order.

    ``trace_id, pos, msg_id, role, corrected_at`` (microseconds, never less than that of
    the turn before), ``clock_offset_s``. ``pos`` is a turn's place in the merge.
    Rows without a trace id are ignored, a row without a node makes its trace
    unsound, a null ``received_at`` is the earliest, a missing ``recorded_at`` takes no
    part in the estimate and the time of the turn before (null if there is none). Equal
    deliveries count once. No trace is gathered in one task: chunks of it are
    summed up, only the sums meet, and each chunk is merged for itself after
    what came before it.
    """
    parts = cut(flat_messages(messages, spellings).mapInArrow(_summaries, CHUNKS), "chunks")
    inorder = Window.partitionBy("trace_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    flags = ("good", "asked", "ended", "opens", "closes")
    narrow = parts.select("trace_id", "chunk", "n", "first_node", "last_node", *flags, *_SUMS, *(f"latest{a}" for a in range(N))).withColumns(
        {"before": F.last(F.nullif("closes", F.lit(0).cast("tinyint")), True).over(inorder), "base": F.coalesce(F.sum("n").over(inorder), F.lit(0))}
        | {f"earlier{a}": F.max(f"latest{a}").over(inorder) for a in range(N)}
    )
    twice = F.coalesce((F.col("opens") == 1) & (F.col("before") == 1), F.lit(False))
    verdict = (
        narrow.groupBy("trace_id")
        .agg(
            (F.bool_and(F.col("good") & ~twice) & F.bool_or("asked") & F.max_by("ended", "chunk")
             & (F.sum("n") == F.max("last_node") + 1) & (F.min("first_node") == 0)).alias("sound"),
            *(F.sum(c).alias(c) for c in _SUMS),
        )
        .where("sound")
    )
    left = parts.where("size(left_ids) > 0").select("trace_id", F.explode(F.arrays_zip("left_ids", "left_nodes", "left_signs")).alias("x"))
    left = left.select("trace_id", F.col("x.left_ids").alias("id"), F.col("x.left_nodes").alias("node"), F.col("x.left_signs").alias("sign"))
    running = F.sum("sign").over(Window.partitionBy("trace_id", "id").orderBy("node", F.desc("sign")))
    broken = (
        left.withColumn("open", running)
        .groupBy("trace_id", "id")
        .agg(F.sum("sign").alias("total"), F.min("open").alias("least"))
        .where(f"total <> 0 or least < 0 or id = {NO_ANSWER}")
        .select("trace_id")
        .distinct()
    )
    sound = verdict.join(broken, "trace_id", "left_anti").select("trace_id", *_SUMS)
    clocks = sound.mapInArrow(_offsets, "trace_id string, " + ", ".join(f"offset{a} bigint" for a in range(N)))
    since = F.greatest(F.lit(NEVER), *(F.when(F.col(f"earlier{a}") > NEVER, F.col(f"earlier{a}") + F.col(f"offset{a}")) for a in range(N)))
    heads = narrow.select("trace_id", "chunk", "base", *(f"earlier{a}" for a in range(N))).join(clocks, "trace_id")
    heads = heads.select("trace_id", "chunk", F.col("base").cast("bigint"), since.alias("since"), *(f"offset{a}" for a in range(N)))
    turns = parts.select("trace_id", "chunk", "msg_ids", "times", "roles").join(heads, ["trace_id", "chunk"]).mapInArrow(_merged, TURNS)
    names = F.array(*(F.lit(r) for r in ROLES))
    return turns.withColumn("role", F.element_at(names, F.col("role").cast("int") + 1))
