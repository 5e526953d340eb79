"""Runs of repeated consecutive events, by optimal segmentation.

An ordered sequence of events is cut into runs so that the dissimilarity within
runs plus a penalty for each boundary is smallest. Events are 64-bit feature
vectors; the dissimilarity of a run is the share of bits that differ from its
majority vector, summed over its events. Cutting a run never makes that dearer,
so the dynamic program forgets a start as soon as it can't win (pruning), and
the result stays optimal. Events of other names never share a run, which parts
the problem. Unless boundaries are paid for no optimum parts equal neighbours, so
the program steps over them as one event of their joint weight.

Pieces of a stretch of equal names within one chunk of a trace are segmented
where they are. Only stretches at the ends of chunks are shuffled, to be put
together, so a trace of any length is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.messages import CHUNK, chunk_edges, chunks, flat_messages
from tracemill.session import cut

PIECES = (
    "trace_id string, chunk bigint, place int, open boolean, first_node int, last_node int, n_turns int, first_at bigint, last_at bigint,"
    " signature bigint, names bigint, bits bigint, head boolean, run_last_node int, run_turns int, run_last_at bigint,"
    " same_head boolean, same_last_node int, same_turns int, same_last_at bigint"
)
_NAMES, _KINDS = zip(*(x.split() for x in PIECES.split(", ")))
_BASE = list(_NAMES[:12])  # what a piece has before it is segmented
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
#: Stands for a missing time within this module.
NO_TIME = np.iinfo(np.int64).min
#: A stretch of more pieces is handled as it comes, up to where all ways to go on agree.
STRETCH = 20_000
#: What a boundary costs, as the share of differing bits summed over a run.
PENALTY = 0.15


def segment(bits: np.ndarray, weights: np.ndarray, penalty: float) -> tuple[list[int], int]:
    """Starts of the runs of the cheapest segmentation of weighted 64-bit vectors, and where it is settled.

    Of equally cheap ones the one whose last run is longest is taken. Whatever
    follows, an optimal segmentation has a boundary at the settled place and the
    same ones before it.
    """
    n = len(bits)
    ones = np.unpackbits(np.ascontiguousarray(bits, dtype=np.int64).view(np.uint8).reshape(n, 8), axis=1).astype(np.float64) * weights[:, None]
    sums = np.vstack([np.zeros(64), np.cumsum(ones, axis=0)])
    total = np.r_[0.0, np.cumsum(weights)]
    best, back = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    starts = np.array([0])
    for t in range(1, n + 1):
        high = sums[t] - sums[starts]
        cost = np.minimum(high, (total[t] - total[starts])[:, None] - high).sum(axis=1) / 64
        value = best[starts] + cost + penalty
        k = int(np.argmin(np.round(value, 9)))
        best[t], back[t] = value[k], starts[k]
        starts = np.r_[starts[best[starts] + cost <= best[t] + 1e-9], t]

    def way(t: int) -> list[int]:
        out = [t]
        while t > 0:
            t = int(back[t])
            out.append(t)
        return out[::-1]

    agreed = set(way(int(starts[0])))
    for s in starts[1:].tolist():
        agreed &= set(way(s))
    return way(n)[:-1], max(agreed)


def _runs_of(names: np.ndarray, fresh: np.ndarray, bits: np.ndarray, weights: np.ndarray, penalty: float) -> np.ndarray:
    """Whether a piece begins a run; ``fresh`` marks pieces that can't go on with the one before."""
    n = len(names)
    new = fresh.copy()
    new[1:] |= names[1:] != names[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, n])
    head = new.copy()
    two = begin[size == 2]  # the program for two pieces, for all of them at once
    cost = np.bitwise_count((bits[two] ^ bits[two + 1]).view(np.uint64)) * np.minimum(weights[two], weights[two + 1]) / 64
    head[two + 1] = np.round(cost, 9) > np.round(penalty, 9)
    for b, k in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        head[b + np.array(segment(bits[b : b + k], weights[b : b + k], penalty)[0])] = True
    return head


def _spans(prefix: str, columns: dict[str, np.ndarray], head: np.ndarray) -> dict[str, np.ndarray]:
    """Of the span that begins at a head, its last node, turns and last time, at each of its pieces."""
    start = np.flatnonzero(head)
    of = np.cumsum(head) - 1
    stop = np.r_[start[1:], len(head)] - 1
    turns = np.add.reduceat(columns["n_turns"], start) if len(start) else start
    return {f"{prefix}_last_node": columns["last_node"][stop][of], f"{prefix}_turns": turns[of], f"{prefix}_last_at": columns["last_at"][stop][of]}


def _labelled(columns: dict[str, np.ndarray], head: np.ndarray) -> dict[str, np.ndarray]:
    """The columns with each piece's run, and with the stretch of equal events of that run it lies in."""
    same = head.copy()
    same[1:] |= columns["signature"][1:] != columns["signature"][:-1]
    return columns | {"head": head, "same_head": same} | _spans("run", columns, head) | _spans("same", columns, same)


def _batch(trace: pa.Array, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    def column(name: str, kind: str) -> pa.Array:
        values = columns[name]
        return pa.array(values.astype(bool) if kind == "boolean" else values, _ARROW[kind], mask=values == NO_TIME if name.endswith("_at") else None)

    return pa.RecordBatch.from_arrays([trace, *map(column, _NAMES[1:], _KINDS[1:])], _NAMES)


def _within_chunks(penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            edges = chunk_edges(batch)
            seg = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            turn = np.flatnonzero((np.asarray(at["role"]) == 2) & (np.asarray(at["n_calls"]) > 0) & np.asarray(at["node"].is_valid()))
            if not len(turn):
                continue
            seg, sig = seg[turn], np.asarray(at["signature"])[turn]
            start = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (sig[1:] != sig[:-1]) | (penalty < 0)])
            stop = np.r_[start[1:], len(turn)] - 1
            pseg = seg[start]
            first = np.r_[True, pseg[1:] != pseg[:-1]]
            a, b = turn[start], turn[stop]
            node = np.asarray(at["node"].fill_null(-1)).astype(np.int64)
            time = np.asarray(at["recorded_at"].fill_null(NO_TIME)).astype(np.int64)
            names = np.asarray(at["names"])[a]
            c = {"chunk": node[a] // CHUNK, "first_node": node[a], "last_node": node[b], "n_turns": stop - start + 1, "first_at": time[a], "last_at": time[b], "signature": sig[start], "names": names, "bits": np.asarray(at["bits"])[a]}
            lead = np.flatnonzero(first)
            c["place"] = np.arange(len(start)) - np.repeat(lead, np.diff(np.r_[lead, len(start)]))
            # stretches of equal names that another chunk may go on with: a chunk's last, and its first but in the first chunk
            stretch = np.cumsum(first | np.r_[True, names[1:] != names[:-1]]) - 1
            last = np.r_[first[1:], True]
            ends = np.zeros(stretch[-1] + 1, bool)
            ends[stretch[last]] = True
            ends[stretch[first & (c["chunk"] != 0)]] = True
            c["open"] = ends[stretch]
            head = _runs_of(names, first, c["bits"], c["n_turns"].astype(np.float64), penalty)
            yield _batch(at["trace_id"].take(pa.array(a)), _labelled(c, head))

    return run


def _across_chunks(penalty: float):
    """Open stretches of sorted traces: equal neighbours joined over the ends of chunks, then segmented."""

    def pieces(rows: pa.Table) -> tuple[pa.Array, dict[str, np.ndarray], np.ndarray]:
        trace = rows["trace_id"].combine_chunks()
        c = {name: np.asarray(rows[name].fill_null(NO_TIME) if name.endswith("_at") else rows[name]).astype(np.int64) for name in _BASE[1:]}
        n = len(c["chunk"])
        same_chunk = c["chunk"][1:] == c["chunk"][:-1]
        apart = np.asarray(pc.not_equal(trace.slice(1), trace.slice(0, n - 1))) | (same_chunk & (c["place"][1:] != c["place"][:-1] + 1))
        new = np.r_[True, apart | (c["signature"][1:] != c["signature"][:-1]) | (penalty < 0)]
        start = np.flatnonzero(new)
        stop = np.r_[start[1:], n] - 1
        out = {k: v[start] for k, v in c.items()}
        out["n_turns"] = np.add.reduceat(c["n_turns"], start)
        out["last_node"], out["last_at"] = c["last_node"][stop], c["last_at"][stop]
        # a joined piece goes on where its last part ends
        out["place_end"], out["chunk_end"] = c["place"][stop], c["chunk"][stop]
        return trace.take(pa.array(start)), out, np.r_[True, apart][start]

    def table(trace: pa.Array, c: dict[str, np.ndarray], rows: slice, like: pa.Schema) -> pa.Table:
        keep = c | {"place": c["place_end"], "chunk": c["chunk_end"]}
        return pa.Table.from_arrays([trace[rows], *(pa.array(keep[f.name][rows]).cast(f.type) for f in like if f.name != "trace_id")], schema=like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select(_BASE)
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            trace, c, fresh = pieces(rows)
            n = len(fresh)
            begins = np.flatnonzero(fresh | np.r_[True, c["names"][1:] != c["names"][:-1]])
            done = int(begins[-1])  # the last stretch may go on
            if done:
                yield finish(trace.slice(0, done), c, slice(0, done), fresh[:done])
            if n - done > STRETCH:  # of it, what is settled; the last piece may still grow
                _, settled = segment(c["bits"][done : n - 1], c["n_turns"][done : n - 1].astype(np.float64), penalty)
                if settled:
                    yield finish(trace.slice(done, settled), c, slice(done, done + settled), fresh[done : done + settled])
                    done += settled
            rest = table(trace, c, slice(done, n), rows.schema)
        if rest is not None and rest.num_rows:
            trace, c, fresh = pieces(rest)
            yield finish(trace, c, slice(0, len(fresh)), fresh)

    def finish(trace: pa.Array, c: dict[str, np.ndarray], rows: slice, fresh: np.ndarray) -> pa.RecordBatch:
        part = {k: v[rows] for k, v in c.items()}
        fresh = fresh.copy()
        fresh[0] = True
        head = _runs_of(part["names"], fresh, part["bits"], part["n_turns"].astype(np.float64), penalty)
        return _batch(trace, _labelled(part, head))

    return run


def segmented_turns(messages: DataFrame, spellings: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """The events of all traces, equal neighbours as one piece of ``n_turns``, each with its run.

    A piece has ``trace_id, first_node, last_node, n_turns, first_at, last_at``
    (recorded, microseconds). ``head`` marks the first piece of a run of the
    segmentation, ``same_head`` the first of a stretch of equal events (as
    TESTDATA.md defines them) within a run; ``run_last_node, run_turns, run_last_at``
    and ``same_last_node, same_turns, same_last_at`` tell how far each goes. With a negative penalty
    nothing is joined and each event is a run. Rows without a trace id
    or node, of other roles, or without readable calls are no events; a missing
    time is null; equal deliveries count once.
    """
    pieces = cut(flat_messages(messages, spellings, signed=True).mapInArrow(_within_chunks(penalty), PIECES), "pieces")
    ends = pieces.where("open").select(_BASE).repartition("trace_id").sortWithinPartitions("trace_id", "chunk", "place")
    return pieces.where("not open").unionByName(ends.mapInArrow(_across_chunks(penalty), PIECES)).drop("chunk", "place", "open", "signature", "names", "bits")


def _found(pieces: DataFrame, of: str) -> DataFrame:
    seconds = ((F.col(f"{of}_last_at") - F.col("first_at")) / 1e6).alias("duration_s")
    return pieces.select("trace_id", "first_node", F.col(f"{of}_last_node").alias("last_node"), F.col(f"{of}_turns").alias("n_turns"), seconds)


def near_repeated_turns(messages: DataFrame, spellings: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """All runs of near-identical turns, single turns included: ``trace_id, first_node, last_node, n_turns, duration_s``.

    The duration lies between the recorded times of the first and the last turn;
    it is null if one of them is missing.
    """
    return _found(segmented_turns(messages, spellings, penalty).where("head"), "run")


def repeated_turns(messages: DataFrame, spellings: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Longest runs of two or more equal turns, columns as of :func:`near_repeated_turns`.

    The runs of the segmentation, each split where neighbours aren't equal. As no
    optimum parts equal neighbours, no longest run of equal turns is cut by a run's end.
    """
    return _found(segmented_turns(messages, spellings, penalty).where("same_head and same_turns > 1"), "same")
