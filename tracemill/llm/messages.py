"""Message rows of agent traces: what the operators on conversations and events share.

Rows are read once in Arrow batches: roles and flags are computed, JSON is
parsed, long contents stay behind. They are then shuffled by trace and range of
``CHUNK`` nodes, so that no task gathers a trace, however long, and sorted there;
of the deliveries of a node only the last counts.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.tables import spelled

#: Nodes of a trace that are handled together.
CHUNK = 256
ROLES = ("system", "user", "assistant", "tool")
#: Top-level arguments that don't tell calls apart. Fixed values.
ASIDE = frozenset(("attempt", "nonce", "timeout_ms"))

FLAT = (
    "trace_id string, node int, parent int, msg_id bigint, recorded_at bigint, received_at bigint, role tinyint,"
    " blank boolean, n_calls int, call_ids array<bigint>, answers bigint, signature bigint, names bigint, bits bigint"
)
NO_ANSWER = 0


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _constant(name: str):
    raise ValueError(name)


def parse_json(text: str):
    """The value of a JSON text; raises ValueError, also for NaN and infinities."""
    try:
        return json.loads(text, parse_constant=_constant)
    except RecursionError as e:
        raise ValueError("too deep") from e


def is_blank(content: str | None) -> bool:
    """Null, only white space, or a JSON array without a text that isn't."""
    if content is None or not content.strip():
        return True
    if not content.lstrip().startswith("["):
        return False
    try:
        value = parse_json(content)
    except ValueError:
        return False
    return isinstance(value, list) and not any(isinstance(x, dict) and isinstance(x.get("text"), str) and x["text"].strip() for x in value)


def read_calls(text: str | None) -> list[tuple[str, str, dict]] | None:
    """``(id, name, arguments)`` of each call; None if the text isn't readable."""
    if text is None:
        return []
    try:
        value = parse_json(text)
    except ValueError:
        return None
    if value is None:
        return []
    if not isinstance(value, list):
        return None
    out = []
    for call in value:
        if not isinstance(call, dict):
            return None
        inner = call["function"] if isinstance(call.get("function"), dict) else call
        arguments = inner.get("arguments")
        if isinstance(arguments, str):
            try:
                arguments = parse_json(arguments)
            except ValueError:
                return None
        named = all(isinstance(x, str) and x.strip() for x in (call.get("id"), inner.get("name")))
        if not named or not isinstance(arguments, dict):
            return None
        out.append((call["id"], inner["name"], arguments))
    return out


def _plain(value):
    """Numbers by value: an integral float is the integer."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def plain_arguments(arguments: dict) -> dict:
    """Arguments as they count for equality."""
    out = {k: _plain(v) for k, v in arguments.items() if k not in ASIDE}
    if isinstance(out.get("path"), str):
        path = posixpath.normpath(out["path"].strip())
        out["path"] = "/" + path.lstrip("/") if path.startswith("/") else path
    if isinstance(out.get("command"), str):
        out["command"] = out["command"].split()
    return out


def _simhash(text: str) -> int:
    """64 sign bits over the hashed four-byte pieces of a text; close texts have close bits."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").ljust(4), np.uint8).astype(np.uint64)
    piece = raw[:-3] | raw[1:-2] << np.uint64(8) | raw[2:-1] << np.uint64(16) | raw[3:] << np.uint64(24)
    h = (piece + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int(np.packbits(ones * 2 > len(h)).view(np.int64)[0])


def counting(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of sorted rows the last of each trace and node."""
    n = batch.num_rows
    if n < 2:
        return batch
    trace, node = batch.column(batch.schema.get_field_index("trace_id")), batch.column(batch.schema.get_field_index("node"))
    node = np.asarray(pc.fill_null(node, -1))
    other = np.asarray(pc.not_equal(trace.slice(1), trace.slice(0, n - 1))) | (node[1:] != node[:-1])
    return batch if other.all() else batch.filter(pa.array(np.r_[other, True]))


def _read(signed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a first choice among the deliveries of a node, before anything is shuffled
            by = pc.sort_indices(batch, [(c, "ascending") for c in ("trace_id", "node", "received_at", "msg_id")], null_placement="at_start")
            batch = counting(batch.take(by))
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            roles = at["role"].to_pylist()
            blank = [is_blank(c) for c in at["content"].to_pylist()]
            n_calls, ids, sigs, names, bits = [], [], [], [], []
            for text, role in zip(at["tool_calls"].to_pylist(), roles):
                calls = () if text is None or text == "[]" else read_calls(text)
                if calls is None:
                    n_calls.append(-1)
                    ids.append(())
                else:
                    n_calls.append(len(calls))
                    ids.append([hash64(c[0]) for c in calls])
                if signed and calls and role == 2:
                    plain = [(name, plain_arguments(a)) for _, name, a in calls]
                    sigs.append(hash64(json.dumps(plain, sort_keys=True)))
                    names.append(hash64(json.dumps([name for name, _ in plain])))
                    bits.append(_simhash(json.dumps([a for _, a in plain], sort_keys=True)))
                else:
                    for out in (sigs, names, bits):
                        out.append(0)
            answers = [NO_ANSWER if a is None or role != 3 else hash64(a.strip()) for a, role in zip(at["tool_call_id"].to_pylist(), roles)]
            yield pa.RecordBatch.from_arrays(
                [at["trace_id"], at["node"], at["parent"], at["msg_id"], at["recorded_at"], at["received_at"], pa.array(roles, pa.int8())]
                + [pa.array(blank), pa.array(n_calls, pa.int32()), pa.array(ids, pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in (answers, sigs, names, bits))],
                [x.split()[0] for x in FLAT.split(", ")],
            )

    return run


def flat_messages(messages: DataFrame, spellings: DataFrame, signed: bool = False) -> DataFrame:
    """Rows with a trace id, roles and calls read, sorted by trace and node within partitions of whole chunks.

    Times are microseconds. ``role`` is the place in ROLES, -1 for one that isn't
    known; ``n_calls`` is -1 for calls that can't be read; ids are hashes.
    """
    rows = spelled(messages.where("trace_id is not null"), "role", spellings, "role", "__means")
    role = F.expr("CASE __means " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(ROLES)) + " ELSE -1 END").cast("tinyint")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    # a content that begins with a letter or digit is neither blank nor an array: a letter stands for it
    content = F.when(F.substring("content", 1, 1).rlike("^[A-Za-z0-9]"), F.lit("x")).otherwise(F.col("content"))
    picked = rows.select(
        F.col("trace_id").cast("string"), F.col("node").cast("int"), F.col("parent").cast("int"), F.col("msg_id").cast("bigint"),
        role.alias("role"), content.alias("content"), "tool_calls", "tool_call_id",
        micros("recorded_at").alias("recorded_at"), F.coalesce(micros("received_at"), F.lit(-(1 << 62))).alias("received_at"),
    )
    return (
        picked.mapInArrow(_read(signed), FLAT)
        .repartition("trace_id", F.expr(f"floor(node / {CHUNK})"))
        .sortWithinPartitions("trace_id", "node", "received_at", "msg_id")
    )


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counting rows of sorted batches, cut only between chunks.

    What is held back between two batches is one chunk, ``CHUNK`` rows at most.
    """
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        whole = counting(whole)
        edges = chunk_edges(whole)
        rest = whole.slice(edges[-2])
        if edges[-2]:
            yield whole.slice(0, edges[-2])
    if rest is not None:
        yield rest


def chunk_edges(batch: pa.RecordBatch) -> np.ndarray:
    """Where chunks begin, and the number of rows."""
    n = batch.num_rows
    trace = batch.column(batch.schema.get_field_index("trace_id"))
    chunk = np.asarray(pc.fill_null(batch.column(batch.schema.get_field_index("node")), -CHUNK)).astype(np.int64) // CHUNK
    other = np.asarray(pc.not_equal(trace.slice(1), trace.slice(0, n - 1))) | (chunk[1:] != chunk[:-1]) if n > 1 else np.zeros(0, bool)
    return np.r_[0, np.flatnonzero(other) + 1, n]
