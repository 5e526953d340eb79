"""Deeply nested JSON into linked flat rows, by vectorised structural indexing.

A batch of texts is one byte buffer. Bitmaps of quotes, brackets and delimiters
are built for all of it at once; prefix sums give what lies in strings and the
nesting depth; one sort by depth gives each value its parent and its place there.
The same passes check the JSON grammar, so a text is either indexed wholly or
marked as not being JSON. No Python object is made for a value that isn't asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.wordhash import slices, text_bytes

OPEN_OBJECT, OPEN_ARRAY, CLOSE_OBJECT, CLOSE_ARRAY, COLON, COMMA, STRING, SCALAR, KEY, START = range(10)
_CLASS = np.full(256, SCALAR, np.uint8)
for _i, _c in enumerate(b"{[}]:,"):
    _CLASS[_c] = _i
_CLASS[ord('"')] = STRING
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_LITERAL = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")

#: May a token follow another, by the container it is in (none, object, array).
_FOLLOWS = np.zeros((3, 10, 10), bool)
_VALUES, _ENDS = [OPEN_OBJECT, OPEN_ARRAY, STRING, SCALAR], [CLOSE_OBJECT, CLOSE_ARRAY, STRING, SCALAR]
_FOLLOWS[0, START, _VALUES] = True
_FOLLOWS[1, OPEN_OBJECT, [KEY, CLOSE_OBJECT]] = True
_FOLLOWS[1, COMMA, KEY] = True
_FOLLOWS[1, KEY, COLON] = True
_FOLLOWS[1, COLON, _VALUES] = True
_FOLLOWS[2, OPEN_ARRAY, [*_VALUES, CLOSE_ARRAY]] = True
_FOLLOWS[2, COMMA, _VALUES] = True
for _e in _ENDS:
    _FOLLOWS[1, _e, [COMMA, CLOSE_OBJECT]] = True
    _FOLLOWS[2, _e, [COMMA, CLOSE_ARRAY]] = True


class JsonIndex:
    """The values of a batch of JSON texts.

    ``valid[d]``: text d is one JSON value with only white space around it. For
    value v: ``doc``, ``kind`` (OPEN_OBJECT, OPEN_ARRAY, STRING or SCALAR),
    ``parent`` (a value, -1 at the top), ``place`` among its parent's values,
    ``key`` (bytes of its name in quotes, from ``key_start`` to ``key_end``; -1 in
    an array), ``start`` and ``end`` of its bytes. Of equal names of an object
    ``last`` marks the one that counts.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        self.raw, self.bounds, self.data = raw, bounds, raw.tobytes()
        docs = len(bounds) - 1
        bad = np.zeros(docs, bool)
        n = len(raw)
        # escapes: runs of backslashes, broken at text bounds; an odd run escapes what follows
        quote = raw == ord('"')
        slash = np.flatnonzero(raw == ord("\\"))
        if len(slash):
            new = np.r_[True, (np.diff(slash) != 1) | np.isin(slash[1:], bounds)]
            begin = slash[new]
            size = np.diff(np.r_[np.flatnonzero(new), len(slash)])
            after = (begin + size)[size % 2 == 1]
            own = self._doc_of(after - 1)
            inside = after < bounds[own + 1]
            bad[own[~inside]] = True
            after = after[inside]
            quote[after] = False
            bad[self._doc_of(after[~_ESCAPED[raw[after]]])] = True
            u = after[raw[after] == ord("u")]
            for i in range(1, 5):
                bad[self._doc_of(u[~_HEX[raw[np.minimum(u + i, n - 1)]]])] = True
        at = np.flatnonzero(quote)
        count = np.searchsorted(at, bounds)
        odd = np.diff(count) % 2 == 1
        bad |= odd
        # a text with an open string is left out whole, so that the others' quotes pair up
        at = at[~np.repeat(odd, np.diff(count))]
        opening, closing = at[::2], at[1::2]
        edge = np.zeros(n + 1, np.int8)
        edge[opening] += 1
        edge[closing + 1] -= 1  # two strings that touch are caught by the grammar
        in_string = np.cumsum(edge[:-1], dtype=np.int8) > 0
        bad[self._doc_of(np.flatnonzero(in_string & (raw < 32)))] = True
        cls = _CLASS[raw]
        plain = ~in_string & (cls == SCALAR) & ~_SPACE[raw]
        first = plain.copy()
        first[1:] &= ~plain[:-1]
        bound = bounds[(bounds < n)]
        first[bound] |= plain[bound]
        token = (~in_string & (cls < STRING)) | first
        token[opening] = True
        pos = np.flatnonzero(token)
        doc = self._doc_of(pos)
        keep = ~bad[doc]
        pos, doc = pos[keep], doc[keep]
        kind = cls[pos].astype(np.int64)
        ends = np.empty(len(pos), np.int64)
        ends[:] = pos + 1
        text = kind == STRING
        if text.any():
            ends[text] = closing[np.searchsorted(opening, pos[text])] + 1
        scalar = kind == SCALAR
        if scalar.any():
            gap = np.flatnonzero(~plain)
            stop = np.r_[gap, n][np.searchsorted(gap, pos[scalar])]
            ends[scalar] = np.minimum(stop, bounds[1:][doc[scalar]])
            spans = [self.data[a:b] for a, b in zip(pos[scalar].tolist(), ends[scalar].tolist())]
            fine = {s: _LITERAL.fullmatch(s) is not None for s in set(spans)}
            bad[doc[scalar][[not fine[s] for s in spans]]] = True
        # depth, parents
        step = np.where(kind <= OPEN_ARRAY, 1, np.where(kind <= CLOSE_ARRAY, -1, 0))
        depth = np.cumsum(step)
        begin = np.searchsorted(doc, np.arange(docs + 1))
        base = np.r_[0, depth][begin[:-1]]
        depth = depth - base[doc]
        bad[doc[depth < 0]] = True
        whole = np.diff(begin) > 0
        bad |= ~whole
        bad[np.flatnonzero(whole)[depth[begin[1:][whole] - 1] != 0]] = True
        level = np.where(step == 1, depth - 1, depth + (step == -1))
        member = np.arange(len(pos))
        heads = member[step == 1]
        entry = np.concatenate([member, heads])
        head = np.concatenate([np.full(len(member), -1), heads])
        rank = np.concatenate([level, depth[heads]])
        order = np.lexsort((entry, rank, doc[entry]))
        d, r = doc[entry][order], rank[order]
        fresh = np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])] if len(order) else np.zeros(0, bool)
        seen = np.where(head[order] >= 0, np.arange(len(order)), -1)
        seen = np.where(fresh & (seen < 0), np.arange(len(order)), seen)
        carried = np.maximum.accumulate(seen) if len(seen) else seen
        over = head[order][carried] if len(order) else head
        parent = np.full(len(pos), -1)
        mine = head[order] < 0
        parent[entry[order][mine]] = over[mine]
        # grammar
        context = np.where(parent < 0, 0, np.where(kind[parent] == OPEN_OBJECT, 1, 2))
        closes = step == -1
        bad[doc[closes & (context != kind - 1)]] = True
        before = np.r_[START, kind[:-1]] if len(kind) else kind
        before[begin[:-1][whole]] = START
        key = (kind == STRING) & (context == 1) & ((before == OPEN_OBJECT) | (before == COMMA))
        kind = np.where(key, KEY, kind)
        before = np.r_[START, kind[:-1]] if len(kind) else kind
        before[begin[:-1][whole]] = START
        bad[doc[~_FOLLOWS[context, before, kind]]] = True
        self.valid = ~bad
        # the values
        value = np.flatnonzero(np.isin(kind, _VALUES) & ~bad[doc])
        number = np.full(len(pos), -1)
        number[value] = np.arange(len(value))
        self.doc, self.kind, self.start = doc[value], kind[value], pos[value]
        up = parent[value]
        self.parent = np.where(up >= 0, number[up], -1)
        order = np.lexsort((value, self.parent))
        p, d = self.parent[order], self.doc[order]
        new = np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])] if len(order) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        self.place = np.empty(len(value), np.int64)
        self.place[order] = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
        self.order, self._sorted = order, p
        self.end = ends[value]
        shut = np.flatnonzero(closes & ~bad[doc])
        self.end[number[parent[shut]]] = pos[shut] + 1
        named = context[value] == 1
        self.key_start = np.where(named, pos[np.maximum(value - 2, 0)], -1)
        self.key_end = np.where(named, ends[np.maximum(value - 2, 0)], -1)
        # names, and texts, written with escapes
        within = lambda a, b: np.searchsorted(slash, a) != np.searchsorted(slash, b)
        self.escaped = named & within(self.key_start, self.key_end)
        self.text_escaped = (self.kind == STRING) & within(self.start, self.end)
        self.null = (self.kind == SCALAR) & (raw[self.start] == ord("n"))

    def _doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, "right") - 1

    def roots(self) -> np.ndarray:
        """The values at the top of valid texts."""
        return np.flatnonzero(self.parent < 0)

    def children(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of ``values``, with the place in ``values`` each belongs to."""
        a, b = np.searchsorted(self._sorted, values), np.searchsorted(self._sorted, values, "right")
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.order[at], np.repeat(np.arange(len(values)), n)

    def fields(self, values: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Children of that name; of several of one object the last."""
        child, of = self.children(values)
        quoted = json.dumps(name).encode()
        size = self.key_end[child] - self.key_start[child]
        same = size == len(quoted)
        for i, byte in enumerate(quoted):
            same[same] = self.raw[self.key_start[child[same]] + i] == byte
        for c in np.flatnonzero(self.escaped[child]).tolist():
            same[c] = self.name(child[c]) == name
        child, of = child[same], of[same]
        last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
        return child[last], of[last]

    def name(self, value: int) -> str:
        """The decoded name of a value of an object."""
        span = self.data[self.key_start[value] : self.key_end[value]]
        return json.loads(span) if self.escaped[value] else span[1:-1].decode()

    def names(self, values: np.ndarray) -> pa.Array:
        """The decoded names of values of objects."""
        return self._decoded(values, self.key_start[values], self.key_end[values], self.escaped[values])

    def strings(self, values: np.ndarray) -> pa.Array:
        """The decoded texts of strings."""
        return self._decoded(values, self.start[values], self.end[values], self.text_escaped[values])

    def text(self, value: int) -> str:
        """The bytes of a value as they stand."""
        return self.data[self.start[value] : self.end[value]].decode()

    def texts(self, values: np.ndarray) -> pa.Array:
        """The bytes of values as they stand."""
        return self._spans(self.start[values], self.end[values])

    def _spans(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum(end - start)])
        at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], end - start)
        kept = pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.raw[at]))
        return pa.Array.from_buffers(pa.large_string(), len(start), [None, *kept]).cast(pa.string())

    def _decoded(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, escaped: np.ndarray) -> pa.Array:
        """What stands between quotes; only what is written with escapes is decoded one by one."""
        out = self._spans(start + 1, end - 1)
        odd = np.flatnonzero(escaped)
        if not len(odd):
            return out
        found = _strings([json.loads(self.data[a:b]) for a, b in zip(start[odd].tolist(), end[odd].tolist())])
        return pc.replace_with_mask(out, pa.array(escaped), found)

    def counted(self, child: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether a child counts: of equal names of an object only the last does."""
        out = np.ones(len(child), bool)
        named = np.flatnonzero(self.key_start[child] >= 0)
        if len(named):
            codes = np.asarray(pc.dictionary_encode(self.names(child[named])).indices).astype(np.int64)
            pair = of[named] * (codes.max() + 1) + codes
            order = np.argsort(pair, kind="stable")
            last = np.r_[pair[order][1:] != pair[order][:-1], True]
            out[named[order[~last]]] = False
        return out


CHILDREN = "record_id bigint, trace_pos int, child string, child_key string, value string"


def _strings(values) -> pa.Array:
    """Texts as an Arrow array; halves of characters, which JSON can name but no text can hold, become ``?``."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


class _Owners:
    """The traces that values belong to: a place among the records, and in the record's traces; for samplings the call's place too."""

    def __init__(self, record: np.ndarray, trace: np.ndarray, call: np.ndarray | None = None):
        self.record, self.trace, self.call = record, trace, call

    def take(self, at: np.ndarray) -> _Owners:
        return _Owners(self.record[at], self.trace[at], None if self.call is None else self.call[at])


class _Out:
    def __init__(self, values: bool):
        self.values = values
        self.rows: list[tuple[_Owners, str, pa.Array, pa.Array]] = []
        self.texts: list[tuple[str, _Owners, pa.Array]] = []  # what is to be indexed in the next round

    def add(self, owners: _Owners, child: str, keys: pa.Array, ix: JsonIndex, values: np.ndarray) -> None:
        if len(values):
            self.rows.append((owners, child, keys, ix.texts(values) if self.values else pa.nulls(len(values), pa.string())))


def _numbers(values: np.ndarray) -> pa.Array:
    return pa.array(values).cast(pa.string())


def _elements(ix: JsonIndex, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of arrays, and lone objects as their element 0: ``(value, of, place)``."""
    arrays = np.flatnonzero(ix.kind[values] == OPEN_ARRAY)
    child, of = ix.children(values[arrays])
    lone = np.flatnonzero(ix.kind[values] == OPEN_OBJECT)
    return np.r_[child, values[lone]], np.r_[arrays[of], lone], np.r_[ix.place[child], np.zeros(len(lone), np.int64)]


def _take(ix: JsonIndex, what: str, values: np.ndarray, owners: _Owners, out: _Out) -> None:
    """Children of kind ``what`` below ``values``, or their texts for the next round."""
    texts = np.flatnonzero(ix.kind[values] == STRING)
    if len(texts):
        out.texts.append((what, owners.take(texts), ix.strings(values[texts])))
    rest = np.flatnonzero(ix.kind[values] <= OPEN_ARRAY)
    values, owners = values[rest], owners.take(rest)
    objects, lists = np.flatnonzero(ix.kind[values] == OPEN_OBJECT), np.flatnonzero(ix.kind[values] == OPEN_ARRAY)
    if what == "rewards":
        child, of = ix.children(values[objects])
        fine = ix.counted(child, of) & ~ix.null[child]
        out.add(owners.take(objects[of[fine]]), "reward", ix.names(child[fine]), ix, child[fine])
        child, of = ix.children(values[lists])
        entry = ix.kind[child] == OPEN_OBJECT
        child, of = child[entry], of[entry]
        named, which = ix.fields(child, "name")
        text = ix.kind[named] == STRING
        out.add(owners.take(lists[of[which[text]]]), "reward", ix.strings(named[text]), ix, child[which[text]])
    elif what == "metrics":
        paths = None
        while len(values):
            child, of = ix.children(values)
            fine = ix.counted(child, of) & ~ix.null[child]
            child, of = child[fine], of[fine]
            own = ix.key_start[child] >= 0
            step = _numbers(ix.place[child])
            if own.any():
                step = pc.replace_with_mask(step, pa.array(own), ix.names(child[own]))
            if paths is not None:
                above = paths.take(pa.array(of))
                step = pc.if_else(pc.equal(above, ""), step, pc.binary_join_element_wise(above, step, "."))
            owners = owners.take(of)
            leaf = ix.kind[child] >= STRING
            out.add(owners.take(leaf), "metric", step.filter(pa.array(leaf)), ix, child[leaf])
            values, owners, paths = child[~leaf], owners.take(~leaf), step.filter(pa.array(~leaf))
    elif what == "calls":
        child, of, place = _elements(ix, values)
        call = ix.kind[child] == OPEN_OBJECT
        child, of, place = child[call], of[call], place[call]
        out.add(owners.take(of), "call", _numbers(place), ix, child)
        found, which = ix.fields(child, "sampling")
        mine = owners.take(of[which])
        _take(ix, "sampling", found, _Owners(mine.record, mine.trace, place[which]), out)
    else:  # sampling
        rules, which = ix.fields(values[objects], "stop_rules")
        child, of, place = _elements(ix, rules)
        fine = ~ix.null[child]
        mine = owners.take(objects[which[of[fine]]])
        out.add(mine, "stop_rule", pc.binary_join_element_wise(_numbers(mine.call), _numbers(place[fine]), "."), ix, child[fine])


def _children(values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload", 1 << 20):
                ix = JsonIndex(*_bytes(batch.column(1)))
                out = _Out(values)
                roots = ix.roots()
                roots = roots[ix.kind[roots] == OPEN_OBJECT]
                traces, _ = ix.fields(roots, "traces")
                trace, _ = ix.children(traces[ix.kind[traces] == OPEN_ARRAY])
                trace = trace[ix.kind[trace] == OPEN_OBJECT]
                owner = _Owners(ix.doc[trace], ix.place[trace])
                for what in ("rewards", "metrics", "calls"):
                    found, which = ix.fields(trace, what)
                    _take(ix, what, found, owner.take(which), out)
                while out.texts:  # JSON text in place of a value
                    todo, out.texts = out.texts, []
                    for what, owners, texts in todo:
                        inner = JsonIndex(*_bytes(texts))
                        tops = inner.roots()
                        tops = tops[inner.kind[tops] <= OPEN_ARRAY]
                        _take(inner, what, tops, owners.take(inner.doc[tops]), out)
                if out.rows:
                    record = batch.column(0).take(pa.array(np.concatenate([o.record for o, *_ in out.rows])))
                    trace_pos = pa.array(np.concatenate([o.trace for o, *_ in out.rows]).astype(np.int32))
                    child = pa.concat_arrays([pa.repeat(name, len(keys)) for _, name, keys, _ in out.rows])
                    arrays = [record, trace_pos, child, *(pa.concat_arrays([r[i] for r in out.rows]) for i in (2, 3))]
                    yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in CHILDREN.split(", ")])

    return run


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(texts, fold=False)


def trace_children(records: DataFrame, record_id: str = "record_id", payload: str = "payload", values: bool = True) -> DataFrame:
    """Rewards, metrics, calls and stop rules of all traces of all payloads.

    One row each: ``record_id``, ``trace_pos`` (both name the parent trace),
    ``child``, ``child_key`` as TESTDATA.md defines them, and ``value``, the JSON
    text of the child (null without ``values``). A stop rule's key begins with its call's. Payloads that
    aren't one JSON object with an array ``traces``, null and empty ones included,
    give no row; of equal names in one object the last counts; equal rows each
    give their own rows; other columns are ignored.
    """
    return records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(payload).alias("payload")).where("payload is not null").mapInArrow(_children(values), CHILDREN)


def trace_tables(records: DataFrame, record_id: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """Four flat tables whose rows name their parents, of :func:`trace_children`.

    A reward that is a bare number is its score; only a stop rule that isn't an
    object has ``raw``, its JSON text. Values that don't fit a column's type are null there.
    """
    rows = trace_children(records, record_id, payload)
    key = ["record_id", "trace_pos"]

    def number(path: str):
        return F.get_json_object("value", path).try_cast("double")

    rewards = rows.where("child = 'reward'").select(*key, F.col("child_key").alias("name"), F.coalesce(number("$.score"), F.col("value").try_cast("double")).alias("score"), number("$.weight").alias("weight"))
    metrics = rows.where("child = 'metric'").select(*key, F.col("child_key").alias("metric"), F.col("value").try_cast("double").alias("number"), F.col("value").alias("raw"))
    calls = rows.where("child = 'call'").select(
        *key, F.col("child_key").cast("int").alias("call_pos"), F.get_json_object("value", "$.finish_reason").alias("finish_reason"),
        number("$.usage.completion_tokens").cast("bigint").alias("completion_tokens"),
    )
    place = F.split("child_key", r"\.")
    rules = rows.where("child = 'stop_rule'").select(
        *key, place[0].cast("int").alias("call_pos"), place[1].cast("int").alias("rule_pos"),
        F.get_json_object("value", "$.text").alias("text"), number("$.after").cast("bigint").alias("after"), F.when(~F.col("value").startswith("{"), F.col("value")).alias("raw"),
    )
    return {"rewards": rewards, "metrics": metrics, "calls": calls, "stop_rules": rules}
