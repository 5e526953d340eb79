"""Conversations and runs of turns: against plain versions, across chunks, and on awkward rows."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark import cloudpickle

from tests.llm import reference as ref
from tracemill.llm import messages as M
from tracemill.llm.conversations import NEVER, feasible, merged_order, rebuild_conversations
from tracemill.llm.queries import queries
from tracemill.llm.runs import _runs_of, near_repeated_turns, repeated_turns, segment
from tracemill.tables import load

SCHEMA = (
    "msg_id bigint, trace_id string, task_id string, run_id string, node int, parent int, role string, content string,"
    " tool_calls string, tool_call_id string, sampled boolean, recorded_at timestamp_ntz, received_at timestamp_ntz"
)
START = dt.datetime(2026, 3, 1)


class Rows:
    def __init__(self):
        self.rows = []

    def add(self, trace, node, role, content="text", calls=None, answers=None, parent="chain", after=None, received=0):
        parent = (node - 1 if node else None) if parent == "chain" else parent
        calls = json.dumps(calls) if isinstance(calls, list) else calls
        at = START + dt.timedelta(seconds=node if node is not None and after is None else after or 0)
        self.rows.append((len(self.rows) + 1, trace, "t", "r", node, parent, role, content, calls, answers, role == "assistant", at, at + dt.timedelta(seconds=received)))
        return self

    def frame(self, spark):
        return spark.createDataFrame(self.rows, SCHEMA)


def call(i, name="read", **arguments):
    return {"id": f"c{i}", "name": name, "arguments": arguments}


@pytest.fixture(scope="module")
def spellings(spark):
    return load(spark, "/root/testdata/sf0.001", "spellings")


def test_conversations_and_runs_of_the_small_table(spark, small, spellings):
    messages = load(spark, small, "trace_messages")
    counting = ref.counting_rows([r.asDict() for r in messages.collect()])
    means = {r.written: r.means for r in spellings.where("field = 'role'").collect()}
    want = set()
    for trace, rows in counting.items():
        if ref.sound(rows, M.read_calls, M.is_blank, means):
            want |= {(trace, n, r["msg_id"]) for n, r in rows.items()}
    got = rebuild_conversations(messages, spellings).collect()
    assert {(r.trace_id, r.pos, r.msg_id) for r in got} == want and len(got) == len(want)
    runs = set()
    for trace, rows in counting.items():
        turns = []
        for n in sorted(rows):
            calls = M.read_calls(rows[n]["tool_calls"])
            if calls and means.get((rows[n]["role"] or "").strip().lower()) == "assistant":
                turns.append((n, json.dumps([(name, M.plain_arguments(a)) for _, name, a in calls], sort_keys=True)))
        i = 0
        while i < len(turns):
            j = i
            while j + 1 < len(turns) and turns[j + 1][1] == turns[i][1]:
                j += 1
            if j > i:
                runs.add((trace, turns[i][0], turns[j][0], j - i + 1))
            i = j + 1
    found = repeated_turns(messages, spellings).collect()
    assert {(r.trace_id, r.first_node, r.last_node, r.n_turns) for r in found} == runs and len(found) == len(runs)
    near = near_repeated_turns(messages, spellings).collect()
    assert sum(r.n_turns for r in near) == sum(1 for t, rows in counting.items() for r in rows.values() if means.get((r["role"] or "").strip().lower()) == "assistant" and M.read_calls(r["tool_calls"]))


def sound_trace(rows, trace, turns, width=1):
    """A user, turns of ``width`` calls with their results, an answer."""
    rows.add(trace, 0, "user")
    node = 1
    for t in range(turns):
        rows.add(trace, node, "assistant", "", [call(f"{t}-{w}", path=f"f{t // 3}") for w in range(width)])
        for w in range(width):
            rows.add(trace, node + 1 + w, "tool", "out", None, f" c{t}-{w} ")
        node += 1 + width
    rows.add(trace, node, "assistant", "done")
    return node + 1


def test_long_traces_are_put_together_across_chunks(spark, spellings):
    rows = Rows()
    n = sound_trace(rows, "long", 700)
    # the same trace with one result before its call, in another chunk
    broken = Rows()
    sound_trace(broken, "broken", 700)
    swap = [list(r) for r in broken.rows]
    swap[302][9], swap[1202][9] = swap[1202][9], swap[302][9]
    rows.rows += [(r[0] + 10_000, *r[1:]) for r in swap]
    random.Random(3).shuffle(rows.rows)
    frame = rows.frame(spark)
    got = rebuild_conversations(frame, spellings).collect()
    assert {r.trace_id for r in got} == {"long"} and sorted(r.pos for r in got) == list(range(n))
    runs = sorted((r.first_node, r.last_node, r.n_turns) for r in repeated_turns(frame.where("trace_id = 'long'"), spellings).collect())
    assert runs == [(1 + 6 * k, 5 + 6 * k, 3) for k in range(233)]


def test_rules_of_sound_traces(spark, spellings):
    rows = Rows()
    sound_trace(rows, "plain", 1)
    sound_trace(rows, "wide", 1, 3)
    rows.add("gap", 0, "user").add("gap", 2, "assistant", parent=1)
    rows.add("parent", 0, "user").add("parent", 1, "assistant", parent=None)
    rows.add("role", 0, "user").add("role", 1, "narrator").add("role", 2, "assistant")
    rows.add("calls", 0, "user").add("calls", 1, "assistant", "", "[{").add("calls", 2, "assistant")
    rows.add("unanswered", 0, "user").add("unanswered", 1, "assistant", "", [call(1)]).add("unanswered", 2, "assistant")
    rows.add("stray", 0, "user").add("stray", 1, "tool", "x", None, "c1").add("stray", 2, "assistant")
    rows.add("noid", 0, "user").add("noid", 1, "assistant", "", [call(1)]).add("noid", 2, "tool", "x").add("noid", 3, "assistant")
    rows.add("twice", 0, "user").add("twice", 1, "assistant", "", [call(1)]).add("twice", 2, "tool", "x", None, "c1").add("twice", 3, "tool", "x", None, "c1").add("twice", 4, "assistant")
    rows.add("blankuser", 0, "user", ' [{"type":"text","text":" "}]').add("blankuser", 1, "assistant")
    rows.add("users", 0, "user").add("users", 1, "assistant", "").add("users", 2, "user").add("users", 3, "assistant")
    rows.add("listed", 0, "Human ", '[{"type":"text","text":"hi"}]').add("listed", 1, "GPT", "[not json")
    rows.add("end", 0, "user").add("end", 1, "assistant").add("end", 2, "user")
    rows.add("blankend", 0, "user").add("blankend", 1, "assistant", "[]")
    rows.add(None, 0, "user").add(None, 1, "assistant")
    rows.add("nonode", 0, "user").add("nonode", 1, "assistant").add("nonode", None, "assistant", parent=None)
    rows.add("again", 0, "user").add("again", 1, "assistant", "old").add("again", 1, "assistant", "", received=50).add("again", 1, "assistant", "new", received=90)
    frame = rows.frame(spark)
    got = rebuild_conversations(frame, spellings).collect()
    assert {r.trace_id for r in got} == {"plain", "wide", "listed", "again"}
    assert max(r.msg_id for r in got if r.trace_id == "again") == len(rows.rows)
    twice = frame.unionByName(frame).withColumnRenamed("task_id", "sound")
    assert sorted(map(tuple, rebuild_conversations(twice, spellings).select("trace_id", "pos", "msg_id").collect())) == sorted((r.trace_id, r.pos, r.msg_id) for r in got)
    for empty in (rebuild_conversations, repeated_turns, near_repeated_turns):
        assert empty(frame.limit(0), spellings).count() == 0


def test_clock_offsets_are_estimated(spark, spellings):
    rows = Rows().add("t", 0, "user", after=0)
    for k in range(10):  # the tools' clock is 100 s behind
        rows.add("t", 1 + 2 * k, "assistant", "", [call(k)], after=10 * k + 1).add("t", 2 + 2 * k, "tool", "x", None, f"c{k}", after=10 * k + 2 - 100)
    rows.add("t", 21, "assistant", after=120)
    turns = sorted(rebuild_conversations(rows.frame(spark), spellings).collect(), key=lambda r: r.pos)
    by_role = {r.role: r.clock_offset_s for r in turns}
    assert 95 < by_role["tool"] - by_role["assistant"] < 100
    assert by_role["user"] == 0
    assert [r.msg_id for r in turns] == list(range(1, 23))
    assert all(a.corrected_at <= b.corrected_at for a, b in zip(turns, turns[1:]))
    raw = [rows.rows[r.msg_id - 1][11] for r in turns]
    assert sum(a > b for a, b in zip(raw, raw[1:])) == 10  # as recorded, each tool came first


def test_clocks_across_chunks(spark, spellings):
    """Skewed clocks in a trace of several chunks, a time missing: times rise along replies, places have no gap."""
    rows = Rows()
    n = sound_trace(rows, "long", 400)
    skewed = [(*r[:11], None if r[4] in (0, 300) else r[11] - dt.timedelta(seconds=5000 if r[6] == "tool" else 0), r[12]) for r in rows.rows]
    random.Random(4).shuffle(skewed)
    turns = sorted(rebuild_conversations(spark.createDataFrame(skewed, SCHEMA), spellings).collect(), key=lambda r: r.pos)
    assert [(r.pos, r.msg_id) for r in turns] == [(i, i + 1) for i in range(n)]
    assert turns[0].corrected_at is None and turns[300].corrected_at == turns[299].corrected_at
    assert all(a.corrected_at <= b.corrected_at for a, b in zip(turns[1:], turns[2:]))
    assert 4990 < turns[2].clock_offset_s - turns[1].clock_offset_s < 5000
    true = [int((START + dt.timedelta(seconds=i) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for i in range(n)]
    shift = int(turns[1].clock_offset_s * 1e6)
    assert all(abs(r.corrected_at - shift - t) < 5e6 for r, t in list(zip(turns, true))[1:])


def test_the_merge_holds_replies_back():
    """A turn takes the time of what it replies to if its own is earlier, also over the start of a chunk."""
    times = np.array([10, 30, 20, 5, 5, 4])
    order, held = merged_order(times, np.array([1, 2, 2, 1, 3, 2]), np.array([0, 3, 6]), np.array([NEVER, 5]))
    assert order.tolist() == [0, 1, 2, 3, 4, 5] and held.tolist() == [10, 30, 30, 5, 5, 5]
    assert feasible(np.array([0, 1, 2, 0]), np.array([-1, 0, 0, 3]), np.array([False, True, True, True])).tolist() == [True, True, False, False]


def test_runs_come_from_the_segmentation(spark, small, spellings):
    """Boundaries that are paid for leave every turn a run of its own; then nothing repeats."""
    messages = load(spark, small, "trace_messages")
    for penalty in (-1e-3, -1.0):
        assert near_repeated_turns(messages, spellings, penalty).where("n_turns > 1").count() == 0
        assert repeated_turns(messages, spellings, penalty).count() == 0
    assert near_repeated_turns(messages, spellings, 1e9).where("n_turns > 1").count() > repeated_turns(messages, spellings, 1e9).count() > 0


def test_missing_times_leave_no_duration(spark, spellings):
    rows = Rows().add("t", 0, "user")
    for k in range(1, 4):
        rows.add("t", k, "assistant", "", [call(k, path="f")])
    frame = spark.createDataFrame([(*r[:11], None if r[4] == 1 else r[11], r[12]) for r in rows.rows], SCHEMA)
    assert [tuple(r) for r in repeated_turns(frame, spellings).collect()] == [("t", 1, 3, 3, None)]
    assert [r.duration_s for r in repeated_turns(rows.frame(spark), spellings).collect()] == [2.0]


def test_equal_turns():
    same = M.plain_arguments
    assert same({"path": "a/./b/../c.py", "limit": 3.0, "attempt": 1}) == same({"limit": 3, "path": "a//c.py", "nonce": "x", "timeout_ms": 5})
    assert same({"command": " python  -m x\n"}) == same({"command": "python -m x"})
    assert same({"a": True}) != same({"a": "true"}) and json.dumps(same({"a": True})) != json.dumps(same({"a": 1}))
    assert M.read_calls('[{"id":"1","function":{"name":"f","arguments":"{}"}}]') == [("1", "f", {})]
    for bad in ("{}", "[1]", '[{"id":"1","name":"f"}]', '[{"name":"f","arguments":{}}]', '[{"id":"1","name":"f","arguments":"[]"}]', '[{"id":"1","name":"f","arguments":{}}] x', "[" * 100_000):
        assert M.read_calls(bad) is None
    assert M.read_calls(None) == [] and M.read_calls("[]") == []


def test_segmentation_is_optimal():
    rnd = random.Random(2)
    for _ in range(40):
        n = rnd.randint(1, 9)
        base = [rnd.getrandbits(63) for _ in range(2)]
        bits = [rnd.choice(base) ^ (1 << rnd.randrange(63)) for _ in range(n)]
        weights = [rnd.randint(1, 3) for _ in range(n)]
        penalty = rnd.choice([0.01, 0.05, 0.15, 0.6])
        starts, settled = segment(np.array(bits), np.array(weights, float), penalty)
        total = penalty * (len(starts) - 1)
        for a, b in zip(starts, starts[1:] + [n]):
            for bit in range(64):
                ones = sum(w for x, w in zip(bits[a:b], weights[a:b]) if x >> bit & 1)
                total += min(ones, sum(weights[a:b]) - ones) / 64
        assert abs(total - ref.cheapest(bits, weights, penalty)) < 1e-9
        assert settled == n or settled in starts
        whole = _runs_of(np.zeros(n), np.r_[True, np.zeros(n - 1, bool)], np.array(bits), np.array(weights, float), penalty)
        assert np.flatnonzero(whole).tolist() == starts


def test_long_stretches_are_settled_piece_by_piece(spark, spellings, monkeypatch):
    """A stretch far over the limit gives the runs that it gives in one go."""
    from tracemill.llm import runs

    rows, rnd = Rows(), random.Random(5)
    rows.add("t", 0, "user")
    for k in range(1, 2500):
        rows.add("t", k, "assistant", "", [call(k, path=f"some/long/folder/name{rnd.randint(0, 3)}.py", line=rnd.randint(1, 2))])
    frame = rows.frame(spark)
    whole = sorted(map(tuple, near_repeated_turns(frame, spellings).collect()))
    assert sum(r[3] for r in whole) == 2499 and len(whole) < 2499
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    monkeypatch.setattr(runs, "STRETCH", 50)
    cloudpickle.register_pickle_by_value(runs)  # so that workers see the lower limit
    try:
        assert sorted(map(tuple, runs.near_repeated_turns(frame, spellings).collect())) == whole
    finally:
        cloudpickle.unregister_pickle_by_value(runs)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["p2_conversations", "p5_near_runs", "p5_reports"])
def test_queries_run(spark, small, name):
    assert queries()[name](spark, small).count() > 0
