"""Trace files, metrics and export, on hand-made traces."""

import hashlib
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill.operators import export as E
from tracemill.operators import report as RP
from tracemill.operators import trajectories as T
from tracemill.plans import agents
from tracemill.sources import files as FS
from tracemill.sources.traces import first_error, flatten, read_lines, read_traces

KINDS = {"look": "read", "put": "write", "check": "test"}


def node(role, content, parent, sampled=False, **more):
    return {"parent": parent, "sampled": sampled, "message": {"role": role, "content": content, **more}}


def use(i, name, arguments, text=True):
    return {"id": f"k{i}", "name": name, "arguments": json.dumps(arguments) if text else arguments}


def trace(name, split="train", **change):
    out = {
        "id": name, "ok": True, "stop_condition": "agent_completed", "rewards": {"tests": {"score": 1.0}},
        "task": {"data": {"task_id": f"t-{name}", "task_revision": 2, "split": split}},
        "tools": [{"name": n, "description": "d", "parameters": {"type": "object", "properties": {"p": {"type": "integer"}, "a": {"type": "integer"}}}} for n in KINDS],
        "nodes": [
            node("system", "sys", None), node("user", [{"type": "text", "text": "fix"}, {"type": "text", "text": "it"}], 0),
            node("assistant", "", 1, True, tool_calls=[use(1, "look", {"p": 1})]), node("tool", '{"ok": false}', 2, tool_call_id="k1"), node("assistant", "Done.", 3, True),
        ],
        "calls": [{"finish_reason": "tool_calls", "sampling": {"temperature": 0}}, {"finish_reason": "stop", "sampling": {"temperature": 0}}],
        "metrics": {"passed_cases": 3.0, "total_cases": 4},
    }
    return out | change


def write(folder, name, *records):
    path = Path(folder) / name / "traces.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps({"traces": r}, ensure_ascii=False)) + "\n" for r in records), encoding="utf-8", newline="")
    return str(path)


def frames(spark, folder, keep=("file_ord", "line_no", "trace_ord")):
    traces, errors = read_traces(read_lines(spark, [str(folder)]))
    return flatten(traces, list(keep)), errors


def test_lines_and_faults(spark, tmp_path):
    write(tmp_path, "b", [trace("one")], "", "not json", '{"traces": {}}', '{"traces":[1]} ', '{"traces":[]} x')
    write(tmp_path, "a", [trace("two"), trace("three x")], [trace("four", ok=1), trace("five", rewards={"tests": {"score": True}})])
    (tmp_path / "a" / "other.jsonl").write_text("{}\n")
    lines = read_lines(spark, [str(tmp_path), str(tmp_path / "a")])
    assert sorted((r.file_ord, r.line_no) for r in lines.collect()) == [(1, 1), (1, 2), (2, 1), (2, 3), (2, 4), (2, 5), (2, 6)]
    parts, errors = frames(spark, tmp_path)
    heads = {r.trace_id: r for r in parts["traces"].collect()}
    assert set(heads) == {"one", "two", "three x", "four", "five"}
    assert not heads["four"].ok and heads["one"].ok and heads["five"].score == 1.0 and heads["one"].passed_cases == 3
    faults = {(r.file_ord, r.line_no): r.reason for r in errors.collect()}
    assert faults == {(2, 3): "not a JSON object", (2, 4): "traces is not a list", (2, 5): "trace is not an object", (2, 6): "not a JSON object"}
    assert first_error(errors, ["file_ord", "line_no"]) == "not a JSON object" and first_error(errors.limit(0), ["file_ord"]) is None
    (tmp_path / "none").mkdir()
    for paths, most in (([str(tmp_path)], 1), ([str(tmp_path / "none")], None)):
        with pytest.raises(ValueError, match="trace file"):
            read_lines(spark, paths, most_files=most)
    with pytest.raises(Exception, match="over the size limit"):
        read_lines(spark, [str(tmp_path)], most_bytes=4).collect()
    with pytest.raises(ValueError, match="over the size limit"):
        read_lines(spark, [str(tmp_path)], most_total=900)


def test_lines_of_split_files(spark, tmp_path):
    """Numbers don't depend on where a file is split, on batches, or on other files of a task."""
    sizes = {"a": 300, "b": 7, "c": 41}
    for f, n in sizes.items():
        (tmp_path / f).mkdir()
        (tmp_path / f / "traces.jsonl").write_bytes(b"".join(b"" if i == n else (b"x%d" % i * (i % 5) + (b"\r\n" if i % 2 else b"\n")) for i in range(n + 1)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.openCostInBytes")}
    try:
        for most, batch, cost in (("128m", "10000", "4m"), ("300", "3", "0"), ("64", "1", "0")):
            for k, v in zip(before, (most, batch, cost)):
                spark.conf.set(k, v)
            got = {(Path(r.file).parent.name, r.file_ord, r.line_no): r.line for r in read_lines(spark, [str(tmp_path)]).collect()}
            assert got == {(f, o, i + 1): f"x{i}" * (i % 5) for o, f in enumerate("abc", 1) for i in range(sizes[f]) if i % 5}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def looped():
    """Two equal calls in turn, the second beside the chain, then text."""
    t = trace("loop")
    t["nodes"] = [*t["nodes"][:4], node("assistant", "", 3, True, tool_calls=[use(2, "look", {"p": 1}, text=False)]), node("assistant", "Done.", 3, True)]
    t["calls"] = [*t["calls"][:1] * 2, t["calls"][1]]
    return t


def test_loop_and_rates(spark, tmp_path):
    write(tmp_path, "a", [looped()])
    parts, _ = frames(spark, tmp_path)
    m = T.measure_turns(parts["nodes"], parts["tools"]).first()
    assert (m.sampled_turns, m.parsed_turns, m.tool_call_attempts, m.parsed_calls, m.invalid_calls, m.repeated_call_turns) == (3, 2, 2, 2, 0, 1)
    assert m.loop_rate == 0.5 and m.parsed_tool_call_rate == 1.0
    c = T.measure_model_calls(parts["model_calls"]).first()
    assert (c.model_calls, c.completed_model_calls, c.length_limited_calls, c.end_token_rate) == (3, 3, 0, 1.0)


def test_invalid_calls(spark, tmp_path):
    def turn(calls):
        return node("assistant", "x", None, True, **({} if calls is ... else {"tool_calls": calls}))

    odd = [turn(...), turn([]), turn(None), turn("x"), turn([use(1, "look", {}), use(2, "other", {}), {"id": "3", "name": "look", "arguments": "{"}, 5]), turn([{"function": {"name": "put", "arguments": {}}}])]
    twice = turn([use(1, "put", {"a": 1}), use(2, "put", {"a": 1})])
    write(tmp_path, "a", [trace("t", nodes=[*odd, twice])])
    parts, _ = frames(spark, tmp_path)
    m = T.measure_turns(parts["nodes"], parts["tools"]).first()
    # null and text calls are an attempt each; two calls are malformed, one tool isn't there
    assert (m.sampled_turns, m.parsed_turns, m.tool_call_attempts, m.parsed_calls, m.invalid_calls, m.unavailable_tool_calls, m.repeated_call_turns) == (7, 3, 9, 5, 5, 1, 1)


def test_arguments_are_held_against_tools(spark, tmp_path):
    """Calls whose arguments don't fit are invalid, though parsed and available; of equal names the last tool counts."""
    kind = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}, "required": ["n"], "additionalProperties": False}
    tools = [{"name": "look", "description": "d", "parameters": {}}, {"name": "look", "description": "d", "parameters": kind}]
    calls = [use(1, "look", {"n": 1}), use(2, "look", {"n": 0}, text=False), use(3, "look", {}), use(4, "look", {"n": 1, "z": 1}), use(5, "gone", {}), {"id": "6"}]
    write(tmp_path, "a", [trace("t", tools=tools, nodes=[node("assistant", "x", None, True, tool_calls=calls)])])
    parts, _ = frames(spark, tmp_path)
    m = T.measure_turns(parts["nodes"], parts["tools"]).first()
    assert (m.tool_call_attempts, m.parsed_calls, m.invalid_calls, m.unavailable_tool_calls) == (6, 5, 5, 1)


def identified(name, **change):
    t = looped() | {"id": name} | change
    t["task"] = {"data": t["task"]["data"] | {"task_digest": "d", "prompt": "p", "system_prompt": "s"}}
    return t


def test_report(spark, tmp_path):
    key = ["file_ord", "line_no", "trace_ord"]
    write(tmp_path, "a", [identified("x"), identified("x", rewards={"tests": {"score": 0.25}}, metrics={"passed_cases": "3", "total_cases": 4.5})], [identified("y", nodes=[], calls=[{"finish_reason": "length", "sampling": {"temperature": 0.0}}])])
    lines = read_lines(spark, [str(tmp_path)])
    traces, _ = read_traces(lines)
    entries = RP.comparison_entries(lines, "native", key[:2])
    r = RP.measure_report(flatten(traces, key), entries, "native", key).first()
    assert tuple(r.asDict()) == RP.COLUMNS
    # traces of one id all count
    assert (r.schema_version, r.parser, r.trace_files, r.traces, r.sampled_turns, r.parsed_turns, r.parsed_calls, r.tool_call_attempts, r.invalid_calls, r.unavailable_tool_calls) == (1, "native", 1, 3, 6, 4, 4, 4, 0, 0)
    assert (r.repeated_call_turns, r.completed_model_calls, r.model_calls, r.length_limited_calls, r.passed_cases, r.total_cases) == (2, 6, 7, 1, 6, 8)
    assert (r.sealed_validation_reward, r.parsed_tool_call_rate, r.invalid_tool_rate, r.end_token_rate, r.loop_rate) == (0.75, 1.0, 0.0, 6 / 7, 0.5)
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    entry = lambda t: {k: t["task"]["data"][k] for k in RP.IDENTITY} | {"tools": t["tools"], "parser": "native", "sampling": t["calls"][0]["sampling"]}
    made = sorted((e["task_id"], dump(e)) for e in [entry(identified("x"))] * 2 + [entry(identified("y", calls=[{"sampling": {"temperature": 0.0}}]))])
    assert r.comparison_sha256 == hashlib.sha256(("[" + ",".join(e for _, e in made) + "]").encode()).hexdigest()
    assert RP.trace_faults(traces, key).count() == 0
    empty = RP.measure_report(flatten(traces.limit(0), key), entries.limit(0), "native", key).first()
    assert (empty.traces, empty.model_calls, empty.loop_rate, empty.sealed_validation_reward) == (0, 0, 0.0, None)
    with pytest.raises(ValueError):
        RP.measure_report(flatten(traces, key), entries, "", key)


def test_faults_of_reports(spark, tmp_path):
    key = ["line_no", "trace_ord"]
    bad = [
        (identified("a") | {"tools": None}, 1), (identified("a") | {"tools": [{"name": 1, "parameters": {}}]}, 1), (identified("a") | {"nodes": [{"sampled": True}]}, 2), (identified("a") | {"calls": {}}, 3),
        (identified("a") | {"calls": [{"finish_reason": None}]}, 3), (identified("a") | {"rewards": {"tests": {"score": True}}}, 4), (trace("a"), 5), (identified("a") | {"calls": []}, 5), (identified("a") | {"calls": [{"finish_reason": "stop"}]}, 5),
    ]
    changed = identified("z", calls=[{"finish_reason": "stop", "sampling": {"t": 0}}, {"finish_reason": "stop", "sampling": {"t": 0.0}}])
    write(tmp_path, "a", [t for t, _ in bad] + [identified("fine"), changed])
    lines = read_lines(spark, [str(tmp_path)])
    traces, _ = read_traces(lines)
    assert [(r.trace_ord, r.stage) for r in RP.trace_faults(traces, key).orderBy("trace_ord").collect()] == [(i, s) for i, (_, s) in enumerate(bad)]
    last = RP.comparison_entries(lines, "p", ["line_no"]).orderBy("trace_ord").collect()[-2:]
    assert last[0].fault is None and last[1].fault == "sampling changed within a trace" and last[1].entry is None


def test_repeats_pass_over_empty_lists(spark):
    rows = [(1, ["a"]), (2, []), (3, None), (4, ["a"]), (5, ["b", "b"]), (6, ["b"]), (7, ["b"])]
    df = spark.createDataFrame([("t", *r) for r in rows], "t string, n int, s array<string>")
    assert [r.n for r in T.repeated(df, ["t"], ["n"], "s").where("repeated").orderBy("n").collect()] == [4, 5, 7]


def test_chains_and_branches(spark):
    rows = [("a", 0, None), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("c", 0, 1), ("c", 1, 0), ("m", 0, 7), ("l", 0, None)] + [("l", i, i - 1) for i in range(1, 70)]
    df = spark.createDataFrame(rows, "trace_id string, node int, parent int")
    got = {(r.trace_id, r.node): r.chain for r in T.chains(df).collect()}
    assert got[("a", 3)] == [0, 1, 3] and got[("a", 2)] == [0, 1, 2] and got[("l", 69)] == list(range(70))
    assert got[("c", 0)] is None and got[("c", 1)] is None and got[("m", 0)] is None
    asked = T.chains(df, spark.createDataFrame([("a", 3), ("c", 1), ("q", 1)], "trace_id string, node int")).collect()
    assert {(r.trace_id, r.node): r.chain for r in asked} == {("a", 3): [0, 1, 3], ("c", 1): None, ("q", 1): None}
    chain = spark.createDataFrame([("a", [0, 1, 3])], "trace_id string, chain array<int>")
    assert [tuple(r) for r in T.off_chain(chain, df.where("trace_id = 'a'").select("trace_id", "node")).collect()] == [("a", 2)]


def test_depths(spark):
    """Cycles, ways into cycles and missing parents have no depth; a trace may be deeper than any list."""
    rows = [("a", 0, None), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("c", 0, 1), ("c", 1, 0), ("c", 2, 0), ("c", 3, None), ("m", 0, 7), ("m", 1, 0), ("s", 0, 0)]
    df = spark.createDataFrame(rows, "trace_id string, node int, parent int")
    got = {(r.trace_id, r.node): r.depth for r in T.depths(df).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2, ("a", 2): 3, ("a", 3): 3, ("c", 0): None, ("c", 1): None, ("c", 2): None, ("c", 3): 1, ("m", 0): None, ("m", 1): None, ("s", 0): None}
    assert T.depths(df.limit(0)).count() == 0
    rnd = random.Random(6)
    trees = [(t, i, rnd.choice([None] + [rnd.randrange(max(0, i - back), i) for back in (1, 1, 2, 700)]) if i else None) for t, n in (("x", 900), ("y", 257), ("z", 3)) for i in range(n)]
    trees += [("q", i, 5000 - 7 * i if i % 3 else i + 1) for i in range(1000)]  # up and down, with cycles and ends that aren't there
    wild = spark.createDataFrame(trees, "trace_id string, node int, parent int")
    parent = {(t, i): p for t, i, p in trees}

    def way(t, i):
        out = []
        while i is not None and (t, i) in parent and i not in out:
            out.append(i)
            i = parent[t, i]
        return out[::-1] if i is None else None

    assert {(r.trace_id, r.node): r.chain for r in T.chains(wild).collect()} == {k: way(*k) for k in parent}
    assert {(r.trace_id, r.node): r.depth for r in T.depths(wild).collect()} == {k: len(way(*k)) if way(*k) else None for k in parent}
    n = 140_000
    deep = spark.range(n).select(F.lit("t").alias("trace_id"), F.col("id").cast("int").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent"))
    got = T.depths(deep)
    assert got.where("depth = node + 1").count() == n and got.where("depth is null").count() == 0
    leaf = spark.createDataFrame([("t", n - 1)], "trace_id string, node int")
    assert T.ways(deep, leaf).where("place = node").count() == n


def test_splits_by_meaning(spark, tmp_path):
    """Splits count by what they mean, however they are written."""
    tasks = [(1, "b", "f", "validation"), (2, "a", "f", " Val "), (3, None, "f", "val"), (4, "c", "g", "TEST"), (5, "d", "h", "holdout"), (6, "e", "h", "Training"), (7, "f", "i", "odd"), (8, "g", None, "test")]
    spark.createDataFrame(tasks, "record_id bigint, task_id string, family string, split string").write.parquet(f"{tmp_path}/tasks.parquet")
    spelt = [("validation", "validation"), ("val", "validation"), ("test", "holdout"), ("holdout", "holdout"), ("training", "train"), ("train", "train")]
    spark.createDataFrame([("split", w, m) for w, m in spelt], "field string, written string, means string").write.parquet(f"{tmp_path}/spellings.parquet")
    assert {(r.record_id, r.idx) for r in agents.task_places(spark, str(tmp_path)).collect()} == {(2, 0), (1, 1)}
    assert [r.family for r in agents.holdout_only_families(spark, str(tmp_path)).collect()] == ["g"]


def test_export(spark, tmp_path):
    other = looped() | {"id": "looped"}
    failed, early = trace("failed", rewards={"tests": {"score": 0.0}}), trace("early", stop_condition="budget")
    write(tmp_path, "a", [trace("one"), other, failed, early], [trace("one", split="validation"), trace("val", split="validation")])
    parts, _ = frames(spark, tmp_path)
    rows = {r.trace_id: r for r in E.training_rows(parts["traces"], parts["nodes"], parts["tools"], KINDS, ["file_ord", "line_no", "trace_ord"]).collect()}
    assert set(rows) == {"one", "val"}  # looped has a useful turn off its chain
    one = rows["one"]
    assert one.split == "train" and one.turn_index == 4 and one.target_kinds == ["final", "read", "recovery"]
    assert [m.role for m in one.messages] == ["system", "user", "assistant", "tool", "assistant"] and one.messages[1].content == "fix\nit"
    call = one.messages[2].tool_calls[0]
    assert (call.id, call.type, call.function.name, call.function.arguments) == ("k1", "function", "look", '{"p":1}')
    assert [t.function.name for t in one.tools] == list(KINDS)
    samples = spark.createDataFrame([("x", "train", ["final"]), ("y", "train", ["final", "read"]), ("z", "validation", ["read"])], "trace_id string, split string, target_kinds array<string>")
    assert {r.split: (r.trajectories, r.enough) for r in E.split_counts(samples, {"train": 2, "validation": 2}).collect()} == {"train": (2, True), "validation": (1, False)}
    assert {r.kind: r.samples for r in T.histogram(samples, "target_kinds").collect()} == {"final": 2, "read": 2}
    assert [r.kind for r in E.missing_kinds(samples, ["final", "edit"]).collect()] == ["edit"]
    length = E.token_length("trace_id", lambda x: len(x) + 4)
    assert E.within_length(samples, length, 5).count() == 3 and E.within_length(samples, length, 4).count() == 0


def test_strict_exports(spark, tmp_path):
    """The first fault of a successful trace stops a strict export; others' faults don't matter."""
    call = use(1, "look", {"p": 1})
    odd = {
        "a role": ([node("narrator", "x", None)], "role is unknown"), "a text": ([node("user", [{"type": "image"}], None)], "content is no text"), "null": ([node("assistant", "x", None, tool_calls=None)], "calls are no list"),
        "no id": ([node("assistant", "x", None, tool_calls=[call | {"id": None}])], "a call is not whole"), "no arguments": ([node("assistant", "x", None, tool_calls=[call | {"arguments": "["}])], "a call is not whole"),
        "result": ([node("tool", "x", None)], "a result names no call"), "tool": ([node("assistant", "x", None, True, tool_calls=[use(1, "other", {})])], "unavailable tool: other"), "fine": ([node("assistant", "x", None, tool_calls=[use(1, "other", {})])], None),
    }
    write(tmp_path, "a", [trace(k, nodes=n) for k, (n, _) in odd.items()])
    parts, _ = frames(spark, tmp_path)
    order = ["file_ord", "line_no", "trace_ord"]
    assert {r.trace_id: r.reason for r in E.export_faults(parts["nodes"], KINDS, order).collect()} == {k: why for k, (_, why) in odd.items() if why}
    with pytest.raises(ValueError, match="a role, node 0: role is unknown"):
        E.training_rows(parts["traces"], parts["nodes"], parts["tools"], KINDS, order, strict=True)
    good = parts["traces"].where("trace_id = 'fine'")
    assert E.training_rows(good, parts["nodes"], parts["tools"], KINDS, order, strict=True).count() == 0
    (tmp_path / "b").mkdir()
    write(tmp_path / "b", "c", [trace("one"), looped()])
    parts, _ = frames(spark, tmp_path / "b")
    with pytest.raises(ValueError, match="loop: a useful turn lies off the chain"):
        E.training_rows(parts["traces"], parts["nodes"], parts["tools"], KINDS, order, strict=True)


def test_prepared_rows(spark):
    """A tokenizer of a token a character and four a message, two for the opening of a reply."""
    count = lambda messages, generation: sum(len(m["content"] or "") + 4 for m in messages) + (2 if generation else 0)
    say = lambda *texts: [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(texts)]
    rows = [("a", "train", ["final"], say("hi", "ok")), ("b", "train", ["read"], say("hi", "x" * 90)), ("c", "validation", ["final"], say("hi", "ok")), ("d", "holdout", [], None)]
    schema = "trace_id string, split string, target_kinds array<string>, messages array<struct<role string, content string>>"
    df = spark.createDataFrame(rows, schema)
    got = {r.trace_id: (r.total_tokens, r.completion_tokens, r.length_fault) for r in E.sample_lengths(df, count).collect()}
    assert got == {"a": (12, 4, None), "b": (100, 92, None), "c": (12, 4, None), "d": (None, None, "no messages")}
    assert [r.trace_id for r in E.prepare_rows(df, count, 99, {"train": 1, "validation": 1}, ["final"]).orderBy("trace_id").collect()] == ["a", "c"]
    assert E.prepare_rows(df, count, 100, {"train": 2}, ["final", "read"]).count() == 3
    for longest, least, required, why in ((99, {"train": 2}, [], "too few traces fit the length: train"), (99, {}, ["final", "read"], "train samples lack kinds: read"), (5, {"validation": 1}, [], "validation")):
        with pytest.raises(ValueError, match=why):
            E.prepare_rows(df, count, longest, least, required)
    for messages, why in ((say("hi"), "not an assistant's"), (say("hi", ""), None), ([], "no messages")):
        more = df.unionByName(spark.createDataFrame([("e", "train", [], messages)], schema))
        if why:
            with pytest.raises(ValueError, match=why):
                E.prepare_rows(more, count, 1, {}, [])
    with pytest.raises(ValueError, match="no completion"):
        E.prepare_rows(df, lambda messages, generation: 7, 100, {}, [])


TASK = """schema_version = 2
task_id = "{id}"
task_revision = 1
family = "some-family"
split = "train"
prompt = "Do it."
runtime = "python"
runtime_version = "3.1"
max_time_seconds = 60
token_budget = 4096
expected_cases = 3
editable_files = ["a.py"]
context_files = ["a.py", "d/b.py"]
source = "here"
source_revision = "r1"
license = "MIT"
sensitive_data = "public"
seed = 0
[environment]
image = "i"
image_digest = "d"
os = "linux"
architecture = "arm64"
network = "none"
cpus = 1.0
memory_bytes = 1
pids = 1
workspace_bytes = 1
temp_bytes = 1
home_bytes = 1
dependency_lock_digest = "x"
[verifier]
protocol = "p1"
cases = "verifier/cases.json"
"""


def test_task_manifests(spark, tmp_path):
    change = lambda old, new: TASK.format(id="x/odd").replace(old, new)
    cases = {
        "fine": (TASK.format(id="x/fine"), None), "other": (TASK.format(id="x/name"), "task_id does not end with the name of its folder"), "broken": ("id = ", None),
        "one": (TASK.format(id="x/one"), None), "odd": (change("seed = 0\n", ""), "task lacks seed"), "odd2": (change("seed = 0", "seed = 0\nmore = 1"), "task has unknown more"), "odd3": (change("cpus = 1.0\n", ""), "environment lacks cpus"),
        "odd4": (change("token_budget = 4096", "token_budget = true"), "token_budget is out of bounds"), "odd5": (change('"a.py", "d/b.py"', '"d/b.py"'), "a file to be edited is not in the context"), "odd6": (change('["a.py"]', '["../a.py"]').replace('["a.py",', '["../a.py",'), "editable_files holds a path that is not plain"),
        "odd7": (change("MIT", "MIT or so"), "license is invalid"), "odd8": (change('"3.1"', '"3"'), "runtime is unknown or of another version"), "odd9": (change("cpus = 1.0", "cpus = 2"), "environment.cpus is another"), "odd10": (change("verifier/cases", "workspace/cases"), "verifier.cases is no file of the task"),
        "odd11": (change("x/odd", "Odd"), "task_id is invalid"), "odd12": (change("schema_version = 2", "schema_version = 2.0"), "schema_version is another"), "odd13": (change('"Do it."', '" "'), "prompt is empty or too long"), "odd14": (change('["a.py"]', '["a.py", "a.py"]'), "editable_files is no list of files"),
    }
    for folder, (text, _) in cases.items():
        (tmp_path / "tasks" / folder).mkdir(parents=True)
        (tmp_path / "tasks" / folder / "task.toml").write_text(text)
    (tmp_path / "more" / "one").mkdir(parents=True)
    (tmp_path / "more" / "one" / "task.toml").write_text(TASK.format(id="y/one"))
    manifests = FS.read_manifests(spark, str(tmp_path / "tasks")).unionByName(FS.read_manifests(spark, str(tmp_path / "more")))
    got = {str(Path(r.path).parent.relative_to(tmp_path)): r.reason for r in FS.task_faults(manifests, 2, {"python": "3.1"}, "p1", {"cpus": 1, "os": "linux"}).collect()}
    assert got.pop("tasks/broken")
    assert got == {f"tasks/{k}": why for k, (_, why) in cases.items() if why} | {"tasks/one": "task name given twice: one", "more/one": "task name given twice: one"}


def test_holdout_stops_an_export(spark, tmp_path):
    write(tmp_path, "a", [trace("one"), trace("two", split="holdout", ok=False)])
    parts, _ = frames(spark, tmp_path)
    with pytest.raises(Exception, match="holdout"):
        E.training_rows(parts["traces"], parts["nodes"], parts["tools"], KINDS, ["trace_ord"]).collect()


def test_split_files_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(2, "train", "bé", None), (1, "train", "a ", 1), (3, "validation", "c", 2)], "ord int, split string, text string, n int")
    digest = FS.write_splits(rows, str(tmp_path), "split", ["ord"])
    (tmp_path / "test.jsonl").write_text("stale")
    assert FS.write_splits(rows, str(tmp_path), "split", ["ord"]) == digest and not (tmp_path / "test.jsonl").exists()
    assert (tmp_path / "train.jsonl").read_text(encoding="utf-8").split("\n") == ['{"n":1,"text":"a "}', '{"n":null,"text":"bé"}', ""]
    h = hashlib.sha256(b"dataset\0")
    for file in ("train.jsonl", "valid.jsonl"):
        for line in (tmp_path / file).read_bytes().split(b"\n")[:-1]:
            for x in (file.encode(), line):
                h.update(len(x).to_bytes(8, "big") + x)
    assert digest == h.hexdigest()
    assert FS.read_objects(spark, str(tmp_path / "train.jsonl"), "text string, n int").count() == 2
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no object"):
        FS.read_objects(spark, str(tmp_path / "none.jsonl"), "text string, n int")
    assert FS.write_splits(rows, str(tmp_path), "split", ["ord"]) != FS.write_splits(rows.where("ord > 1"), str(tmp_path), "split", ["ord"])
    FS.write_report({"b": 1, "a": 2}, str(tmp_path / "r" / "report.json"))
    assert json.loads((tmp_path / "r" / "report.json").read_text()) == {"a": 2, "b": 1}
    assert FS.scrub(rows.select(F.struct("ord", "text").alias("c")), "c", ("text",)).first().c.asDict() == {"ord": 2}


def report(i, reward, **more):
    base = {"report_id": i, "comparison_sha256": "s", "sealed_validation_reward": reward, "parsed_calls": 5, "parsed_tool_call_rate": 1.0, "invalid_tool_rate": 0.0, "unavailable_tool_calls": 0, "end_token_rate": 1.0, "loop_rate": 0.1}
    return base | more


def test_comparison_and_selection(spark):
    rows = [report(1, 0.5), report(2, 0.25), report(3, 0.5, parsed_calls=0, loop_rate=0.3), report(4, 0.9, comparison_sha256="other")]
    base = spark.createDataFrame([report(0, 0.25)])
    got = {r.report_id: (r.status, r.reasons) for r in T.compare_reports(base, spark.createDataFrame(rows)).collect()}
    assert got == {1: ("improved", []), 2: ("rejected", ["reward did not increase"]), 3: ("rejected", ["no call was parsed", "loop rate rose"])}
    best = T.best_by(spark.createDataFrame(rows[:3]), (), ["sealed_validation_reward"], ["loop_rate"], "report_id", ["report_id"])
    assert best.first().report_id == 1
    tied = T.best_by(spark.createDataFrame([report(7, 1.0), report(5, 1.0)]), (), ["sealed_validation_reward"], [], "report_id", ["report_id"])
    assert tied.first().report_id == 5
    pick = lambda df, **more: [r.report_id for r in T.select_best(df, "report_id", ["sealed_validation_reward"], ["loop_rate"], "report_id", ["report_id"], **more).collect()]
    some = spark.createDataFrame(rows)
    assert pick(some, least=2) == [4] and pick(some, where=F.col("sealed_validation_reward") < 0.4) == [2] and pick(some, where=F.lit(False)) == []
    for few in (some.limit(1), some.unionByName(some)):
        with pytest.raises(ValueError, match="2 candidates"):
            pick(few, least=2)


def test_fingerprint_is_of_the_multiset(spark):
    def of(*entries):
        return T.fingerprint(spark.createDataFrame(entries, "k string, e string"), "k", "e").first().sha256

    assert of(("b", "2"), ("a", "1"), ("a", "1")) == hashlib.sha256(b"[1,1,2]").hexdigest() == of(("a", "1"), ("a", "1"), ("b", "2"))
    assert of(("a", "1"), ("b", "2")) != of(("a", "1"), ("a", "1"), ("b", "2"))
    many = spark.range(2503).select(F.lit("k").alias("k"), F.lit("é").alias("e"))
    assert T.fingerprint(many, "k", "e").first().sha256 == hashlib.sha256(("[" + ",".join(["é"] * 2503) + "]").encode()).hexdigest()
    none = hashlib.sha256(b"[]").hexdigest()
    assert T.fingerprint(many.limit(0), "k", "e").first().sha256 == none
    assert {(r.g, r.sha256 == none) for r in T.fingerprint(spark.createDataFrame([(1, "a", None), (2, None, "x"), (None, "b", "y")], "g int, k string, e string"), "k", "e", ("g",)).collect()} == {(1, True), (2, False), (None, False)}
    keyed = spark.createDataFrame([(g, f"k{i % 3}", f"e{i % 5}") for g in range(40) for i in range(g)], "g int, k string, e string")
    want = {g: hashlib.sha256(("[" + ",".join(e for _, e in sorted((f"k{i % 3}", f"e{i % 5}") for i in range(g))) + "]").encode()).hexdigest() for g in range(1, 40)}
    assert {r.g: r.sha256 for r in T.fingerprint(keyed, "k", "e", ("g",)).collect()} == want


def test_failed_results(spark):
    contents = ['{"ok": false}', '{"ok": 0}', '{"returncode": 1}', '{"returncode": 0}', '{"returncode": true}', '{"status": "error"}', "text", "[]", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c string")
    assert [r.i for r in df.where(T.failed_result(F.lit("tool"), F.col("c"))).orderBy("i").collect()] == [0, 2, 5]
    assert df.where(T.failed_result(F.lit("user"), F.col("c"))).count() == 0


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 1, "z")], "k string, o int, v string")
    assert sorted((r.k or "", r.v) for r in T.first_wins(df, ["k"], ["o"]).collect()) == [("", "z"), ("a", "y")]
    assert T.first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_prompts(spark):
    good = "Rules\n- Model: m1\nToday: now\nMore\nYou work in an isolated Linux workspace\nrest"
    texts = [good, good.replace("Today: now\n", ""), good.replace("More", "- Model: m2"), "none", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r[0] for r in df.select(E.system_core(F.col("x"))).collect()] == ["Rules\nMore", None, None, None, None]
    same = spark.createDataFrame([("a", "x", None), ("a", "y", None)], "a string, b string, c string")
    assert tuple(E.same_everywhere(same, ["a", "b", "c"]).first()) == ("a", None, None)


def test_logs_trees_and_manifests(spark, tmp_path):
    log = spark.createDataFrame([(1, "Iter 1: Train loss 2.5, x\nIter 2: Val loss nan\nIter 3: Train loss inf, y"), (2, "none")], "id int, value string")
    assert [(r.place, r.kind, r.finite) for r in FS.training_losses(log).orderBy("place").collect()] == [(0, "Train", True), (1, "Val", False), (2, "Train", False)]
    tree = tmp_path / "tree"
    (tree / "d").mkdir(parents=True)
    (tree / "d" / "f.txt").write_bytes(b"abc")
    got = FS.read_tree(spark, str(tree)).collect()
    assert [(r.length, r.sha256) for r in got] == [(3, hashlib.sha256(b"abc").hexdigest())]
    assert FS.tree_inventory(FS.read_tree(spark, str(tree)), 1, 3) == (1, 3)
    for most in ((0, None), (None, 2)):
        with pytest.raises(ValueError, match="more than"):
            FS.tree_inventory(FS.read_tree(spark, str(tree)), *most)
    (tree / "link").symlink_to(tree / "d" / "f.txt")
    with pytest.raises(ValueError):
        FS.read_tree(spark, str(tree))
    tasks = tmp_path / "tasks"
    for name, text in {"a": 'id = "x"\nn = 1\n', "b": 'id = "x"\n', "c": "id = ", "d": 'id = "y"\nn = 1\nz = 2\n'}.items():
        (tasks / name).mkdir(parents=True)
        (tasks / name / "task.toml").write_text(text)
    manifests = FS.read_manifests(spark, str(tasks))
    faults = sorted((Path(r.path).parent.name, r.reason.split(":")[0]) for r in FS.manifest_faults(manifests, ["id", "n"]).collect())
    assert [f for f in faults if f[0] != "c"] == [("a", "id given twice"), ("b", "id given twice"), ("b", "missing"), ("d", "unknown")] and len(faults) == 5


def test_rows_and_installed_tasks(spark):
    tool = lambda *names: [{"function": {"name": n}} for n in names]
    say = lambda role, text: [{"role": role, "content": text}]
    rows = [(1, say("system", "x"), tool("a", "b")), (2, say("user", "x"), tool("a", "b")), (3, say("system", " "), tool("a", "b")), (4, say("system", "x"), tool("a", "a")), (5, say("system", "x"), tool("b")), (6, [], tool("a", "b")), (7, say("system", "x"), tool("b", "a")), (8, None, None)]
    df = spark.createDataFrame(rows, "i int, messages array<struct<role string, content string>>, tools array<struct<function struct<name string>>>")
    got = {r.i: r.fault for r in E.row_faults(df, ["a", "b"]).collect()}
    none = "no system message in front"
    assert got == {1: None, 2: none, 3: none, 4: "a tool is named twice", 5: "other tools", 6: none, 7: None, 8: none}
    tasks = spark.createDataFrame([("a", 1, "d"), ("b", 1, "d"), ("b", 2, "e")], "task_id string, task_revision int, task_digest string")
    data = spark.createDataFrame([("a", 1, "d"), ("a", 2, "d"), ("b", 1, "d"), ("c", 1, "d"), (None, 1, "d")], "task_id string, task_revision int, task_digest string")
    faults = sorted(str((r.task_id, r.task_revision, r.fault)) for r in E.installed_task(data, tasks).collect())
    assert faults == ["('a', 1, None)", "('a', 2, 'another revision')", "('b', 1, 'installed twice')", "('c', 1, 'not installed')", "(None, 1, 'not installed')"]
