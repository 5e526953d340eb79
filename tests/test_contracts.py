"""Probes, suites, manifests, reports."""

import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from tracemill.operators import protocol as P
from tracemill.sources import contracts as C
from tracemill.sources import files as FS

SCHEMAS = {"read": {"type": "object", "properties": {"path": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["path"]}}


def call(name="read", text=True, **arguments):
    return {"type": "function", "function": {"name": name, "arguments": json.dumps(arguments) if text else arguments}}


def reply(calls, finish="tool_calls", **more):
    message = {"role": "assistant", "content": ""} | ({} if calls is None else {"tool_calls": calls})
    return json.dumps({"choices": [{"message": message, "finish_reason": finish}], "usage": {"completion_tokens": 5}} | more)


CASES = [
    (reply([call(path="a")]), None, 1, 0),
    (reply([call(path="a", limit=2)]), None, 1, 0),
    (reply([call(path="b")]), "not the call asked for", 1, 0),
    (reply([call(path="a"), call(path="a")]), "not the call asked for", 2, 0),
    (reply([call(path="a", limit=0)]), "limit is out of bounds", 0, 1),
    (reply([call(path="a", text=False)]), "malformed call", 0, 1),
    (reply([call("other", path="a")]), "no tool other", 0, 1),
    (reply([call(path="a")], "stop"), "reply did not finish by its call", 1, 0),
    (reply(None, "stop"), "calls are not a list", 0, 1),
    ("{", "reply is not JSON", 0, 1),
    (json.dumps({"choices": []}), "not exactly one choice", 0, 1),
]


def test_probes(spark):
    df = spark.createDataFrame([(i, "read", '{"path": "a"}', r) for i, (r, *_) in enumerate(CASES)], "i int, tool string, expected string, reply string")
    got = P.probe_results(df, SCHEMAS)
    rows = got.orderBy("i").collect()
    assert [(r.reason, r.parsed_calls, r.invalid_calls) for r in rows] == [c[1:] for c in CASES]
    assert [r.passed for r in rows] == [c[1] is None for c in CASES]
    assert rows[3].looped and not rows[0].looped
    m = P.protocol_rates(got).first()
    assert m.probes == 11 and m.valid_call_rate == 2 / 11 and m.parsed_call_rate == 5 / 11 and m.invalid_tool_rate == 6 / 12
    assert P.protocol_gate(P.protocol_rates(got)).first().failure == "not every probe passed"
    assert P.protocol_gate(P.protocol_rates(got.where("i < 2"))).first().failure is None
    choice = df.where("i = 0").select(P.reply_choice("reply").alias("c")).select("c.*").first()
    assert choice.finish_reason == "tool_calls" and choice.completion_tokens == 5 and choice.fault is None


def test_suites(spark, tmp_path):
    def case(i, **change):
        return {"id": i, "operations": [{"op": "call"}], "observe": ["x"], "expected": {"status": "ok", "values": {"x": {"kind": "int", "value": "1"}}}} | change

    suites = {
        "good": [case("a"), case("b", observe=[], expected={"status": "error", "operation": 0, "type": "E"})], "empty": [], "twice": [case("a"), case("a")],
        "lacks": [{"id": "q"}], "unfit": [case("a", observe=["y"])], "message": [case("a", observe=[], expected={"status": "error", "operation": 0, "type": "E", "message": 5})],
    }
    for name, cases in suites.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "cases.json").write_text(json.dumps({"schema_version": 1, "cases": cases}))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "cases.json").write_text("[" * 40 + "]" * 40)
    cases, faults = C.read_suites(spark, str(tmp_path))
    got = {(r.path.split("/")[-2], r.reason) for r in faults.collect()}
    assert got == {("empty", "no cases"), ("twice", "id given twice"), ("lacks", "case lacks a part"), ("unfit", "expectation does not fit"), ("message", "expectation does not fit"), ("deep", "too deep")}
    good = cases.where(F.col("path").contains("/good/"))
    assert [r.case_id for r in good.orderBy("place").collect()] == ["a", "b"]
    (tmp_path / "same").mkdir()
    (tmp_path / "same" / "cases.json").write_text(json.dumps(json.loads((tmp_path / "good" / "cases.json").read_text()), indent=3))
    digests = {r.path.split("/")[-2]: r.sha256 for r in C.suite_digests(spark, str(tmp_path)).collect()}
    text = json.dumps(json.loads((tmp_path / "good" / "cases.json").read_text()), sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
    assert digests["good"] == digests["same"] == hashlib.sha256(text.encode()).hexdigest() != digests["lacks"]
    shutil.rmtree(tmp_path / "same")
    tasks = good.select("path").distinct().select("path", F.lit(3).alias("expected_cases"))
    assert C.count_faults(cases, tasks).count() == 1 and C.count_faults(cases, tasks.withColumn("expected_cases", F.lit(2))).count() == 0


def test_manifests(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "a"), (2, "validation", "b")], "o int, split string, t string")
    digest = FS.write_splits(rows, str(tmp_path), "split", ["o"])
    manifest = {"schema_version": 2, "dataset_sha256": digest, "train_trajectories": 1, "valid_trajectories": 1, "action_counts": [["final", 2]], "samples_per_trace_limit": 1}
    FS.write_report(manifest, str(tmp_path / "manifest.json"))
    assert C.load_manifest(str(tmp_path)) == manifest
    for change in ({"train_trajectories": True}, {"action_counts": [["final", 0]]}, {"dataset_sha256": "x"}):
        FS.write_report(manifest | change, str(tmp_path / "manifest.json"))
        with pytest.raises(ValueError):
            C.load_manifest(str(tmp_path))


def test_snapshots(spark, tmp_path):
    source = tmp_path / "s"
    source.mkdir()
    for name in ("manifest.json", "train.jsonl", "valid.jsonl"):
        with pytest.raises(ValueError):
            C.snapshot_dataset(str(source), str(tmp_path / "t"))
        (source / name).write_text("{}")
    C.snapshot_dataset(str(source), str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["manifest.json", "train.jsonl", "valid.jsonl"]
    with pytest.raises(ValueError):
        C.snapshot_dataset(str(source), str(tmp_path / "u"), most_bytes=1)
    (source / "test.jsonl").write_text("{}")
    with pytest.raises(ValueError, match="holdout"):
        C.snapshot_dataset(str(source), str(tmp_path / "v"))


def test_reports_and_lists(spark, tmp_path):
    FS.write_report({"run_id": 7, "traces": "20", "loop_rate": "0.5", "parsed_calls": "many", "note": "x"}, str(tmp_path / "r.json"))
    r = C.read_reports(spark, str(tmp_path / "r.json")).first()
    assert (r.run_id, r.traces, r.loop_rate, r.parsed_calls, r.parser) == ("7", 20, 0.5, None, None)
    tasks = spark.createDataFrame([(i, f"t{i % 7}", "train" if i % 2 else "holdout") for i in range(40)], "record_id int, task_id string, split string")
    listed = C.task_list(tasks, "train", ["task_id", "record_id"]).orderBy("idx").collect()
    assert [r.idx for r in listed] == list(range(20)) and [(r.task_id, r.record_id) for r in listed] == sorted((r.task_id, r.record_id) for r in listed)
    with pytest.raises(ValueError):
        C.task_list(tasks, "none", ["task_id"])
    made = spark.createDataFrame([(100 + i, f"a{i}", "train") for i in range(3)], "record_id int, task_id string, split string")
    both = C.task_list(tasks, "train", ["task_id", "record_id"], made).orderBy("idx").collect()
    assert both[:20] == listed and [r.record_id for r in both[20:]] == [100, 101, 102] and both[-1].idx == 22
    with pytest.raises(ValueError, match="train split only"):
        C.task_list(tasks, "holdout", ["task_id"], made)
    assert C.artifact_digest({"a": b"", "b": None}) == C.artifact_digest({"b": None, "a": b""}) != C.artifact_digest({"a": None, "b": None})
    names = spark.createDataFrame([("a/b.json",), ("b/",), ("",)], "p string")
    assert [r[0] for r in names.select(C.bare_name(F.col("p"))).collect()] == ["b.json", "b", ""]
    assert C.as_line({"b": 1, "a": "é"}) == '{"a":"é","b":1}\n'
