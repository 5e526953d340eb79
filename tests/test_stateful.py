"""Relations, stateful operators, verdicts and streams."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.operators import relations as R
from tracemill.operators import stateful as ST
from tracemill.operators import verdicts as V
from tracemill.operators.trajectories import over_budget
from tracemill.sources.files import parse_csv
from tracemill.streaming import stateful as SS


def test_coerced_join(spark):
    left = spark.createDataFrame([(1, " 7"), (2, "7.0"), (3, ""), (4, None), (5, "x"), (6, "07"), (7, "x")], "l int, k string")
    right = spark.createDataFrame([(1, "7", "old", "a"), (2, " 7 ", "new", "b"), (3, "x", "x", "c"), (4, "", "none", "d"), (5, None, "none", "e")], "r int, k string, v string, l string")
    got = sorted((r.r, r.k, r.v, r.l) for r in R.coerced_join(left, right, "k", "k", ["r"]).collect())
    assert got == [(2, " 7 ", "new", "b"), (3, "x", "x", "c"), (3, "x", "x", "c")]
    with pytest.raises(ValueError, match="left side has no column q"):
        R.coerced_join(left, right, "q", "q", ["r"])
    with pytest.raises(ValueError, match="right side has no column l2"):
        R.coerced_join(left, right, "k", "l2", ["r"])


def test_routes(spark):
    routes = spark.createDataFrame([(r,) for r in ("/a/b", "/a/:x", "/a/*rest", "/:y/b", "/*all", "/a.b/:z", "/c/:p/d")], "route string")
    paths = ["/a/b", "/a/c", "/a/c/d", "/q/b", "/q", "/a.b/1", "/axb/1", "/c/1/d", "/c/1/2/d", "/a/", "", None]
    got = {r.path: r.route for r in R.match_routes(spark.createDataFrame([(p,) for p in paths], "path string"), routes).collect()}
    assert got == {"/a/b": "/a/b", "/a/c": "/a/:x", "/a/c/d": "/a/*rest", "/q/b": "/:y/b", "/q": "/*all", "/a.b/1": "/a.b/:z", "/axb/1": "/*all", "/c/1/d": "/c/:p/d", "/c/1/2/d": "/*all", "/a/": "/*all", "": None, None: None}
    odd = spark.createDataFrame([("//files/x/y/", 1, "z"), ("/files", 2, "z"), ("/u/7", 3, "z"), ("/", 4, "z")], "path string, params int, route string")
    more = spark.createDataFrame([(r,) for r in ("/files/*rest", "/u/:id", "/", "/u/:id", None)], "route string")
    assert [(r.path, r.route, r.params) for r in R.match_routes(odd, more).collect()] == [("//files/x/y/", "/files/*rest", {"rest": "x/y"}), ("/files", None, None), ("/u/7", "/u/:id", {"id": "7"}), ("/", "/", {})]
    assert R.match_routes(odd, more.limit(0)).where("route is null").count() == 4
    for bad, why in ((["/dup", "/dup/"], "duplicate route"), (["/w/*a", "/w/*b"], "duplicate route"), (["/p/:id", "/p/:name"], "conflicting param"), (["/p/:id/x", "/p/:name/y"], "conflicting param"), (["/x/*rest/tail"], "wildcard must")):
        with pytest.raises(ValueError, match=why):
            R.route_table(bad)
    with pytest.raises(ValueError):
        R.match_routes(spark.createDataFrame([("/",)], "path string"), routes, most_routes=3)


def test_run_lengths(spark):
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(["a", "a", None, None, "a", "b"])], "u string, i int, v string")
    assert [(r.v, r["first"].i, r.length) for r in R.run_lengths(df, ["u"], ["i"], "v").orderBy("run").collect()] == [("a", 0, 2), (None, 2, 2), ("a", 4, 1), ("b", 5, 1)]


def folded(events):
    balance, last, first = 0, None, {}
    for seq, kind, amount, _ in sorted(events, key=lambda e: e[3]):
        first.setdefault(seq, (kind, amount))
    for seq in sorted(first):
        kind, amount = first[seq]
        if kind not in ("deposit", "withdraw", "snapshot"):
            return balance, last, "unknown event"
        if kind != "snapshot" and amount <= 0:
            return balance, last, "amount must be positive"
        after = {"deposit": balance + amount, "withdraw": balance - amount, "snapshot": amount}[kind]
        if kind == "withdraw" and after < 0:
            return balance, last, "insufficient funds"
        balance, last = after, seq
    return balance, last, None


def test_ledgers(spark):
    rnd, rows = random.Random(1), []
    for a in range(40):
        n = rnd.randint(1, 12)
        rows += [(f"a{a}", rnd.randint(1, 9), rnd.choices(["deposit", "withdraw", "snapshot", "fee"], [6, 3, 1, 0.2])[0], rnd.choice([5, 10, 100, 0]), a * 100 + i) for i in range(n)]
    df = spark.createDataFrame(rows, "account string, seq bigint, kind string, amount bigint, arrival int")
    want = {a: folded([r[1:] for r in rows if r[0] == a]) for a in {r[0] for r in rows}}
    got = {r.account: (r.balance, r.last_seq, r.error) for r in ST.replay_ledger(df, ["account"], "arrival").collect()}
    assert got == want
    short = ST.compact_ledger(df, ["account"], "arrival", 4).withColumn("arrival", F.monotonically_increasing_id())
    fine = [a for a, (_, _, e) in want.items() if e is None and min(r[1] for r in rows if r[0] == a) <= 4]
    again = {r.account: (r.balance, r.error) for r in ST.replay_ledger(short, ["account"], "seq").collect()}
    for a in fine:
        if all(sum(1 for r in rows if r[0] == a and r[1] == s) == 1 for s in {r[1] for r in rows if r[0] == a}):
            assert again[a] == (want[a][0], None)


def admitted(times, limit, window):
    held, out = [], []
    for t in times:
        held = [h for h in held if t - h < window]
        if len(held) < limit:
            held.append(t)
            out.append((True, 0.0))
        else:
            out.append((False, held[0] + window - t))
    return out


def test_limiter(spark):
    rnd = random.Random(2)
    calls = sorted({(f"k{rnd.randint(0, 3)}", rnd.randint(0, 60) / 2) for _ in range(150)}, key=lambda x: (x[0], x[1]))
    df = spark.createDataFrame([*calls, (None, 1.0)], "key string, now double")
    got = sorted((r.key, r.now, r.allowed, r.retry_after) for r in ST.limit_rate(df, "key", "now", ["now"], 3, 5.0).collect())
    want = []
    for k in sorted({k for k, _ in calls}):
        times = [t for q, t in calls if q == k]
        want += [(k, t, *a) for t, a in zip(times, admitted(times, 3, 5.0))]
    assert got == want
    assert ST.Limiter(0, 1.0).held == ST.Limiter(1, 1.0).held


def test_backoff(spark):
    delays = ST.backoff_delays(1.0, 2.0, 8.0, 20.0, 10, 42)
    assert delays and sum(delays) <= 20.0 and all(0 <= d <= min(8.0, 2.0**i) for i, d in enumerate(delays))
    assert delays == ST.backoff_delays(1.0, 2.0, 8.0, 20.0, 10, 42) != ST.backoff_delays(1.0, 2.0, 8.0, 20.0, 10, 43)
    df = spark.createDataFrame([(1, 1.0, 2.0, 8.0, 20.0, 10, 42)], "id bigint, base double, factor double, max_delay double, max_elapsed double, max_attempts int, seed bigint")
    assert [r.delay for r in ST.backoff_plans(df).orderBy("attempt").collect()] == delays


def test_graphs(spark):
    edges = [(1, "b", "c"), (1, "a", "c"), (1, "a", "c"), (1, "c", "d"), (2, "x", "y"), (2, "y", "z"), (2, "z", "y"), (2, "z", "z2"), (3, "s", "s"), (4, "q", None)]
    got = {}
    for r in ST.sort_graphs(spark.createDataFrame(edges, "graph int, src string, dst string")).orderBy("graph", "place").collect():
        got.setdefault((r.graph, r.cyclic), []).append(r.node)
    assert got == {(1, False): ["a", "b", "c", "d"], (2, True): ["y", "z"], (3, True): ["s"], (4, False): ["q"]}


def test_rpn(spark):
    rows = ["3 4 +", "7 -2 /", "-7 2 /", "1", "", "1 +", "1 2", "4 0 /", "2 x *", "9223372036854775807 1 +", "5 1 2 + 4 * + 3 -"]
    df = spark.createDataFrame([(i, r.split()) for i, r in enumerate(rows)], "i int, t array<string>")
    got = [(r.value, r.error) for r in df.orderBy("i").select(ST.evaluate_rpn(F.col("t")).alias("r")).select("r.*").collect()]
    assert got == [(7, None), (-3, None), (-3, None), (1, None), (None, "empty"), (None, "stack underflow"), (None, "leftover operands"), (None, "division by zero"), (None, "bad token"), (None, "overflow"), (14, None)]


def test_csv():
    assert parse_csv('a,"b ""x"", c"\r\n,\n"multi\nline",z\rz') == ([["a", 'b "x", c'], ["", ""], ["multi\nline", "z\rz"]], None)
    assert parse_csv("") == ([], None) and parse_csv("a\n") == ([["a"]], None) and parse_csv(",") == ([["", ""]], None) and parse_csv("\n\n") == ([[""], [""]], None)
    assert parse_csv('"a')[1] == "unterminated quoted field" and parse_csv('"a"b')[1] == "unexpected character after quoted field" and parse_csv('a"b')[1] == "quote in unquoted field"


def test_tagged_values():
    for v in (None, True, 1, 1.5, "x", [1, (2, "a")], {1: [True], "k": None, (1, 2): 2.0}):
        assert V.untagged(V.tagged(v)) == v
    assert V.tagged(True) != V.tagged(1) and V.tagged((1,)) != V.tagged([1]) and V.tagged({"a": 1, "b": 2}) == V.tagged({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        V.tagged(float("nan"))
    assert V.tagged([1, ("a",)]) == {"kind": "list", "items": [{"kind": "int", "value": "1"}, {"kind": "tuple", "items": [{"kind": "str", "value": "a"}]}]}
    assert V.tagged({"b": None, "a": True}) == {"kind": "dict", "items": [[{"kind": "str", "value": "a"}, {"kind": "bool", "value": True}], [{"kind": "str", "value": "b"}, {"kind": "none"}]]}
    assert V.untagged({"kind": "list", "items": [{"kind": "ref", "name": "x"}]}, {"x": 7}) == [7]
    made = V.untagged({"kind": "object", "type": "m:T", "fields": {"a": {"kind": "bigint", "value": "12"}}})
    assert made == {"a": 12} and made.type == "m:T"
    for bad in (1, {}, {"kind": "ref", "name": "x"}, {"kind": "bool", "value": 1}, {"kind": "list", "value": []}, {"kind": "dict", "items": [[1]]}, {"kind": "float", "value": "inf"}, {"kind": "int", "value": 1}):
        with pytest.raises(ValueError):
            V.untagged(bad)


def test_closeness():
    n = lambda v, kind="float": {"kind": kind, "value": v}
    assert V.close(n("1.0"), n("1.1"), "0.1") and not V.close(n("1.0"), n("1.11"), "0.1") and V.close(n("1", "int"), n("1.0"), "0")
    assert not V.close(n(" 1"), n("1"), "1") and not V.close(n("inf"), n("inf"), "1") and not V.close(n("1e99999"), n("1e99999"), "1") and not V.close(V.tagged("1"), n("1"), "1")
    assert V.close(n("0." + "0" * 500 + "1"), n("0"), "0.1") and not V.close(n("1" + "0" * 400), n("1" + "0" * 399 + "1"), "0")
    assert V.close_within(V.tagged([1.0, {"a": 2.0}]), V.tagged([1.05, {"a": 2.0}]), "0.1") and not V.close_within(V.tagged([1.0]), V.tagged([1.0, 2.0]), "1")


def test_what_can_be_compared():
    n = lambda v, kind="float": {"kind": kind, "value": v}
    want = lambda v, how="close", tolerance=0.5: {"compare": how, "value": v, "absolute": tolerance}
    assert V.matches(want(n("1")), n("1.5")) and not V.matches(want(n("1")), n("1.51")) and V.matches(want(n("1"), tolerance=0), n("1.0"))
    for odd in (want(n("1"), "near"), want(n("1"), None), want(n("1"), tolerance=5), want(n("1"), tolerance=-0.1), want(n("1"), tolerance=True), want(n("1"), tolerance="0.5"), {"compare": "close", "value": n("1")}):
        assert not V.matches(odd, n("1")) and not V.matches(odd, odd)
    assert not V.close(n("1.5", "int"), n("1.5"), "1") and not V.close(n("01", "bigint"), n("1"), "1") and not V.close({"kind": "float", "value": 1.0}, n("1"), "1")
    assert V.close(n("-0", "int"), n("0"), "0") and V.close(n("1e9999"), n("1e9999"), "0") and not V.close(n("4e-19"), n("0"), "0")
    deep = lambda x, s="a": {"kind": "list", "items": [n(x), {"kind": "str", "value": s}]}
    assert V.matches(want(deep("1"), "close_recursive"), deep("1.2")) and not V.matches(want(deep("1"), "close_recursive"), deep("1", "b")) and not V.matches(want(deep("1")), deep("1"))
    assert V.matches(n("1"), n("1")) and not V.matches(n("1"), n("1.0"))
    assert not V.close_within({"a": 1}, {"a": True}, "1") and not V.close_within({"a": 1}, {"b": 1}, "1") and V.close_within([None, "x"], [None, "x"], "0")


def test_verdicts(spark):
    ok = lambda **v: json.dumps({"status": "ok", "values": {k: V.tagged(x) for k, x in v.items()}})
    error = lambda **e: json.dumps({"status": "error", "operation": 1, "error": {"type": "E", "message": "m"}} | e)
    wants = json.dumps({"status": "error", "operation": 1, "type": "E"})
    near = json.dumps({"status": "ok", "values": {"a": {"compare": "close", "value": V.tagged(1.0), "absolute": 0.1}}})
    rows = [
        (ok(a=1), ok(a=1), None), (ok(a=1), ok(a=1.0), "a differs"), (ok(a=1), ok(b=1), "names differ"), (ok(a=1), error(), "status differs"), (wants, error(), None),
        (wants, error(operation=2), "operation differs"), (wants, error(error={"type": "F"}), "type differs"), (near, ok(a=1.05), None), (near, ok(a=1.2), "a differs"), (ok(a=1), None, "not JSON"),
        (wants, json.dumps({"status": "error", "operation": 1}), "error has no shape"), (ok(a=1), '{"status":"ok"}', "values have no shape"), ("[]", ok(), "expected outcome has no shape"), (ok(a=[1, {"k": 2}]), ok(a=[1, {"k": 2}]), None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e string, r string, want string")
    got = df.withColumn("why", V.case_failure("e", "r"))
    assert [(r.i, r.why) for r in got.orderBy("i").collect()] == [(i, w) for i, (_, _, w) in enumerate(rows)]
    reward = V.case_reward(got.withColumn("ok", F.col("why").isNull()), [], "ok").first()
    assert (reward.passed, reward.total) == (4, 14)
    order = V.after_failure(spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False)], "k string, i int, f boolean"), ["k"], ["i"], F.col("f"))
    assert sorted((r.k, r.i) for r in order.where("not_run").collect()) == [("a", 3)]


def test_status_of_cases(spark):
    rows = [("a", 1, False, 4.0), ("a", 2, True, 1.0), ("a", 3, True, None), ("b", 1, False, 6.0), ("b", 2, None, 6.0), ("b", 3, True, 0.0), ("b", 4, False, 0.0)]
    df = spark.createDataFrame(rows, "k string, i int, f boolean, s double")
    got = {(r.k, r.i): r.status for r in V.case_status(df, ["k"], ["i"], F.col("f"), F.col("s"), 10.0).collect()}
    ran, stopped, late = "ran", "not run after candidate failure", "verifier deadline exceeded"
    assert got == {("a", 1): ran, ("a", 2): ran, ("a", 3): stopped, ("b", 1): ran, ("b", 2): ran, ("b", 3): late, ("b", 4): late}


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"a":{"x":1,"y":[1]},"b":2}', '{"a":{"y":null,"z":3}}'), ("[]", "{}"), (None, "{}")], "a string, b string")
    assert [r[0] for r in df.select(V.overlay_json("a", "b")).collect()] == ['{"a":{"x":1,"y":null,"z":3},"b":2}', None, None]
    paths = spark.createDataFrame([('{"a":[{"b":0},null]}', p, "F") for p in ("a.0.b", "a.1", "a.5", "a.x", "q", "a.0")], "v string, p string, f string")
    assert [r[0] for r in paths.select(V.deep_get("v", "p", "f")).collect()] == ["0", "F", "F", "F", "F", '{"b":0}']
    shapes = spark.createDataFrame([(x,) for x in ("[[1]]", "[[[1]]]", "[1,2,3,4,5,6]", "[NaN]", "x", None)], "x string")
    assert [r[0] for r in shapes.select(V.shape_faults(2, 6)("x")).collect()] == [None, "too deep", "too large", "not finite", "not JSON", "missing"]
    schema = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 3}, "s": {"type": "string"}}, "required": ["n"]}
    for arguments, why in (({"n": 1}, None), ({}, "missing argument n"), ({"n": True}, "n is no integer"), ({"n": 4}, "n is out of bounds"), ({"n": 1, "z": 1}, "unknown argument z"), ({"n": 1, "s": 1}, "s is no string")):
        assert V.argument_faults(schema, arguments) == why
    assert V.argument_faults({"type": "array"}, {}) == "schema is not an object"
    of = lambda **p: {"type": "object", "properties": p}
    cases = [
        (of(n={"type": "number", "minimum": 1}), {"n": 0}, "n is out of bounds"), (of(n={"type": "number", "minimum": 1}), {"n": 0.5}, None), (of(n={"type": "integer", "maximum": 1.5}), {"n": 2}, None),
        (of(n=True), {"n": 0}, "type of n is missing"), (of(n={}), {"n": 0}, "type of n is missing"), (of(n={"type": "array"}), {"n": []}, "type of n is unknown"), ({"type": "object"}, {}, "properties are missing"),
        (of() | {"required": [1]}, {}, "required is no list of names"), (of(), {"z": 1}, "unknown argument z"), (of() | {"required": ["q"]}, {"z": 1}, "missing argument q"), (of() | {"additionalProperties": False}, {"z": 1}, "unknown argument z"), (of() | {"additionalProperties": False, "required": ["q"]}, {"z": 1}, "unknown argument z"),
        (of(b={"type": "boolean"}), {"b": 1}, "b is no boolean"), (of(n={"type": "integer"}), {"n": 1.0}, "n is no integer"), (of(n={"type": "number"}), {"n": True}, "n is no number"), ([], {}, "schema is not an object"),
    ]
    for schema, arguments, why in cases:
        assert V.argument_faults(schema, arguments) == why
    texts = spark.createDataFrame([(json.dumps(s), json.dumps(a)) for s, a, _ in cases] + [("{", "{}"), (None, "{}"), (json.dumps(of()), "[]")], "s string, a string")
    assert [r[0] for r in texts.select(V.argument_fault("s", "a")).collect()] == [w for _, _, w in cases] + ["schema is no JSON", "missing", "arguments are no object"]


def test_budgets(spark):
    df = spark.createDataFrame([("e", i, 4) for i in range(4)], "e string, i int, t int")
    assert [(r.spent, r.stopped, r.over) for r in over_budget(df, ["e"], ["i"], "t", F.lit(8)).orderBy("i").collect()] == [(4, False, False), (8, False, False), (12, True, True), (16, True, True)]


def streamed(spark, tmp_path, schema, batches, make):
    """What a query over files, one file a batch, gives in all."""
    source, name = tmp_path / "in", f"out_{tmp_path.name}"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_limiter(spark, tmp_path):
    rows = streamed(spark, tmp_path, "k string, t double", [[{"k": "a", "t": 0.0}, {"k": "a", "t": 1.0}, {"k": "b", "t": 1.0}], [{"k": "a", "t": 2.0}, {"k": "a", "t": 10.0}]], lambda s: SS.stream_limiter(s, "k", "t", 2, 10.0))
    assert sorted((r.key, r.now, r.allowed, r.retry_after) for r in rows) == [("a", 0.0, True, 0.0), ("a", 1.0, True, 0.0), ("a", 2.0, False, 8.0), ("a", 10.0, True, 0.0), ("b", 1.0, True, 0.0)]


def test_stream_ledger(spark, tmp_path):
    e = lambda a, s, k, m: {"a": a, "seq": s, "kind": k, "amount": m}
    batches = [[e("x", 1, "deposit", 5), e("x", 2, "withdraw", 3), e("y", 1, "withdraw", 1)], [e("x", 2, "withdraw", 3), e("x", 1, "deposit", 5), e("x", 4, "deposit", 1), e("y", 2, "deposit", 9)]]
    rows = streamed(spark, tmp_path, "a string, seq bigint, kind string, amount bigint", batches, lambda s: SS.stream_ledger(s, "a"))
    assert sorted((r.account, r.seq, r.balance, r.error) for r in rows) == [("x", 1, 5, None), ("x", 2, 2, None), ("x", 4, 3, None), ("y", 1, 0, "insufficient funds")]


@pytest.fixture
def tiny_frames(spark):
    """Frames of two rows from the shuffle."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_streams_in_many_frames(spark, tmp_path, tiny_frames):
    """A batch's rows count in order, though they come unsorted and in frames."""
    rnd = random.Random(3)
    events = [{"a": a, "seq": s, "kind": rnd.choice(["deposit", "deposit", "withdraw"]), "amount": rnd.randint(1, 9)} for a in "xyz" for s in range(40)]
    rnd.shuffle(events)
    (tmp_path / "l").mkdir()
    rows = streamed(spark, tmp_path / "l", "a string, seq bigint, kind string, amount bigint", [events], lambda s: SS.stream_ledger(s.repartition(3), "a"))
    for a in "xyz":
        last = max((r for r in rows if r.account == a), key=lambda r: r.seq)
        balance, _, error = folded([(e["seq"], e["kind"], e["amount"], e["seq"]) for e in events if e["a"] == a])
        assert (last.balance, last.error) == (balance, error)
    times = [float(t) for t in range(60)]
    calls = [{"k": k, "t": t} for k in "pq" for t in times]
    rnd.shuffle(calls)
    (tmp_path / "m").mkdir()
    rows = streamed(spark, tmp_path / "m", "k string, t double", [calls], lambda s: SS.stream_limiter(s.repartition(3), "k", "t", 2, 10.0))
    assert sorted((r.key, r.now, r.allowed, r.retry_after) for r in rows) == [(k, t, *a) for k in "pq" for t, a in zip(times, admitted(times, 2, 10.0))]


def test_rows_in_order_beyond_memory():
    rnd = random.Random(4)
    frames = [pd.DataFrame([(rnd.randint(0, 50), i * 3 + k) for k in range(3)], columns=["seq", "n"]) for i in range(200)]
    want = list(pd.concat(frames).sort_values("seq", kind="stable").itertuples(index=False, name=None))
    for most_rows, most_runs in ((1000, 32), (6, 3), (7, 2)):
        assert list(SS.in_order(iter(frames), ["seq", "n"], most_rows, most_runs)) == want
    assert list(SS.in_order(iter([]), ["seq", "n"])) == []


def test_stream_budget_and_windows(spark, tmp_path):
    rows = streamed(spark, tmp_path, "e string, t bigint", [[{"e": "a", "t": 4}, {"e": "a", "t": 4}], [{"e": "a", "t": 4}]], lambda s: SS.stream_budget(s, "e", "t", 8))
    assert sorted((r.spent, r.stopped) for r in rows) == [(4, False), (8, False), (8, True)]
    (tmp_path / "w").mkdir()
    at = [[{"ts": "2026-01-01T00:01:00", "k": "a"}, {"ts": "2026-01-01T00:02:00", "k": "a"}], [{"ts": "2026-01-01T01:00:00", "k": "a"}], [{"ts": "2026-01-01T01:01:00", "k": "a"}], [{"ts": "2026-01-01T00:03:00", "k": "a"}, {"ts": "2026-01-01T02:00:00", "k": "b"}]]
    counts = streamed(spark, tmp_path / "w", "ts timestamp, k string", at, lambda s: SS.windowed_counts(s, "ts", ["k"], "5 minutes"))
    assert sorted((str(r.window_start), r.k, r.n) for r in counts) == [("2026-01-01 00:00:00", "a", 2), ("2026-01-01 01:00:00", "a", 2)]


def test_stream_first_per_key(spark, tmp_path):
    row = lambda minute, k, v: {"ts": f"2026-01-01T00:{minute:02d}:00", "k": k, "v": v}
    rows = streamed(spark, tmp_path, "ts timestamp, k string, v int", [[row(1, "a", 1), row(1, "b", 2)], [row(2, "a", 3), row(3, "c", 4)]], lambda s: SS.first_per_key(s, ["k"], "ts"))
    assert sorted((r.k, r.v) for r in rows) == [("a", 1), ("b", 2), ("c", 4)]


def test_stream_of_capped_calls(spark, tmp_path):
    row = lambda e, d: {"e": e, "d": d}
    rows = streamed(spark, tmp_path, "e string, d string", [[row("a", "x"), row("b", "x")], [row("a", "x")], [row("a", "y"), row("b", "x")], [row("a", "x")]], lambda s: SS.capped_calls(s, "e", "d", 3))
    assert sorted((r.episode, r.call, r.digest, r.cached, r.refused) for r in rows) == [("a", 1, "x", False, False), ("a", 2, "x", True, False), ("a", 3, "x", False, True), ("a", 3, "y", False, False), ("b", 1, "x", False, False), ("b", 2, "x", True, False)]
