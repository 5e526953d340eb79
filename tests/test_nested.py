"""The structural index against the json module, and the flat tables."""

import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.operators.nested import OPEN_OBJECT, SCALAR, STRING, JsonIndex, _bytes, trace_children, trace_tables
from tracemill.functions.wordhash import text_bytes
from tracemill.tables import load

TEXTS = [
    '{"a":[1,2,{"b":null}],"c":"x\\"y","d":1.5e3}', "[]", "{}", '"s"', "12", "tru", "true", '{"a":1,}', "[1,]", "[,1]", '{"a" 1}', '{"a":1 "b":2}', "[1 2]", '{"a":}', "}{", "[}", "{]",
    '"\\u12g4"', '"\\x"', '"a\nb"', '  {"a" : [ ] } ', '{"a":1}x', '{"a":1}{}', "", "   ", "01", "-", "1.", "nul", '"a""b"', '[["a"]["b"]]', '{"a":{"b":{"c":[[[]]]}}}', '{"a":"\\\\"}', '{"a\\u0062":1}',
    "[1,2", '"', "\\", '[\\"a"]', '{"k":"v"}}', "{1:2}", "[true,false,null,-0.5,1E5]", "[:1]", '{"a"::1}', "é", '["é\\n"]', '"\\', "]", '{"a":1,"a":[2]}', "﻿{}", '["\\ud83d\\ude00"]',
]


def loads(text):
    def no(name):
        raise ValueError(name)

    return json.loads(text, parse_constant=no)


def is_json(text):
    try:
        loads(text)
        return True
    except (ValueError, RecursionError):
        return False


def rebuilt(ix, value):
    """A value put together again from the index."""
    kind = ix.kind[value]
    if kind >= STRING:
        return json.loads(ix.text(value))
    child, _ = ix.children(pa_array([value]))
    if kind == OPEN_OBJECT:
        return {ix.name(c): rebuilt(ix, c) for c in child.tolist()}
    assert ix.place[child].tolist() == list(range(len(child)))
    return [rebuilt(ix, c) for c in child.tolist()]


def pa_array(values):
    import numpy as np

    return np.array(values)


def check(texts):
    ix = JsonIndex(*_bytes(pa.array(texts, pa.string())))
    want = [is_json(t) for t in texts]
    assert [(t, w) for t, w, g in zip(texts, want, ix.valid.tolist()) if w != g] == []
    for root in ix.roots().tolist():
        assert rebuilt(ix, root) == loads(texts[ix.doc[root]])
        assert json.loads(ix.text(root)) == loads(texts[ix.doc[root]])


def test_index_of_odd_texts():
    check(TEXTS)
    for t in TEXTS:
        check([t])


def test_index_of_broken_texts():
    rnd, texts = random.Random(1), []
    for t in TEXTS:
        for _ in range(200):
            s = list(t) or [" "]
            k = rnd.randrange(len(s))
            s[k : k + rnd.randint(0, 1)] = rnd.choice(["", '{', "}", "[", "]", ":", ",", '"', "\\", " ", "a", "1", "n"])
            texts.append("".join(s))
    texts += ["".join(rnd.choice('{}[]:,"\\ a1e.-n') for _ in range(rnd.randint(0, 12))) for _ in range(20_000)]
    rnd.shuffle(texts)
    check(texts)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, max_size=6), st.sampled_from([None, 1]), st.booleans())
def test_index_of_any_value(values, indent, escape):
    check([json.dumps(v, indent=indent, ensure_ascii=escape).encode("utf-8", "replace").decode() for v in values])


def test_deep_and_long_texts():
    check(["[" * 900 + "]" * 900, "[" * 900, '{"a":"' + "x" * 2_000_000 + '"}', "[" + ",".join(map(str, range(50_000))) + "]"])
    deep = "[" * 200_000 + "]" * 200_000
    assert JsonIndex(*_bytes(pa.array([deep]))).valid.tolist() == [True]


def children(payload):
    """TESTDATA.md's rules, read line by line."""
    if payload is None or not is_json(payload):
        return
    value = loads(payload)
    if not isinstance(value, dict) or not isinstance(value.get("traces"), list):
        return

    def meant(x):
        if isinstance(x, str):
            return loads(x) if is_json(x) else None
        return x

    def elements(x):
        return x if isinstance(x, list) else [x] if isinstance(x, dict) else []

    def leaves(x, path):
        if isinstance(x, (dict, list)):
            for k, y in x.items() if isinstance(x, dict) else enumerate(x):
                yield from leaves(y, [*path, str(k)])
        elif x is not None:
            yield ".".join(path)

    for i, trace in enumerate(value["traces"]):
        if not isinstance(trace, dict):
            continue
        rewards = meant(trace.get("rewards"))
        if isinstance(rewards, dict):
            yield from ((i, "reward", k) for k, v in rewards.items() if v is not None)
        elif isinstance(rewards, list):
            yield from ((i, "reward", x["name"]) for x in rewards if isinstance(x, dict) and isinstance(x.get("name"), str))
        metrics = meant(trace.get("metrics"))
        if isinstance(metrics, (dict, list)):
            yield from ((i, "metric", k) for k in leaves(metrics, []))
        for k, call in enumerate(elements(meant(trace.get("calls")))):
            if isinstance(call, dict):
                yield i, "call", str(k)
                sampling = meant(call.get("sampling"))
                if isinstance(sampling, dict):
                    yield from ((i, "stop_rule", f"{k}.{n}") for n, rule in enumerate(elements(sampling.get("stop_rules"))) if rule is not None)


def found(df):
    return Counter((r.record_id, r.trace_pos, r.child, r.child_key) for r in trace_children(df).collect())


def test_children_of_the_small_table(spark, small):
    df = load(spark, small, "trace_records")
    assert found(df) == Counter((r.record_id, *c) for r in df.collect() for c in children(r.payload))


ODD = [
    None, "", "null", "[]", '{"traces":{}}', '{"traces":[]}', '{"traces":[null,"x",{}]}', '{"traces":[{"rewards":{"a":1,"a":null,"b":0}}]}',
    '{"traces":[1],"traces":[{"rewards":"{\\"t\\":{\\"score\\":1}}"}]}', '{"traces":[{"rewards":[{"name":"n","score":1},{"name":null},null,3,{"name":"n"}]}]}',
    '{"traces":[{"metrics":[1,{"a":[true,null]}],"calls":{"sampling":"{\\"stop_rules\\": [null, \\"s\\", {}]}"}}]}',
    '{"traces":[{"calls":"[{\\"sampling\\":\\"{\\\\\\"stop_rules\\\\\\":{\\\\\\"text\\\\\\":1}}\\"},null,{}]","metrics":"not json"}]}',
    '{"traces":[{"metrics":{"a\\u002eb":{"é":"x"},"e":{},"":1}}]} ', '{"traces":[{"metrics":"5","rewards":"\\"x\\"","calls":7}]}', '{"traces":[{"rewards":{}}]}{}', '{"tr\\u0061ces":[{"rewards":{"q":1}}]}',
]


def test_children_of_odd_payloads(spark):
    rows = [(i, p, "c", 0) for i, p in enumerate(ODD)]
    df = spark.createDataFrame(rows * 2, "record_id bigint, payload string, child string, trace_pos int")
    assert found(df) == Counter((i, *c) for i, p, *_ in rows * 2 for c in children(p))
    assert trace_children(df.limit(0)).count() == 0


def test_halves_of_characters(spark):
    payload = '{"traces":[{"rewards":{"\\ud800":1},"metrics":"{\\"\\\\udc00\\":1}","calls":"\\ud800"}]}'
    assert is_json(payload)
    df = spark.createDataFrame([(1, payload)], "record_id bigint, payload string")
    assert found(df) == Counter({(1, 0, "reward", "?"): 1, (1, 0, "metric", "?"): 1})


def test_tables(spark):
    payload = '{"traces":[{"rewards":{"t":{"score":0.5,"weight":2},"u":1},"metrics":{"a":{"b":"x"},"c":3},"calls":[null,{"finish_reason":"stop","usage":{"completion_tokens":7},"sampling":{"stop_rules":[{"text":"w","after":2}]}}]}]}'
    t = {k: [tuple(r) for r in v.collect()] for k, v in trace_tables(spark.createDataFrame([(4, payload)], "record_id bigint, payload string")).items()}
    assert sorted(t["rewards"]) == [(4, 0, "t", 0.5, 2.0), (4, 0, "u", 1.0, None)]
    assert sorted(t["metrics"]) == [(4, 0, "a.b", None, '"x"'), (4, 0, "c", 3.0, "3")]
    assert t["calls"] == [(4, 0, 1, "stop", 7)]
    assert t["stop_rules"] == [(4, 0, 1, 0, "w", 2, None)]


def test_scalar_is_a_kind():
    assert SCALAR > STRING


def test_any_depth():
    """Parents are right however deep a text is."""
    n = (1 << 20) + 5
    texts = pa.array(["[" * n + "[1],[2]" + "]" * n, '{"a":[1]}'])
    index = JsonIndex(*text_bytes(texts, False))
    assert index.valid.all()
    deep = np.flatnonzero((index.doc == 0) & (index.kind == SCALAR))
    one, two = index.parent[deep]
    assert one != two and index.parent[one] == index.parent[two] and index.place[two] == 1
