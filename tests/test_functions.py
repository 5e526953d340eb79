"""Scalar functions, digests and strict JSON."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import digests as D
from tracemill.functions import scalars as S
from tracemill.functions import strict_json as J


def one(spark, column, *values):
    """The results of an expression over a column ``x`` of strings."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column.alias("y"), "i").orderBy("i").select("y").collect()]


@pytest.fixture(autouse=True)
def _column(spark):
    """``X`` is the column ``x``, made only when a session is there."""
    globals()["X"] = F.col("x")




def test_texts(spark):
    assert one(spark, S.slugify(X), "  Hello, Wörld! ", "--a--B--", "!!", "", None) == ["hello-w-rld", "a-b", "", "", None]
    assert one(spark, S.words(X), "It's 2 Late", "", None) == [["it", "s", "2", "late"], [], None]
    coded = one(spark, S.rle_encode(X), "aaab", "", "x", "zzzzzzzzzzzz")
    assert coded == ["3a1b", "", "1x", "12z"]
    assert one(spark, S.rle_encode(X), "a\0b", "\0\0", "a\n\nb", "😀😀é", None) == ["1a1\x001b", "2\0", "1a2\n1b", "2😀1é", None]
    assert one(spark, S.rle_decode(X), *coded, "3", "a3", "2a3", None) == ["aaab", "", "x", "z" * 12, None, None, None, None]
    assert one(spark, S.replace_once(X, F.lit("ab"), F.lit("-")), "xaby", "abab", "none", "") == ["x-y", None, None, None]
    assert one(spark, S.numbered_lines(X, 2, 2), "a\nb\nc\nd", "a", "") == [("2:b\n3:c", 4, True), ("", 1, False), ("", 1, False)]


def test_maps(spark):
    assert one(spark, S.query_string(X), "?a=1&b=&&c&a=2%20x+y&d=e=f", "", "?") == [{"b": "", "c": "", "a": "2 x+y", "d": "e=f"}, {}, {}]
    many = "&".join(f"k{i % 700}={i}" for i in range(2000))
    assert one(spark, S.query_string(X), many, None) == [{f"k{i}": str(i + 1400 if i < 600 else i + 700) for i in range(700)}, None]
    assert one(spark, S.parse_fields(X, "|"), " a | 1 \n\nb|x|y\nno\na|2") == [{"b": "x|y", "a": "2"}]
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4})], "x map<string,int>, y map<string,int>")
    assert df.select(S.merge_counts(F.col("x"), F.col("y"))).first()[0] == {"a": 1, "b": 5, "c": 4}


def test_numbers(spark):
    assert one(spark, S.convert_temperature(X), "212F", "-40C", "100C", "33F", "1.5F", "12", "12F ", "", None) == ["100C", "-40F", "212F", "1C", "invalid", "invalid", "invalid", "invalid", None]
    assert one(spark, S.fizzbuzz(X.cast("int")), "1", "3", "5", "15", "0", None)[:5] == ["1", "Fizz", "Buzz", "FizzBuzz", "FizzBuzz"]
    kinds = one(spark, S.coerce_cell(X), " 7 ", "7.0", "007", "-0", "1e3", "+1", "", None, "-1.50", "0.5", ".5")
    assert [k["t"] for k in kinds] == ["int", "float", "str", "int", "str", "str", "null", "null", "float", "float", "str"]
    long, other = "1" * 40, "2" * 40
    cells = one(spark, S.coerce_cell(X), "\t7\n", "\u00a07\u2003", "-0", long, other, "7 7")
    assert [(c["t"], c["i"]) for c in cells] == [("int", "7"), ("int", "7"), ("int", "0"), ("int", long), ("int", other), ("str", None)]
    assert one(spark, S.decimal_close(X, F.lit("1.0"), "0.1"), "1.1", "1.11", "x", None) == [True, False, None, None]
    assert one(spark, S.decimal_close(X, F.lit("0"), "0"), "4e-19", "0.0", "-0", "0." + "0" * 30 + "1", "nan", "") == [False, True, True, False, None, None]
    assert one(spark, S.decimal_close(X, F.lit("1" + "0" * 25), "1"), "1" + "0" * 24 + "1", "1" + "0" * 24 + "2", "1e25", "1" + "0" * 25 + ".5") == [True, False, True, True]
    assert one(spark, S.decimal_close(X, F.lit("0"), 1e-20), "0.00000000000000000001", "0.000000000000000000011") == [True, False]


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([],), ([5],)], "x array<int>")
    got = df.select(S.window_sums(F.col("x"), 2), S.rotate_right(F.col("x"), 5), S.rotate_right(F.col("x"), -1)).collect()
    assert [list(r) for r in got] == [[[3, 5, 7], [4, 1, 2, 3], [2, 3, 4, 1]], [[], [], []], [[], [5], [5]]]
    with pytest.raises(ValueError):
        S.window_sums(F.col("x"), 0)
    masks = spark.createDataFrame([([9, 1, 2, 9, 3], 1), ([1, 2], 0), ([9], 5)], "t array<int>, s int")
    assert [r[0] for r in masks.select(S.span_mask(F.col("t"), F.col("s"), 9)).collect()] == [[False, True, True, True, False], [False, False], [False]]
    pads = spark.createDataFrame([(0,), (1,), (32,), (33,), (9000,)], "n int")
    assert [r[0] for r in pads.select(S.pad_bucket(F.col("n"), 512)).collect()] == [1, 33, 33, 65, 512]
    assert spark.range(1).select(S.pad(F.array(F.lit(1), F.lit(2)), F.lit(4), F.lit(0))).first()[0] == [1, 2, 0, 0]
    means = spark.createDataFrame([(1.0, True), (5.0, False), (3.0, True), (9.0, None)], "v double, m boolean")
    assert means.agg(S.masked_mean(F.col("v"), F.col("m"))).first()[0] == 2.0
    assert means.limit(0).agg(S.masked_mean(F.col("v"), F.col("m"))).first()[0] is None


def test_predicates(spark):
    urls = ["https://a.b/c", "http://a.b", "http://127.0.0.1:80/v1", "https://u@a.b", "https://a.b?q", "https://a.b#f", "https://a.b:0", "https://a.b:70000", "ftp://a.b", "nothing", "", None]
    assert one(spark, S.is_base_url(X), *urls) == [True, False, True] + [False] * 9
    assert one(spark, S.is_plain_path(X), "a/b.c", "/a", "a//b", "../a", "a/./b", "", None) == [True] + [False] * 6


def test_digests(spark):
    def frame(b):
        return len(b).to_bytes(8, "big") + b

    want = hashlib.sha256(b"d\0" + frame("é".encode()) + frame(b"")).hexdigest()
    assert spark.range(1).select(D.framed_digest("d", F.array(D.framed(F.lit("é")), D.framed(F.lit(""))))).first()[0] == want
    drawn = 3 + int.from_bytes(hashlib.sha256(b"7:size").digest()[:8], "big") % 5
    assert spark.range(1).select(D.draw(F.lit(7), "size", 3, 7)).first()[0] == drawn
    assert one(spark, D.canonical_json(X), '{"b": 1.50, "a": [1e3, "é"]}', '{"a":1} x', None) == ['{"a":[1000.0,"é"],"b":1.5}', None, None]
    assert one(spark, D.call_signature(F.lit("f"), X), '{"b":1,"a":2}', '{"a":2,"b":1}', "[]", "x") == ['{"arguments":{"a":2,"b":1},"name":"f"}'] * 2 + [None, None]
    a = D.tree_digest([("a", None), ("a/b", b"x")], "t")
    assert a == D.tree_digest([("a/b", b"x"), ("a", None)], "t") != D.tree_digest([("a/b", b"y"), ("a", None)], "t")
    tree = [("a", None), ("a/x", b"1"), ("b", None), ("b/c", None), ("b/c/z", b"2"), ("b/d", None), ("b/d/z", b"3"), ("b/a", b"4"), ("c", b"5")]
    assert [p for p, _ in D.tree_order(reversed(tree))] == ["a", "b", "c", "b/a", "b/c", "b/d", "b/d/z", "b/c/z", "a/x"]


def test_strict_json(spark):
    value = J.parse_one(X)
    assert one(spark, J.kind(value), "1", "1.0", "true", "null", '"x"', "[]", "{}", "{} x", "{},{}", "", "nope", None) == ["integer", "number", "boolean", "null", "string", "array", "object", None, None, None, None, None]
    assert one(spark, J.integer(value), "1", "2.0", "2.5", "true", '"1"', "null") == [1, 2, None, None, None, None]
    assert one(spark, J.number(value), "1.5", "true", "3") == [1.5, None, 3.0]
    assert one(spark, J.is_true(value), "true", "1", "false", "null", '"true"', "x") == [True] + [False] * 5
    assert one(spark, F.to_json(J.arguments(value)), '{"a":1}', json.dumps('{"a": 1}'), "[]", '"x"', "null") == ['{"a":1}', '{"a":1}', None, None, None]
    texts = ['"x"', '[{"type":"text","text":"a"},{"type":"text","text":"b"}]', "[]", '[{"type":"image"}]', "5", "null"]
    assert one(spark, J.flat_text(value), *texts) == ["x", "a\nb", "", None, None, None]
    assert one(spark, J.flat_text(J.at(value, "$.content")), "{}", '{"content":"  line"}') == ["", "  line"]


def test_names(spark):
    assert one(spark, S.fits(X, S.TASK_ID), "a/b", "ab", "A/b", "a" * 128, "a" * 129, "abc\n", "", None) == [True, False, False, True, False, False, False, False]
    assert one(spark, S.fits(X, S.LICENSE), "MIT", "Apache-2.0", "GPL-2.0+", "MIT or", "-", None) == [True, True, True, False, False, False]
    assert one(spark, S.fits(X, S.CASE_ID), "c1", "a.b_c-d", "a/b", "A") == [True, True, False, False]
