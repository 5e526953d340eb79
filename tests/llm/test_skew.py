"""A third of all rows under one key, source, length or text: whole results, through the same operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.llm.test_trace_operators import SCHEMA
from tracemill.llm.conversations import rebuild_conversations
from tracemill.llm.leaks import find_leaks
from tracemill.llm.mixing import Mixture
from tracemill.llm.neardup import NearDuplicates
from tracemill.llm.overlap import find_overlaps
from tracemill.llm.runs import near_repeated_turns, repeated_turns
from tracemill.tables import load

N = 3000


@pytest.fixture(scope="module")
def own_words(spark):
    """Rows whose texts share nothing, but for a third with a long common opening."""
    tail = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), (F.xxhash64("id", i) % 100_000).cast("string"))), " ")
    opening = F.when(F.col("id") % 3 == 0, F.lit(" ".join(f"same{i}" for i in range(25)) + " ")).otherwise("")
    return spark.range(N).select("id", F.concat(opening, tail).alias("text"))


def test_a_common_opening_is_no_seed(spark, own_words):
    pairs = spark.createDataFrame([(N, 0), (N + 1, 3)], "id bigint, of bigint").join(own_words.withColumnRenamed("id", "of"), "of").select("id", F.concat("text", F.lit(" end")).alias("text"))
    rows = own_words.unionByName(pairs)
    found = NearDuplicates(rows.select("id", F.array("text").alias("texts")), "id", "texts", 0.7, 3)
    assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == {(0, N), (3, N + 1)}
    assert found._candidates().count() < 50
    records = rows.select(F.col("id").alias("record_id"), F.lit(0).alias("field"), (F.col("id") >= N).alias("held"), "text")
    assert {(r.record_id_held, r.record_id_train) for r in find_overlaps(records, 0.7, 3).collect()} == {(N, 0), (N + 1, 3)}


def test_a_third_of_all_rows_are_copies(spark, own_words):
    copies = own_words.withColumn("text", F.when(F.col("id") % 3 == 0, F.lit(" ".join(f"copy{i}" for i in range(20)))).otherwise(F.col("text")))
    found = NearDuplicates(copies.select("id", F.array("text").alias("texts")), "id", "texts", 0.7, 3)
    assert found._candidates().count() == 0
    groups = found.groups().groupBy("group_id").count().where("count > 1").collect()
    assert [(r.group_id, r["count"]) for r in groups] == [(0, N // 3)]
    assert found.pairs().count() == N // 3 * (N // 3 - 1) // 2
    item = spark.createDataFrame([(1, " ".join(f"copy{i}" for i in range(15)))], "item_id bigint, text string")
    for size in (1 << 24, 0):
        assert find_leaks(copies.withColumnRenamed("id", "doc_id"), item, broadcast_bytes=size).count() == N // 3


def test_one_trace_holds_a_third_of_all_rows(spark):
    start = dt.datetime(2026, 1, 1)
    rows, spellings = [], load(spark, "/root/testdata/sf0.001", "spellings")

    def add(trace, node, role, content="x", calls=None, answers=None):
        rows.append((len(rows), trace, "t", "r", node, node - 1 if node else None, role, content, calls, answers, False, start + dt.timedelta(seconds=node), start))

    for trace, turns in [("hot", N // 2)] + [(f"t{k}", 3) for k in range(N // 4)]:
        add(trace, 0, "user")
        for k in range(turns):
            add(trace, 2 * k + 1, "assistant", "", json.dumps([{"id": f"c{k}", "name": "f", "arguments": {"path": f"p{k // 5}"}}]))
            add(trace, 2 * k + 2, "tool", "y", None, f"c{k}")
        add(trace, 2 * turns + 1, "assistant")
    frame = spark.createDataFrame(rows, SCHEMA)
    again = frame.where("trace_id = 'hot' and node = 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(N)))).withColumn("msg_id", -F.col("i").cast("bigint")).drop("i")
    frame = frame.unionByName(again)
    assert rebuild_conversations(frame, spellings).count() == len(rows)
    runs = repeated_turns(frame, spellings)
    assert runs.where("trace_id = 'hot'").count() == N // 10 and runs.where("trace_id <> 'hot' and n_turns = 3").count() == N // 4
    assert near_repeated_turns(frame, spellings).agg(F.sum("n_turns")).first()[0] == N // 2 + 3 * (N // 4)


def test_a_third_of_all_documents_have_one_length(spark):
    docs = spark.range(N).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"), F.expr("repeat('word ', if(id % 3 = 0, 5, 1 + cast(id % 50 as int)))").alias("text"))
    mix = Mixture(docs, spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], "source string, weight double, max_repeats int"))
    assert all(abs(r.share - r.target_share) < 0.001 for r in mix.shares().collect())
