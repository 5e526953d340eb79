"""Queries p1 to p9 (but p6) over the tables of a data folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.chunking import split_oversized
from tracemill.llm.conversations import rebuild_conversations
from tracemill.llm.leaks import find_leaks
from tracemill.llm.mixing import Mixture
from tracemill.llm.neardup import NearDuplicates
from tracemill.llm.overlap import find_overlaps
from tracemill.llm.runs import near_repeated_turns, repeated_turns
from tracemill.llm.splits import assign_splits, related_groups, task_entities
from tracemill.tables import load, spelled

#: What TESTDATA.md sets: triples of words, and the share in which alike sets agree.
TRIPLE, ALIKE = 3, 0.7
FIELDS = ("prompt", "definition_source")
ENTITIES = ["family", "task"]


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tasks = spelled(load(spark, d, "tasks"), "split", load(spark, d, "spellings"), "split", "means")
    tasks = tasks.where("means in ('train', 'validation', 'holdout')")
    texts = F.array(*(F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(FIELDS)))
    records = tasks.select("record_id", (F.col("means") != "train").alias("held"), F.explode(texts).alias("x")).select("record_id", "held", "x.field", "x.text")
    return tasks, find_overlaps(records, ALIKE, TRIPLE)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = _overlaps(spark, d)
    a, b = F.col("record_id_held"), F.col("record_id_train")
    return pairs.select(F.least(a, b).alias("record_a"), F.greatest(a, b).alias("record_b")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the held-out records: how many recur in train, and how much of them."""
    tasks, pairs = _overlaps(spark, d)
    best = pairs.groupBy(F.col("record_id_held").alias("record_id")).agg(
        F.count_distinct("record_id_train").alias("train_records"), F.max("held_coverage").alias("coverage"), F.max(F.col("similarity") == 1.0).alias("exact")
    )
    held = tasks.where("means <> 'train'").select("record_id", F.col("means").alias("split"), "source").join(best, "record_id", "left")
    return held.groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count("coverage").alias("overlapping"), F.count_if("exact").alias("exact"),
        F.coalesce(F.sum("train_records"), F.lit(0)).alias("pairs"), F.round(F.avg("coverage"), 6).alias("avg_coverage"),
    )


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the held-out records: how many there are, recur in train, recur exactly, and their pairs."""
    return p1_report(spark, d).select("split", "source", "records", "overlapping", "exact", "pairs")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rebuild_conversations(load(spark, d, "trace_messages"), load(spark, d, "spellings")).select("trace_id", "pos", "msg_id")


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The turns of sound traces with roles, contents, calls and corrected times."""
    turns = rebuild_conversations(load(spark, d, "trace_messages"), load(spark, d, "spellings"))
    contents = load(spark, d, "trace_messages").select("msg_id", "content", "tool_calls", F.trim("tool_call_id").alias("tool_call_id"))
    return turns.join(contents, "msg_id").select("trace_id", "pos", "msg_id", "role", "content", "tool_calls", "tool_call_id", "corrected_at")


def _samples(spark: SparkSession, d: str) -> NearDuplicates:
    texts = F.expr("transform(filter(messages, m -> not coalesce(lower(trim(m.role)) = 'system', false)), m -> m.content)")
    return NearDuplicates(load(spark, d, "training_samples").select("sample_id", texts.alias("texts")), "sample_id", "texts", ALIKE, TRIPLE)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).pairs().select(F.col("id_a").alias("sample_a"), F.col("id_b").alias("sample_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """A row per sample: class of equals, links of the class, group."""
    return _samples(spark, d).groups().withColumnRenamed("id", "sample_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return related_groups(task_entities(load(spark, d, "tasks"), load(spark, d, "spellings")), "record_id", ENTITIES)


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every task row."""
    return assign_splits(task_entities(load(spark, d, "tasks"), load(spark, d, "spellings")), "record_id", ENTITIES, load(spark, d, "split_targets")).select("record_id", "split")


def p4_together(spark: SparkSession, d: str) -> DataFrame:
    """One row: the task rows that got a split, and the groups of related rows that were torn apart."""
    rows = assign_splits(task_entities(load(spark, d, "tasks"), load(spark, d, "spellings")), "record_id", ENTITIES, load(spark, d, "split_targets"))
    groups = rows.groupBy("component").agg(F.count("split").alias("rows"), ((F.min("split") != F.max("split")) & F.col("component").isNotNull()).alias("apart"))
    return groups.agg(F.sum("rows").alias("rows"), F.count_if("apart").alias("apart"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_turns(load(spark, d, "trace_messages"), load(spark, d, "spellings")).select("trace_id", "first_node", "last_node", "n_turns")


def p5_near_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of near-identical turns by segmentation, single turns included."""
    return near_repeated_turns(load(spark, d, "trace_messages"), load(spark, d, "spellings")).select("trace_id", "first_node", "last_node", "n_turns", "duration_s")


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    """What the runs of near-identical turns hold of each trace: every turn once."""
    runs = near_repeated_turns(load(spark, d, "trace_messages"), load(spark, d, "spellings"))
    return runs.groupBy("trace_id").agg(F.sum("n_turns").alias("n_turns"), F.min("first_node").alias("first_node"), F.max("last_node").alias("last_node"))


def p5_reports(spark: SparkSession, d: str) -> DataFrame:
    """Repeated turns of each run by its messages beside what its report says."""
    messages = load(spark, d, "trace_messages")
    runs = repeated_turns(messages, load(spark, d, "spellings")).groupBy("trace_id").agg(F.sum(F.col("n_turns") - 1).alias("repeated"))
    owner = messages.where("trace_id is not null and run_id is not null").groupBy("trace_id").agg(F.min("run_id").alias("run_id"))
    found = owner.join(runs, "trace_id", "left").groupBy("run_id").agg(F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated_by_messages"))
    reports = load(spark, d, "metrics_reports").select("report_id", "run_id", "repeated_call_turns")
    return reports.join(found, "run_id", "left").withColumn("agrees", F.col("repeated_call_turns").eqNullSafe(F.col("repeated_by_messages")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Tiles and covered share of each item in each document it leaked into."""
    return find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p7_longest(spark: SparkSession, d: str) -> DataFrame:
    """The longest passage that each document has of each item."""
    return find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("doc_id", "item_id", "longest")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).copies()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).shares()


def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per source: no document is used more often than allowed, and the tokens miss the target by less than a document."""
    mix = Mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))
    used = mix.copies().groupBy("source").agg(F.max("copies").alias("most"), F.max("n_tokens").alias("longest"))
    whole = F.sum("tokens").over(Window.partitionBy())  # a row per source
    shares = mix.shares().withColumn("miss", F.abs(F.col("tokens") - F.col("target_share") * whole))
    return shares.join(used, "source").select("source", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.col("miss") <= F.col("longest")).alias("near_target"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(load(spark, d, "documents"), limit=512, overlap=64)


def p9_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Per document: its characters, and whether its pieces hold them all in order, each within the limit and ending behind the one before."""
    inorder = Window.partitionBy("doc_id").orderBy("piece")
    rows = p9_pieces(spark, d).withColumns({"end_before": F.lag("end").over(inorder), "start_before": F.lag("start").over(inorder)})
    first = (F.col("piece") == 0) & (F.col("start") == 0)
    later = (F.col("start") > F.col("start_before")) & (F.col("start") <= F.col("end_before")) & (F.col("end") > F.col("end_before"))
    fine = F.coalesce(first | later, F.lit(False)) & (F.col("n_tokens") <= 512) & (F.length("text") == F.col("end") - F.col("start"))
    return rows.groupBy("doc_id").agg(F.max("end").alias("n_chars"), F.bool_and(fine).alias("whole"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_report, p1_counts, p2_found, p2_conversations, p3_found, p3_groups, p4_found, p4_splits, p4_together,
        p5_found, p5_near_runs, p5_turns, p5_reports, p7_found, p7_coverage, p7_longest, p8_mix, p8_shares, p8_bounds, p9_pieces, p9_bounds,
    )
    return {f.__name__: f for f in every}
