"""Files of traces as flat frames: one JSON object with an array ``traces`` per line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import strict_json as J


def read_lines(spark: SparkSession, paths: list[str], name: str = "traces.jsonl", most_bytes: int | None = None, most_files: int | None = None, most_total: int | None = None) -> DataFrame:
    """``file, file_ord, line_no, line`` of the non-blank lines of files and of folders' files of that name.

    Lines end with ``\\n`` (a ``\\r`` before it is dropped), nothing else parts
    them, so a line separator within a JSON text stays. A file over
    ``most_bytes`` is an error, as are more than ``most_files`` files, over ``most_total``
    bytes, a missing path and a folder without files. Line numbers and file
    ordinals count from 1; a file found by several paths counts once. Files are read in
    splits: a line's number is its place in its split after the lines of the splits before.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name or "*").load(paths)
    files = sorted({(r.path, r.length) for r in listed.select("path", "length").distinct().toLocalIterator()})  # names only
    if not files or (most_files is not None and len(files) > most_files):
        raise ValueError("no trace file" if not files else f"more than {most_files} trace files")
    large = next((f for f, size in files if most_bytes is not None and size > most_bytes), None)
    if large is not None or (most_total is not None and sum(size for _, size in files) > most_total):
        raise ValueError(f"over the size limit: {large or 'all files together'}")
    rows = spark.read.option("lineSep", "\n").text([f for f, _ in files])
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    inorder = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("file", "start").agg(F.count("*").alias("n")).select("file", "start", F.coalesce(F.sum("n").over(inorder), F.lit(0)).alias("before"))
    order = before.select("file").distinct().select("file", F.rank().over(Window.orderBy("file")).cast("int").alias("file_ord"))  # over names only
    lines = rows.mapInArrow(_numbered, "file string, start bigint, line string, at bigint").where(F.trim(F.rtrim("line", F.lit("\r"))) != "")
    placed = lines.join(before, ["file", "start"]).join(F.broadcast(order), "file")
    return placed.select("file", "file_ord", (F.col("before") + F.col("at")).cast("int").alias("line_no"), F.rtrim("line", F.lit("\r")).alias("line"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each split, which come one after the other."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(0), np.asarray(batch.column(1))
        other = np.r_[True, np.asarray(pc.not_equal(file.slice(1), file.slice(0, len(start) - 1))) | (start[1:] != start[:-1])]
        begin = np.flatnonzero(other)
        at = np.arange(1, len(start) + 1) - np.repeat(begin, np.diff(np.r_[begin, len(start)]))
        if last == (file[0].as_py(), start[0]):
            at[: begin[1] if len(begin) > 1 else None] += n
        last, n = (file[-1].as_py(), start[-1]), int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["file", "start", "line", "at"])


def read_traces(lines: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(traces, errors)``: a row per trace, with its place, and a row per fault.

    ``keep`` are columns that place a line; the result has ``trace_ord`` (from 0)
    and ``trace`` (VARIANT). Faults are lines that aren't one JSON object, lack an
    array ``traces``, or hold something else than objects in it.
    """
    keep = keep or ["file_ord", "line_no"]
    parsed = lines.select(*keep, J.parse_one(F.col("line")).alias("value"))
    traces = J.at(F.col("value"), "$.traces")
    reason = F.when(F.coalesce(J.kind(F.col("value")), F.lit("")) != "object", "not a JSON object").when(F.coalesce(J.kind(traces), F.lit("")) != "array", "traces is not a list")
    checked = parsed.withColumn("reason", reason)
    rows = checked.where("reason is null").select(*keep, F.posexplode(J.items(traces)).alias("trace_ord", "trace"))
    fault = J.kind(F.col("trace")) != "object"
    errors = checked.where("reason is not null").select(*keep, F.lit(None).cast("int").alias("trace_ord"), "reason")
    errors = errors.unionByName(rows.where(fault).select(*keep, "trace_ord", F.lit("trace is not an object").alias("reason")))
    return rows.where(~fault), errors


def flatten(traces: DataFrame, keep: list[str]) -> dict[str, DataFrame]:
    """Frames ``traces, nodes, tools, model_calls`` of a frame with a VARIANT column ``trace``.

    ``score`` is what makes a trace successful (true counts as one, none as zero), ``reward`` the number given, if one is.
    """
    t = F.col("trace")
    get = lambda path, kind: F.try_variant_get(t, path, kind)
    base = traces.withColumn("trace_id", J.text(J.at(t, "$.id")))
    task = "$.task.data"
    heads = base.select(
        *keep, "trace_id",
        J.is_true(J.at(t, "$.ok")).alias("ok"),
        get("$.stop_condition", "string").alias("stop_condition"),
        # true counts as one, as it compares equal to it
        F.coalesce(J.number(J.at(t, "$.rewards.tests.score")), J.is_true(J.at(t, "$.rewards.tests.score")).cast("double")).alias("score"),
        J.number(J.at(t, "$.rewards.tests.score")).alias("reward"),
        get(f"{task}.task_id", "string").alias("task_id"),
        J.integer(J.at(t, f"{task}.task_revision")).alias("task_revision"),
        get(f"{task}.split", "string").alias("split"),
        J.integer(J.at(t, "$.metrics.passed_cases")).alias("passed_cases"),
        J.integer(J.at(t, "$.metrics.total_cases")).alias("total_cases"),
    )

    def part(name: str, ordinal: str) -> DataFrame:
        return base.select(*keep, "trace_id", F.posexplode(J.items(J.at(t, f"$.{name}"))).alias(ordinal, "x"))

    x = F.col("x")
    nodes = part("nodes", "node").select(
        *keep, "trace_id", "node",
        J.integer(J.at(x, "$.parent")).cast("int").alias("parent"),
        J.is_true(J.at(x, "$.sampled")).alias("sampled"),
        J.text(J.at(x, "$.message.role")).alias("role"),
        F.to_json(J.at(x, "$.message.content")).alias("content"),
        J.flat_text(J.at(x, "$.message.content")).alias("text"),
        F.to_json(J.at(x, "$.message.tool_calls")).alias("tool_calls"),
        J.text(J.at(x, "$.message.tool_call_id")).alias("tool_call_id"),
    )
    tools = part("tools", "tool_ord").select(
        *keep, "trace_id", "tool_ord", J.text(J.at(x, "$.name")).alias("name"), J.text(J.at(x, "$.description")).alias("description"), F.to_json(J.at(x, "$.parameters")).alias("parameters")
    )
    calls = part("calls", "call_ord").select(*keep, "trace_id", "call_ord", J.text(J.at(x, "$.finish_reason")).alias("finish_reason"), F.to_json(J.at(x, "$.sampling")).alias("sampling"))
    return {"traces": heads, "nodes": nodes, "tools": tools, "model_calls": calls}


def first_error(errors: DataFrame, order: list[str]) -> str | None:
    """The reason that comes first in order: the one fault a strict run reports."""
    row = errors.agg(F.min_by("reason", F.struct(*order)).alias("reason")).first()
    return row["reason"] if row else None
