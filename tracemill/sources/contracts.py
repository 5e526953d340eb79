"""Suites of sealed cases, data set manifests, reports and task lists."""

from __future__ import annotations

import hashlib
import json
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import strict_json as J
from tracemill.functions.digests import canonical, canonical_json
from tracemill.operators.verdicts import shape_faults
from tracemill.sources.files import SPLIT_FILES

#: Fields of a manifest and of a report with their types. Fixed values.
MANIFEST = {"schema_version": int, "dataset_sha256": str, "train_trajectories": int, "valid_trajectories": int, "action_counts": list, "samples_per_trace_limit": int}
REPORT = {
    "run_id": "string", "schema_version": "int", "parser": "string", "traces": "bigint", "sampled_turns": "bigint", "parsed_turns": "bigint", "parsed_calls": "bigint", "tool_call_attempts": "bigint",
    "invalid_calls": "bigint", "unavailable_tool_calls": "bigint", "repeated_call_turns": "bigint", "completed_model_calls": "bigint", "model_calls": "bigint", "length_limited_calls": "bigint",
    "passed_cases": "bigint", "total_cases": "bigint", "sealed_validation_reward": "double", "parsed_tool_call_rate": "double", "invalid_tool_rate": "double", "end_token_rate": "double",
    "loop_rate": "double", "comparison_sha256": "string",
}


def read_suites(spark: SparkSession, folder: str, name: str = "cases.json", depth: int = 32, nodes: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``(cases, faults)`` of the suites below a folder.

    A case has ``path, place, case_id, operations, observe, expected`` (JSON
    texts); faults are suites over the limits, without cases, with cases that
    lack parts or share an id, or with expectations that don't fit their observed names.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(F.col("_metadata.file_path").alias("path"), "value")
    shaped = files.withColumn("reason", shape_faults(depth, nodes)("value"))
    items = F.from_json(F.get_json_object("value", "$.cases"), "array<string>")
    checked = shaped.withColumn("cases", F.when(F.col("reason").isNull(), items))
    checked = checked.withColumn("reason", F.coalesce("reason", F.when(F.coalesce(F.size("cases"), F.lit(0)) <= 0, "no cases")))
    part = lambda p: F.get_json_object("case", p)
    cases = checked.where("reason is null").select("path", F.posexplode("cases").alias("place", "case")).select(
        "path", "place", part("$.id").alias("case_id"), part("$.operations").alias("operations"), F.from_json(part("$.observe"), "array<string>").alias("observe"), part("$.expected").alias("expected")
    )
    status, values = F.get_json_object("expected", "$.status"), F.json_object_keys(F.get_json_object("expected", "$.values"))
    good = F.when(status == "ok", F.array_sort(values) == F.array_sort("observe")).when(
        status == "error", (F.get_json_object("expected", "$.operation").try_cast("int") >= 0) & (F.get_json_object("expected", "$.type") != "")
        & F.coalesce(J.kind(J.at(J.parse_one(F.col("expected")), "$.message")).isin("null", "string"), F.lit(True))
    )
    whole = F.col("case_id").isNotNull() & F.col("operations").isNotNull() & F.col("observe").isNotNull()
    faults = checked.where("reason is not null").select("path", F.lit(None).cast("int").alias("place"), "reason")
    faults = faults.unionByName(cases.where(~whole).select("path", "place", F.lit("case lacks a part").alias("reason")))
    faults = faults.unionByName(cases.where(whole & ~F.coalesce(good, F.lit(False))).select("path", "place", F.lit("expectation does not fit").alias("reason")))
    twice = cases.groupBy("path", "case_id").agg(F.count("*").alias("n"), F.max("place").alias("place")).where("n > 1")
    return cases, faults.unionByName(twice.select("path", "place", F.lit("id given twice").alias("reason")))


def suite_digests(spark: SparkSession, folder: str, name: str = "cases.json") -> DataFrame:
    """``path, sha256`` of the suites below a folder: of their canonical JSON and a line end, so that layout doesn't count; null for what is no JSON."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(F.col("_metadata.file_path").alias("path"), canonical_json("value").alias("text"))
    return files.select("path", F.sha2(F.concat("text", F.lit("\n")).cast("binary"), 256).alias("sha256"))


def count_faults(cases: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks ``path, expected_cases`` whose suite has another number of cases."""
    counts = cases.groupBy("path").agg(F.count("*").alias("cases"))
    return tasks.join(counts, "path", "left").where(~F.coalesce(F.col("cases"), F.lit(0)).eqNullSafe(F.col("expected_cases")))


def dataset_digest(folder: str, domain: str = "dataset") -> str:
    """The digest :func:`tracemill.sources.files.write_splits` gave, from the files."""
    digest = hashlib.sha256(domain.encode() + b"\0")
    for file in SPLIT_FILES.values():
        path = Path(folder) / file
        if path.exists():
            with open(path, "rb") as f:
                for line in f:
                    for piece in (file.encode(), line.rstrip(b"\n")):
                        digest.update(len(piece).to_bytes(8, "big") + piece)
    return digest.hexdigest()


def load_manifest(folder: str, name: str = "manifest.json", domain: str = "dataset") -> dict:
    """A data set's manifest, its types and its digest checked; a fault is a ValueError."""
    manifest = json.loads((Path(folder) / name).read_text(encoding="utf-8"))
    for field, kind in MANIFEST.items():
        value = manifest.get(field)
        if not isinstance(value, kind) or isinstance(value, bool):
            raise ValueError(f"{field} is no {kind.__name__}")
    for pair in manifest["action_counts"]:
        if not (isinstance(pair, list) and len(pair) == 2 and isinstance(pair[0], str) and isinstance(pair[1], int) and pair[1] >= 1):
            raise ValueError("action_counts holds something else than names with counts")
    if manifest["dataset_sha256"] != dataset_digest(folder, domain):
        raise ValueError("the files are not those of the manifest")
    return manifest


def snapshot_dataset(source: str, target: str, most_bytes: int = 256 << 20) -> None:
    """A data set's manifest, train and validation files copied; links, empty or larger files and a holdout file are errors."""
    origin, copy = Path(source), Path(target)
    if (origin / SPLIT_FILES["holdout"]).exists():
        raise ValueError("the data set has a holdout file")
    copy.mkdir(parents=True, exist_ok=True)
    for name in ("manifest.json", SPLIT_FILES["train"], SPLIT_FILES["validation"]):
        file = origin / name
        if file.is_symlink() or not file.is_file() or not 0 < file.stat().st_size <= most_bytes:
            raise ValueError(f"{name} is no regular file within the size limit")
        shutil.copyfile(file, copy / name, follow_symlinks=False)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Metrics reports, one JSON object a file, numbers given as text included; what doesn't convert is null."""
    raw = spark.read.option("multiLine", "true").option("primitivesAsString", "true").json(path)
    return raw.select(*((F.col(c) if c in raw.columns else F.lit(None)).try_cast(kind).alias(c) for c, kind in REPORT.items()))


def task_list(tasks: DataFrame, split: str, order: list[str], generated: DataFrame | None = None) -> DataFrame:
    """The tasks of a split with their place ``idx`` from 0; places come from counts per range, not from one sort.

    An empty split is an error. ``generated`` tasks, of the same columns, come after the
    others; they are for training only, so any other split with them is an error.
    """
    chosen = tasks.where(F.col("split") == split)
    if generated is not None:
        if split != "train":
            raise ValueError("generated tasks are for the train split only")
        chosen = chosen.withColumn("__late", F.lit(0)).unionByName(generated.withColumn("__late", F.lit(1)))
        return task_list(chosen, split, ["__late", *order]).drop("__late")
    if not chosen.limit(1).count():
        raise ValueError(f"no task is of the split {split}")
    ranged = chosen.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    from tracemill.session import cut

    kept = cut(ranged, "tasks")
    counts = kept.groupBy("__part").agg(F.count("*").alias("n"))  # a row per partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return kept.withColumn("__place", within).join(F.broadcast(before), "__part").withColumn("idx", (F.col("before") + F.col("__place") - 1).cast("bigint")).drop("__part", "__place", "before")


def shuffled(df: DataFrame, key: str, seed: int, epoch: int) -> Column:
    """A sort key that is a fixed shuffle for each seed and epoch."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")), 256)


def artifact_digest(artifacts: dict[str, bytes | None]) -> str:
    """A digest of named artifacts by name; an absent one (None) differs from an empty one."""
    h = hashlib.sha256()
    for name in sorted(artifacts):
        data, key = artifacts[name], name.encode()
        h.update(len(key).to_bytes(8, "big") + key)
        h.update(b"N" if data is None else b"B" + len(data).to_bytes(8, "big") + data)
    return h.hexdigest()


def bare_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*\z", 1)


def as_line(value: dict) -> str:
    """One canonical line of a JSON-lines file."""
    return canonical(value) + "\n"
