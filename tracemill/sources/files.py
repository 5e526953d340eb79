"""Other sources and sinks: task manifests, logs, trees, CSV texts, split files."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tracemill.functions import scalars as S
from tracemill.functions import strict_json as J
from tracemill.functions.digests import canonical

#: Files of a data set by split, in the order in which its digest takes them. Fixed values.
SPLIT_FILES = {"train": "train.jsonl", "validation": "valid.jsonl", "holdout": "test.jsonl"}


def read_objects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file of JSON objects, one a line; blank lines are passed over, a broken line is an error, and so is a file without objects."""
    reader = spark.read.option("mode", "FAILFAST").option("lineSep", "\n")
    rows = (reader.schema(schema) if schema else reader).json(path)
    if not rows.limit(1).count():
        raise ValueError(f"no object in {path}")
    return rows


def write_splits(rows: DataFrame, folder: str, split: str, order: list[str], domain: str = "dataset") -> str:
    """One JSON-lines file per split, canonical and ordered, and the digest of them all.

    ``domain`` sets digests of one kind apart from those of another. Each file
    replaces its predecessor in one step; the file of a split without
    rows goes away. A file is one sequence of bytes whose digest is taken in
    order, so its rows stream through the driver, one at a time.
    """
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    digest = hashlib.sha256(domain.encode() + b"\0")
    payload = [c for c in rows.columns if c != split and c not in order]
    for name, file in SPLIT_FILES.items():
        part = rows.where(F.col(split) == name).orderBy(*order).select(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("line"))
        n = 0
        with tempfile.NamedTemporaryFile("wb", dir=target, delete=False) as out:
            for row in part.toLocalIterator():
                line = canonical(json.loads(row.line)).encode()
                for piece in (file.encode(), line):
                    digest.update(len(piece).to_bytes(8, "big") + piece)
                out.write(line + b"\n")
                n += 1
            out.flush()
            os.fsync(out.fileno())
        if n:
            os.replace(out.name, target / file)
        else:
            os.unlink(out.name)
            (target / file).unlink(missing_ok=True)
    return digest.hexdigest()


def write_report(report: dict, path: str) -> None:
    """An indented JSON report with sorted names, written in one step."""
    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=where.parent, delete=False, encoding="utf-8") as out:
        json.dump(report, out, indent=2, sort_keys=True, ensure_ascii=False)
        out.write("\n")
        out.flush()
        os.fsync(out.fileno())
    os.replace(out.name, where)


def scrub(df: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """A struct column without private fields."""
    return df.withColumn(column, F.col(column).dropFields(*names))


def training_losses(logs: DataFrame, log: str = "value") -> DataFrame:
    """``place, kind, loss`` of every reported loss of a log text, in order.

    ``finite`` is false for losses that are no finite number: such a run failed.
    """
    pattern = r"(Train|Val) loss ([^\s,]+)"
    rest = [c for c in logs.columns if c != log]
    kinds, values = (F.regexp_extract_all(log, F.lit(pattern), F.lit(i)) for i in (1, 2))
    rows = logs.select(*rest, F.posexplode(F.arrays_zip(kinds.alias("kind"), values.alias("loss"))).alias("place", "x"))
    loss = F.col("x.loss").try_cast("double")
    finite = loss.isNotNull() & ~F.isnan(loss) & ~loss.isin(float("inf"), float("-inf"))
    return rows.select(*rest, "place", F.col("x.kind").alias("kind"), loss.alias("loss"), finite.alias("finite"))


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, bytes_read, sha256`` of the files of a folder; links are an error (a local folder is looked through)."""
    if os.path.isdir(folder):
        for base, folders, files in os.walk(folder):
            for name in (*folders, *files):
                if os.path.islink(os.path.join(base, name)):
                    raise ValueError(f"a link: {os.path.join(base, name)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.octet_length("content").cast("bigint").alias("bytes_read"), F.sha2("content", 256).alias("sha256"))


def tree_inventory(files: DataFrame, most_files: int | None = None, most_bytes: int | None = None) -> tuple[int, int]:
    """``(files, bytes)`` of what :func:`read_tree` gave; more than asked for is an error, and so is a file that changed since it was listed."""
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(F.col("length") != F.col("bytes_read")).alias("changed")).first()
    if row["changed"]:
        raise ValueError(f"{row['changed']} files changed while they were read")
    for what, n, most in (("files", row["n"], most_files), ("bytes", row["bytes"], most_bytes)):
        if most is not None and n > most:
            raise ValueError(f"more than {most} {what}")
    return row["n"], row["bytes"]


def parse_csv(text: str) -> tuple[list[list[str]], str | None]:
    """Records of a CSV text, or an error: quotes doubled within quotes, a lone CR is data."""
    if text == "":
        return [], None
    records: list[list[str]] = [[]]
    field, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            i += 1
            while True:
                end = text.find('"', i)
                if end < 0:
                    return [], "unterminated quoted field"
                field.append(text[i:end])
                i = end + 1
                if i < n and text[i] == '"':
                    field.append('"')
                    i += 1
                    continue
                break
            if i < n and text[i] != "," and text[i] != "\n" and text[i : i + 2] != "\r\n":
                return [], "unexpected character after quoted field"
        else:
            start = i
            while i < n and text[i] not in ',\n"' and text[i : i + 2] != "\r\n":
                i += 1
            if i < n and text[i] == '"':
                return [], "quote in unquoted field"
            field.append(text[start:i])
        records[-1].append("".join(field))
        field = []
        if i >= n:
            return records, None
        if text[i] == ",":
            i += 1
            continue
        i += 1 if text[i] == "\n" else 2
        if i >= n:
            return records, None
        records.append([])


@udtf(returnType=StructType([StructField("record", IntegerType()), StructField("field", IntegerType()), StructField("value", StringType()), StructField("error", StringType())]))
class ParseCsv:
    """``parse_csv(text)``: a row per field, or one row with an error."""

    def eval(self, text: str):
        if text is None:
            return
        records, error = parse_csv(text)
        if error:
            yield None, None, None, error
        for r, record in enumerate(records):
            for f, value in enumerate(record):
                yield r, f, value, None


_MANIFEST = "path string, manifest string, error string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TomlReader(DataSourceReader):
    def __init__(self, root: str, name: str):
        self.root, self.name = root, name

    def partitions(self):
        return [_File(p) for p in sorted(str(p) for p in Path(self.root).glob(f"*/{self.name}"))] or [_File("")]

    def read(self, partition):
        import tomllib

        if not partition.path:
            return
        try:
            with open(partition.path, "rb") as f:
                yield partition.path, json.dumps(tomllib.load(f), sort_keys=True, default=str), None
        except (tomllib.TOMLDecodeError, OSError) as e:
            yield partition.path, None, str(e)


class TomlManifests(DataSource):
    """``spark.read.format("toml_manifests").option("name", "task.toml").load(root)``: the manifests of root's folders as JSON."""

    @classmethod
    def name(cls):
        return "toml_manifests"

    def schema(self):
        return _MANIFEST

    def reader(self, schema):
        return _TomlReader(self.options["path"], self.options.get("name", "task.toml"))


def read_manifests(spark: SparkSession, root: str, name: str = "task.toml") -> DataFrame:
    """Manifests of the folders below ``root``, as JSON in ``manifest``; faults in ``error``."""
    spark.dataSource.register(TomlManifests)
    return spark.read.format("toml_manifests").option("name", name).load(root)


def manifest_faults(manifests: DataFrame, fields: list[str]) -> DataFrame:
    """``path, reason``: files that can't be read, lack or add fields, or share an id."""
    keys = F.json_object_keys("manifest")
    lack, more = F.array_except(F.array(*map(F.lit, fields)), keys), F.array_except(keys, F.array(*map(F.lit, fields)))
    own = manifests.select(
        "path",
        F.coalesce("error", F.when(F.size(lack) > 0, F.concat(F.lit("missing: "), F.array_join(lack, ", "))).when(F.size(more) > 0, F.concat(F.lit("unknown: "), F.array_join(more, ", ")))).alias("reason"),
    )
    ids = manifests.select("path", F.get_json_object("manifest", "$.id").alias("id")).where("id is not null")
    twice = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return own.where("reason is not null").unionByName(ids.join(twice, "id").select("path", F.concat(F.lit("id given twice: "), F.col("id")).alias("reason")))


#: The closed schema of a task's manifest: its fields, those of its tables, and what other fields may hold. Fixed values.
TASK_FIELDS = (
    "schema_version", "task_id", "task_revision", "family", "split", "prompt", "runtime", "runtime_version", "max_time_seconds", "token_budget", "expected_cases", "editable_files",
    "context_files", "source", "source_revision", "license", "sensitive_data", "seed", "environment", "verifier",
)
TASK_TABLES = {
    "environment": ("image", "image_digest", "os", "architecture", "network", "cpus", "memory_bytes", "pids", "workspace_bytes", "temp_bytes", "home_bytes", "dependency_lock_digest"),
    "verifier": ("protocol", "cases"),
}
TASK_BOUNDS = {"task_revision": (1, 1_000_000), "max_time_seconds": (1, 1800), "token_budget": (256, 1_000_000), "expected_cases": (1, 1000), "seed": (0, (1 << 63) - 1)}
TASK_CHOICES = {"split": ("train", "validation", "holdout"), "sensitive_data": ("public",)}
LONGEST_PROMPT = 32 * 1024


def task_faults(manifests: DataFrame, schema_version: int, runtimes: dict[str, str], protocol: str, environment: dict[str, object] | None = None) -> DataFrame:
    """``path, reason``: task manifests that can't be used, each with its first fault.

    Checked in turn: the file can be read; it has exactly the fields of a task, and its tables
    theirs; each field holds what it may (``runtimes`` has the version of each runtime); files are plain
    relative paths, those to be edited among those of the context; the environment is the given one. Then,
    over all manifests without a fault: an id ends with the name of its folder, and no other manifest has it or that name.
    """
    v = J.parse_one(F.col("manifest"))
    field = lambda name: J.at(v, f"$.{name}")
    text = lambda name: J.text(field(name))
    whole = lambda name: F.when(J.kind(field(name)) == "integer", field(name).cast("bigint"))

    def other_fields(keys: Column, names: tuple[str, ...], what: str) -> Column:
        wanted = F.array(*map(F.lit, names))
        lack, more = (F.array_join(F.array_sort(x), ", ") for x in (F.array_except(wanted, keys), F.array_except(keys, wanted)))
        return F.when(keys.isNull(), f"{what} is no table").when(lack != "", F.concat(F.lit(f"{what} lacks "), lack)).when(more != "", F.concat(F.lit(f"{what} has unknown "), more))

    def listed(name: str) -> Column:
        texts = F.transform(J.items(field(name)), J.text)
        return F.when(F.forall(texts, lambda x: x.isNotNull()) & (F.size(F.array_distinct(texts)) == F.size(texts)), texts)

    def value(fine: Column, reason: str) -> Column:
        return F.when(~F.coalesce(fine, F.lit(False)), reason)

    keys = lambda path: F.json_object_keys(F.get_json_object("manifest", path))
    edited, given = listed("editable_files"), listed("context_files")
    checks = [F.col("error"), F.when(v.isNull(), "not a manifest"), other_fields(keys("$"), TASK_FIELDS, "task"), value(whole("schema_version") == schema_version, "schema_version is another")]
    checks += [value(S.fits(text(name), S.TASK_ID), f"{name} is invalid") for name in ("task_id", "family")]
    checks += [value(whole(name).between(*bounds), f"{name} is out of bounds") for name, bounds in TASK_BOUNDS.items()]
    checks += [value(text(name).isin(*choices), f"{name} is invalid") for name, choices in TASK_CHOICES.items()]
    checks.append(value((F.trim(text("prompt")) != "") & (F.octet_length(text("prompt")) <= LONGEST_PROMPT), "prompt is empty or too long"))
    versions = F.create_map(*(F.lit(x) for pair in runtimes.items() for x in pair))
    checks.append(value(text("runtime_version") == F.try_element_at(versions, text("runtime")), "runtime is unknown or of another version"))
    checks += [value(text(name) != "", f"{name} is empty") for name in ("source", "source_revision")]
    checks.append(value(S.fits(text("license"), S.LICENSE), "license is invalid"))
    checks += [value(F.size(edited) > 0, "editable_files is no list of files"), value(given.isNotNull(), "context_files is no list of files"), value(F.size(F.array_except(edited, given)) == 0, "a file to be edited is not in the context")]
    checks += [value(F.forall(files, S.is_plain_path), f"{name} holds a path that is not plain") for name, files in (("editable_files", edited), ("context_files", given))]
    checks += [other_fields(keys(f"$.{name}"), names, name) for name, names in TASK_TABLES.items()]
    for name, want in (environment or {}).items():
        at = field(f"environment.{name}")
        fine = J.text(at) == want if isinstance(want, str) else J.number(at) == float(want)
        checks.append(value(fine, f"environment.{name} is another"))
    checks += [value(text("verifier.protocol") == protocol, "verifier.protocol is another"), value(S.is_plain_path(text("verifier.cases")) & ~text("verifier.cases").startswith("workspace/"), "verifier.cases is no file of the task")]
    own = manifests.select("path", text("task_id").alias("id"), F.coalesce(*checks).alias("reason"))
    fine = own.where("reason is null").select("path", "id", F.substring_index("id", "/", -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("folder"))
    faults = own.where("reason is not null").select("path", "reason")
    faults = faults.unionByName(fine.where("name <> folder").select("path", F.lit("task_id does not end with the name of its folder").alias("reason")))
    for column, what in (("id", "task_id"), ("name", "task name")):
        twice = fine.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
        faults = faults.unionByName(fine.join(twice, column).select("path", F.concat(F.lit(f"{what} given twice: "), F.col(column)).alias("reason")))
    return faults.groupBy("path").agg(F.min("reason").alias("reason"))
