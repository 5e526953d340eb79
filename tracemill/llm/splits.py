"""Splits that keep related records together.

Records that share an entity (an author, source, family, task) are linked, also
by way of others: the components of the graph of entities, found by alternating
large-star and small-star, each go to one split. Components are hashed into
ranges in proportion to the splits' shares. Only those too large for chance,
over a fixed fraction of all rows and so boundedly many, are placed first, the
largest where most is missing, and the ranges fill what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.components import connected_components
from tracemill.session import cut
from tracemill.tables import meanings, plain

#: A component over this share of all rows is placed before the others; at most 1 / LARGE are.
LARGE = 0.005
#: How a revision may be written at the end of a task's name. Fixed values.
REVISION_WORDS = "r|rev|revision|v|ver|version"
_MARK = (
    r"(?is)^(.*?)\s*(?:[@#:~+]\s*(?:" + REVISION_WORDS + r")?[\s.]*|[(\[{]\s*(?:" + REVISION_WORDS + r")?[\s.]*"
    r"|[\s._/-]+(?:" + REVISION_WORDS + r")[\s.]*)0*([0-9]+)\s*[)\]}]?[\s/]*$"
)


def words_of(column: Column) -> Column:
    """The words of a name joined by ``-``; null if it has none."""
    return F.nullif(F.array_join(F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9]+)"), F.lit(1)), "-"), F.lit(""))


def without_revision(name: Column, revision: Column) -> Column:
    """The name without a mark at its end that repeats the revision."""
    marked = F.regexp_extract(name, _MARK, 2) == revision.cast("string")
    return F.when(marked, F.regexp_extract(name, _MARK, 1)).otherwise(name)


def _unless_placeholder(df: DataFrame, column: str, spellings: DataFrame, field: str) -> DataFrame:
    table = meanings(spellings, field).where("means is null").select(F.col("written").alias("__written"), F.lit(True).alias("__none"))
    joined = df.join(table, plain(F.col(column)) == F.col("__written"), "left")
    return joined.withColumn(column, F.when(F.col("__none").isNull(), F.col(column))).drop("__written", "__none")


def task_entities(tasks: DataFrame, spellings: DataFrame) -> DataFrame:
    """``record_id``, ``family``, ``task``: both as words, null where missing or a placeholder."""
    df = tasks.select("record_id", "family", F.col("task_id").alias("task"), "task_revision")
    df = _unless_placeholder(_unless_placeholder(df, "family", spellings, "family"), "task", spellings, "task_id")
    df = _unless_placeholder(df.withColumn("task", without_revision(F.col("task"), F.col("task_revision"))), "task", spellings, "task_id")
    return df.select("record_id", words_of(F.col("family")).alias("family"), words_of(F.col("task")).alias("task"))


def group_records(records: DataFrame, record_id: str, entities: list[str]) -> DataFrame:
    """``record_id`` and ``component`` of each record, by its entity columns (strings).

    The component is the smallest of its entities: the place of its column in
    ``entities``, then the name. It is null for a record without any entity, which
    is linked to nothing; null ids keep their rows; equal rows stay equal rows.
    """
    nodes = [F.concat(F.lit(str(i)), F.col(e)) for i, e in enumerate(entities)]
    rows = records.select(F.col(record_id).alias("record_id"), F.array_compact(F.array(*nodes)).alias("nodes"))
    links = rows.where("size(nodes) > 1").select(F.col("nodes")[0].alias("src"), F.explode(F.slice("nodes", 2, len(entities))).alias("dst"))
    found = connected_components(links)
    keyed = rows.select("record_id", F.get("nodes", F.lit(0)).alias("node"))
    return keyed.join(found, "node", "left").select("record_id", F.coalesce("component", "node").alias("component"))


def related_groups(records: DataFrame, record_id: str, entities: list[str]) -> DataFrame:
    """``record_id`` and ``group_name`` of the rows of groups of two or more rows."""
    rows = cut(group_records(records, record_id, entities).where("component is not null"), "grouped")
    several = rows.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return rows.join(several, "component").select("record_id", F.substring("component", 2, 1 << 30).alias("group_name"))


def assign_splits(records: DataFrame, record_id: str, entities: list[str], targets: DataFrame, seed: int = 0, fixed: bool = False) -> DataFrame:
    """``record_id``, ``component`` and ``split`` of every record.

    ``targets`` has ``split`` and ``share``, a table of a handful of rows; shares
    are taken relative to their sum. A record without an entity is a component of
    its own. The same rows and seed give the same splits. With ``fixed`` ranges are
    the shares themselves, for large components too: a component keeps its split whatever
    other rows come, but a large one may take the splits far from their shares.
    """
    wanted = [(r["split"], float(r["share"])) for r in targets.where("share > 0").orderBy("split").limit(1001).collect()]
    if not wanted or len(wanted) > 1000:
        raise ValueError("between 1 and 1000 splits with a positive share are needed")
    whole = sum(s for _, s in wanted)
    rows = cut(group_records(records, record_id, entities), "grouped")
    sizes = rows.where("component is not null").groupBy("component").agg(F.count("*").alias("n"))
    total = rows.count()
    missing = {name: share / whole * total for name, share in wanted}
    placed = {}
    for row in sizes.where(F.lit(not fixed) & (F.col("n") > LARGE * total)).orderBy(F.desc("n"), "component").collect():  # at most 1 / LARGE
        best = max(wanted, key=lambda w: (missing[w[0]], w[1]))[0]
        placed[row.component] = best
        missing[best] -= row.n
    rest = {name: max(0.0, missing[name]) for name, _ in wanted}
    scale = sum(rest.values()) or 1.0
    key = F.coalesce("component", F.concat(F.lit("~"), F.col("record_id").cast("string")), F.lit("~"))
    point = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    split, upto = F.lit(wanted[-1][0]), []
    for name, _ in wanted:
        upto.append((name, (upto[-1][1] if upto else 0.0) + rest[name] / scale))
    for name, edge in reversed(upto[:-1]):
        split = F.when(point < edge, F.lit(name)).otherwise(split)
    if placed:
        known = F.create_map(*(F.lit(x) for pair in placed.items() for x in pair))
        split = F.coalesce(known[F.col("component")], split)
    return rows.select("record_id", "component", split.alias("split"))
