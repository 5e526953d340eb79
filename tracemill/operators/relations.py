"""Joins and ordered operators on relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import coerce_cell


def coerced_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[str]) -> DataFrame:
    """Inner join on cells that mean the same: ``7`` and `` 7 `` but not ``7.0``.

    Empty and null keys match nothing. Of equal keys on the right the last in
    ``order`` counts. Columns of the right side override those of equal name. A
    missing key column is an error that names the side, left first.
    """
    for side, df, key in (("left", left, left_key), ("right", right, right_key)):
        if key not in df.columns:
            raise ValueError(f"the {side} side has no column {key}")
    cell = lambda c: F.to_json(coerce_cell(F.col(c).cast("string")))
    empty = lambda c: coerce_cell(F.col(c).cast("string"))["t"] == "null"
    # the columns of the right side, by place, so that clashing names can't mix
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(right.columns)))
    unique = right.where(~empty(right_key)).groupBy(cell(right_key).alias("__key")).agg(F.max_by(row, F.struct(*order)).alias("__right"))
    kept = [c for c in left.columns if c not in right.columns]
    joined = left.where(~empty(left_key)).withColumn("__key", cell(left_key)).join(unique, "__key")
    return joined.select(*kept, *(F.col(f"__right.c{i}").alias(c) for i, c in enumerate(right.columns)))


def route_table(routes: list[str]) -> dict[str, list[tuple[str, str, dict[str, int]]]]:
    """Routes by shape: per segment 0 for a fixed one, 1 for a parameter, 2 for a wildcard.

    A route has its fixed segments, its text, and the place of each parameter (from 0; of
    equal names the last). Empty segments don't count. A wildcard before the end, a
    second route of one shape and fixed segments, and parameters of two names at one
    place of the tree are errors.
    """
    shapes: dict[str, list[tuple[str, str, dict[str, int]]]] = {}
    named: dict[tuple[str, ...], str] = {}
    taken: set[tuple[str, ...]] = set()
    for route in sorted(set(routes)):
        parts = [x for x in route.split("/") if x]
        kinds = "".join({":": "1", "*": "2"}.get(x[0], "0") for x in parts)
        if "2" in kinds[:-1]:
            raise ValueError(f"wildcard must be the last segment: {route}")
        way: tuple[str, ...] = ()
        for x, kind in zip(parts, kinds):
            way = (*way, x if kind == "0" else kind)
            if kind == "1" and named.setdefault(way, x) != x:
                raise ValueError(f"conflicting param names: {route}")
        if (*way, "") in taken:
            raise ValueError(f"duplicate route: {route}")
        taken.add((*way, ""))
        fixed = "/".join(x for x, kind in zip(parts, kinds) if kind == "0")
        shapes.setdefault(kinds, []).append((fixed, route, {x[1:]: i for i, x in enumerate(parts) if kinds[i] != "0"}))
    return shapes


def _segment(n: int, wild: bool):
    """The segment at a place; at the last place of a shape with a wildcard all that are left."""
    rest = F.array_join(F.slice("__parts", n, F.greatest(F.size("__parts"), F.lit(1))), "/") if n else F.lit("")

    def at(_, place: Column) -> Column:
        one = F.get("__parts", place)
        return F.when(place == n - 1, rest).otherwise(one) if wild else one

    return at


def match_routes(paths: DataFrame, routes: DataFrame, path: str = "path", route: str = "route", most_routes: int = 10_000, most_shapes: int = 128) -> DataFrame:
    """Each path's best ``route`` and the segments of its ``params`` (a map), null where none matches.

    Fixed segments beat parameters, parameters beat wildcards, segment by segment
    from the left; a wildcard takes one segment or more. Empty segments don't count. Routes
    are a configuration table: over ``most_routes`` or ``most_shapes`` (see
    :func:`route_table`) is an error. For each shape the segments of a path that the
    shape fixes are looked up in a hash table, so paths are neither shuffled nor
    tried one by one against routes. Columns ``route`` and ``params`` of the paths are replaced.
    """
    listed = [r[0] for r in routes.select(route).where(F.col(route).isNotNull()).distinct().limit(most_routes + 1).collect()]
    shapes = route_table(listed)
    if len(listed) > most_routes or len(shapes) > most_shapes:
        raise ValueError(f"more than {most_routes} routes or {most_shapes} shapes of routes")
    kept = [c for c in paths.columns if c not in ("route", "params")]
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    rows = paths.withColumn("__parts", parts)
    found = []
    for i, shape in enumerate(sorted(shapes)):
        n, wild = len(shape), shape.endswith("2")
        fixed = [F.get("__parts", F.lit(j)) for j, kind in enumerate(shape) if kind == "0"]
        fits = F.size("__parts") >= n if wild else F.size("__parts") == n
        table = paths.sparkSession.createDataFrame(shapes[shape], "fixed string, route string, places map<string,int>")
        table = F.broadcast(table.select(F.col("fixed").alias(f"__key{i}"), F.struct("route", "places").alias(f"__found{i}")))
        rows = rows.withColumn("__want", F.when(fits, F.concat_ws("/", *fixed) if fixed else F.lit("")))
        rows = rows.join(table, F.col("__want") == F.col(f"__key{i}"), "left").drop("__want", f"__key{i}")
        one = F.col(f"__found{i}")
        found.append(F.when(one.isNotNull(), F.struct(one["route"].alias("route"), F.transform_values(one["places"], _segment(n, wild)).alias("params"))))
    best = F.coalesce(*found) if found else F.lit(None).cast("struct<route string, params map<string,string>>")
    return rows.withColumn("__best", best).select(*kept, F.col("__best.route").alias("route"), F.col("__best.params").alias("params"))


def run_lengths(df: DataFrame, entity: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: ``run`` (from 1), the value, its first order key and ``length``. Nulls equal nulls."""
    w = Window.partitionBy(*entity).orderBy(*order)
    new = (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    marked = df.withColumn("__new", new.cast("int"))
    numbered = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*entity, "run").agg(F.first(value).alias(value), F.min(F.struct(*order)).alias("first"), F.count("*").alias("length"))


def zip_by_place(a: DataFrame, b: DataFrame, place: str) -> DataFrame:
    """Rows of two frames of one place side by side; places of one side only are left out."""
    return a.join(b, place)


def lacking(part: str, whole: str) -> Column:
    """Elements of one array that the other lacks."""
    return F.array_except(part, whole)
