"""JSON as VARIANT, with the strictness that casts lose: a boolean is no number, null isn't missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_one(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing else; null otherwise.

    ``try_parse_json`` takes text after the value; within brackets it can't.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = boxed.cast("array<variant>")
    return F.when(F.size(items) == 1, items[0])


def at(value: Column, path: str) -> Column:
    """The value at a path, null if there is none (a JSON null is a value)."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``boolean``, ``integer``, ``number`` or ``null``; null if missing."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(schema == "VOID", "null")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "BIGINT", "integer")
        .otherwise("number")
    )


def items(value: Column) -> Column:
    """The elements of an array; null for anything else."""
    return F.when(kind(value) == "array", value.cast("array<variant>"))


def text(value: Column) -> Column:
    """A string; null for anything else."""
    return F.when(kind(value) == "string", value.cast("string"))


def integer(value: Column) -> Column:
    """An integer or an integral number, never a boolean; null for anything else."""
    number = F.when(kind(value).isin("integer", "number"), value.cast("double"))
    return F.when(number == F.floor(number), number.cast("bigint"))


def number(value: Column) -> Column:
    """A number, never a boolean; null for anything else."""
    return F.when(kind(value).isin("integer", "number"), value.cast("double"))


def is_true(value: Column) -> Column:
    """Exactly the JSON value true."""
    return F.coalesce((kind(value) == "boolean") & value.cast("boolean"), F.lit(False))


def arguments(value: Column) -> Column:
    """An object, or the object whose JSON text a string is; null for anything else."""
    inner = parse_one(text(value))
    return F.when(kind(value) == "object", value).when(kind(inner) == "object", inner)


def flat_text(content: Column) -> Column:
    """A text as it is; a list of ``{"type": "text", "text": ...}`` joined by line ends; missing is empty.

    Null where the content has another shape.
    """
    part = lambda x: F.when((text(at(x, "$.type")) == "text"), text(at(x, "$.text")))
    parts = F.transform(items(content), part)
    return (
        F.when(content.isNull(), "")
        .when(kind(content) == "string", text(content))
        .when(F.coalesce(F.forall(parts, lambda x: x.isNotNull()), F.lit(False)), F.array_join(parts, "\n"))
    )
