"""Scalar functions as column expressions; all stay in the JVM, but for numbers too long for it."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def slugify(value: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one ``-``, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-"))


def words(value: Column) -> Column:
    """The runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9]+)"), F.lit(1))


def fizzbuzz(n: Column) -> Column:
    return F.when(n % 15 == 0, "FizzBuzz").when(n % 3 == 0, "Fizz").when(n % 5 == 0, "Buzz").otherwise(n.cast("string"))


def convert_temperature(value: Column) -> Column:
    """``212F`` to ``100C`` and back, rounded to whole degrees; ``invalid`` for anything else."""
    degrees = F.regexp_extract(value, r"^(-?[0-9]+)[FC]\z", 1)
    n = F.when(degrees != "", degrees.try_cast("double"))
    other = F.when(value.endswith("F"), F.concat(F.round((n - 32) * 5 / 9).cast("bigint").cast("string"), F.lit("C"))).otherwise(
        F.concat(F.round(n * 9 / 5 + 32).cast("bigint").cast("string"), F.lit("F"))
    )
    return F.when(value.isNull(), F.lit(None).cast("string")).when(n.isNull(), "invalid").otherwise(other)


def last_wins(entries: Column) -> Column:
    """An array of ``struct(key, value)`` as a map in which the last of equal keys counts; its keys are in order."""
    placed = F.array_sort(F.transform(entries, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"), x["value"].alias("value"))))
    following = F.concat(F.slice(F.transform(placed, lambda x: x["key"]), F.lit(2), F.greatest(F.size(placed), F.lit(1))), F.array(F.lit(None).cast("string")))
    marked = F.zip_with(placed, following, lambda x, key: F.when(x.isNotNull() & ((x["key"] != key) | key.isNull()), F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    return F.map_from_entries(F.array_compact(marked))


def _pair(text: Column, delimiter: str, strip: bool) -> Column:
    at = F.instr(text, delimiter)
    key = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    value = F.when(at > 0, F.substr(text, at + len(delimiter))).otherwise("")
    if strip:
        key, value = F.trim(key), F.trim(value)
    return F.struct(key.alias("key"), value.alias("value"))


def query_string(value: Column) -> Column:
    """A query string as a map: an optional ``?``, percent escapes decoded, empty parts ignored,
    parted at the first ``=``, the last of equal names counts. A plus stays a plus."""
    decode = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    parts = F.filter(F.split(F.regexp_replace(value, r"^\?", ""), "&"), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(decode(_pair(x, "=", False)["key"]).alias("key"), decode(_pair(x, "=", False)["value"]).alias("value")))
    return last_wins(F.filter(pairs, lambda x: x["key"].isNotNull()))


def parse_fields(value: Column, delimiter: str = ":") -> Column:
    """Lines ``key: value`` as a map: blank lines ignored, both sides stripped, the last of equal keys counts."""
    lines = F.filter(F.split(value, r"\r?\n"), lambda x: (F.trim(x) != "") & (F.instr(x, delimiter) > 0))
    return last_wins(F.transform(lines, lambda x: _pair(x, delimiter, True)))


def rle_encode(value: Column) -> Column:
    """``aaab`` as ``3a1b``."""
    runs = F.regexp_extract_all(value, F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.length(x).cast("string"), F.substring(x, 1, 1))), "")


def rle_decode(value: Column) -> Column:
    """``3a1b`` as ``aaab``; null if the text isn't counts and characters in turn."""
    counts = F.regexp_extract_all(value, F.lit(r"(?s)([0-9]+)([^0-9])"), F.lit(1))
    chars = F.regexp_extract_all(value, F.lit(r"(?s)([0-9]+)([^0-9])"), F.lit(2))
    out = F.array_join(F.zip_with(counts, chars, lambda n, c: F.repeat(c, n.cast("int"))), "")
    return F.when(value.rlike(r"(?s)^([0-9]+[^0-9])*\z"), out)


def clamped(value: Column, low: Column | float, high: Column | float) -> Column:
    """Each value within bounds."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, as_column(low)), as_column(high))


def window_sums(values: Column, size: int) -> Column:
    """Sums of all windows of ``size`` neighbours; none if the array is shorter."""
    if size <= 0:
        raise ValueError("a window has at least one element")
    starts = F.when(F.size(values) >= size, F.sequence(F.lit(1), F.size(values) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.aggregate(F.slice(values, i, size), F.lit(0).cast("bigint"), lambda a, x: a + x))


def rotate_right(values: Column, k: Column | int) -> Column:
    """The array rotated right by any whole number of places."""
    n = F.size(values)
    by = F.pmod(k if isinstance(k, Column) else F.lit(k), n)
    return F.when(n <= 0, values).otherwise(F.concat(F.slice(values, n - by + 1, by), F.slice(values, F.lit(1), n - by)))


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


#: White space that is stripped from cells, as a class of a regular expression. Fixed values.
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def coerce_cell(value: Column) -> Column:
    """A cell's type and value: ``null``, ``int``, ``float`` or ``str``, as ``struct(t, i, d, s)``.

    White space at the ends doesn't count. Digits with a leading zero, a plus sign or an exponent make a
    string. Integers have any number of digits; ``i`` is their text (``-0`` is ``0``).
    """
    cell = F.regexp_replace(value, f"^{_BLANK}+|{_BLANK}+\\z", "")
    is_int, is_float = cell.rlike(r"^-?(0|[1-9][0-9]*)\z"), cell.rlike(r"^-?(0|[1-9][0-9]*)\.[0-9]+\z")
    kind = F.when(cell.isNull() | (cell == ""), "null").when(is_int, "int").when(is_float, "float").otherwise("str")
    return F.struct(
        kind.alias("t"),
        F.when(is_int, F.when(cell == "-0", "0").otherwise(cell)).alias("i"),
        F.when(is_float, cell.try_cast("double")).alias("d"),
        F.when(kind == "str", cell).alias("s"),
    )


@F.pandas_udf(BooleanType())
def _exactly_close(a: pd.Series, b: pd.Series, tolerance: pd.Series) -> pd.Series:
    def number(text):
        try:
            out = Decimal(text)
        except InvalidOperation:
            return None
        return out if out.is_finite() and abs(out.adjusted()) <= 10_000 else None

    def one(*texts):
        if None in texts:
            return None
        x, y, most = map(number, texts)
        if x is None or y is None or most is None:
            return None
        low = min(n.as_tuple().exponent for n in (x, y, most))
        with localcontext() as context:
            context.prec = max(n.adjusted() for n in (x, y, most)) - low + 3
            return abs(x - y) <= most

    return pd.Series([one(*x) for x in zip(a, b, tolerance)], dtype=object)


def decimal_close(a: Column, b: Column, tolerance: Column | float | str) -> Column:
    """Whether two decimal texts differ by at most the tolerance, to the last digit; null if one is no number.

    Numbers of up to 20 digits before and 18 after the point stay in the JVM; others are compared in Python.
    """
    limit = tolerance.cast("string") if isinstance(tolerance, Column) else F.lit(f"{Decimal(str(tolerance)):f}")
    few = lambda c: c.rlike(r"^-?[0-9]{1,19}(\.[0-9]{1,18})?\z")
    fits = F.coalesce(few(a) & few(b) & few(limit), F.lit(False))
    x, y, most = (F.when(fits, c).try_cast("decimal(38,18)") for c in (a, b, limit))
    return F.coalesce(F.abs(x - y) <= most, _exactly_close(*(F.when(~fits, c) for c in (a, b, limit))))


def is_plain_path(path: Column) -> Column:
    """A relative path without empty parts, ``.`` or ``..``."""
    return F.coalesce((path != "") & ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", "..")), F.lit(False))


#: How names have to look. Fixed values.
TASK_ID, LICENSE, CASE_ID = r"^[a-z0-9][a-z0-9._/-]{2,127}\z", r"^[A-Za-z0-9][A-Za-z0-9.+-]{0,63}\z", r"^[a-z0-9][a-z0-9._-]{0,79}\z"


def fits(value: Column, pattern: str) -> Column:
    """Whether a text has the form of TASK_ID, LICENSE or CASE_ID; a null has none."""
    return F.coalesce(value.rlike(pattern), F.lit(False))


def is_base_url(url: Column) -> Column:
    """https anywhere, http on this machine only; no user, query or fragment; a port in range."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    port = F.regexp_extract(part("AUTHORITY"), r":([0-9]+)\z", 1)
    local = part("HOST").isin("127.0.0.1", "[::1]", "::1")
    fine = (part("PROTOCOL") == "https") | ((part("PROTOCOL") == "http") & local)
    clean = part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull() & part("HOST").isNotNull()
    return F.coalesce(fine & clean & ((port == "") | port.try_cast("bigint").between(1, 65535)), F.lit(False))


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The text with ``old`` replaced; null unless it stands there exactly once."""
    times = (F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)
    return F.when((F.length(old) > 0) & (times == 1), F.replace(text, old, new))


def numbered_lines(text: Column, first: int, most: int = 400) -> Column:
    """Lines ``first`` onwards as ``n:line``, with all lines counted and whether some are left out."""
    lines = F.split(text, "\n")
    picked = F.slice(lines, first, most)
    return F.struct(
        F.array_join(F.transform(picked, lambda x, i: F.concat((i + first).cast("string"), F.lit(":"), x)), "\n").alias("text"),
        F.size(lines).alias("total_lines"),
        (F.size(lines) > first + most - 1).alias("truncated"),
    )


def pad_bucket(length: Column, longest: int, step: int = 32) -> Column:
    """The padded length of a sequence: one over a multiple of ``step``, at most ``longest``."""
    return F.least((F.ceil(length / step) * step + 1).cast("bigint"), F.lit(longest).cast("bigint"))


def pad(values: Column, size: Column, fill: Column) -> Column:
    """An array filled up to a size, or cut to it."""
    return F.concat(F.slice(values, F.lit(1), size.cast("int")), F.array_repeat(fill, F.greatest(size - F.size(values), F.lit(0)).cast("int")))


def span_mask(tokens: Column, start: Column, end_token: int) -> Column:
    """True from ``start`` (from 0) to the first ``end_token`` there, inclusive; all false without one."""
    after = F.slice(tokens, start + 1, F.greatest(F.size(tokens) - start, F.lit(0)))
    stop = F.array_position(after, F.lit(end_token)).cast("int")
    return F.transform(tokens, lambda _, i: (stop > 0) & (i >= start) & (i < start + stop))


def masked_mean(value: Column, mask: Column) -> Column:
    """An aggregate: the mean where the mask is true; null if it never is."""
    weight = F.coalesce(mask.cast("int"), F.lit(0))
    return F.try_divide(F.sum(F.when(weight == 1, value).otherwise(F.lit(0.0))), F.sum(weight))
