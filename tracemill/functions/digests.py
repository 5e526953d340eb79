"""Digests, signatures and counter-based draws."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def length_prefix(value: Column) -> Column:
    """The number of bytes as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(F.octet_length(value).cast("bigint")), 16, "0"))


def framed(*parts: Column) -> Column:
    """Each part behind its length, so that no two sequences of parts read the same."""
    return F.concat(*(F.concat(length_prefix(p), p.cast("binary")) for p in parts))


def framed_digest(domain: str, frames: Column) -> Column:
    """SHA-256 over a domain and an ordered array of binary frames."""
    whole = F.aggregate(frames, F.lit(domain.encode() + b"\0"), lambda a, x: F.concat(a, x))
    return F.sha2(whole, 256)


def draw(seed: Column, label: str, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high`` that seed and label determine."""
    head = F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(f":{label}")).cast("binary"), 256), 1, 16)
    big = F.conv(head, 16, 10).cast("decimal(20,0)")
    return (F.lit(low) + (big % F.lit(high - low + 1).cast("decimal(20,0)"))).cast("bigint")


def canonical(value) -> str:
    """JSON with sorted names and no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of a JSON text to the byte, numbers included; null if it isn't JSON."""

    def one(text):
        if text is None:
            return None
        try:
            return canonical(json.loads(text))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def call_of(call) -> dict | None:
    """``{"arguments", "name"}`` of a call as JSON has it; None if it is malformed. A nested ``function`` wins over flat fields."""
    inner = call.get("function") if isinstance(call, dict) and isinstance(call.get("function"), dict) else call
    name, arguments = (inner.get("name"), inner.get("arguments")) if isinstance(inner, dict) else (None, None)
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except (ValueError, RecursionError):
            return None
    return {"arguments": arguments, "name": name} if isinstance(name, str) and isinstance(arguments, dict) else None


@F.pandas_udf(StringType())
def call_signature(name: pd.Series, arguments: pd.Series) -> pd.Series:
    """A call's name and arguments (an object's JSON text) in canonical form; null if it is malformed."""
    found = (call_of({"name": n, "arguments": a}) for n, a in zip(name, arguments))
    return pd.Series([None if c is None else canonical(c) for c in found], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def call_signatures(calls: pd.Series) -> pd.Series:
    """Of a JSON list of calls the digests of those that aren't malformed, in order; empty for anything else.

    Equal calls (names and arguments in canonical form, ``1`` isn't ``1.0``) have equal digests.
    """

    def one(text):
        try:
            listed = json.loads(text) if text is not None and text != "[]" else []
        except (ValueError, RecursionError):
            return []
        found = map(call_of, listed if isinstance(listed, list) else ())
        return [hashlib.blake2b(canonical(c).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for c in found if c is not None]

    return calls.map(one)


def tree_order(entries: Iterable[tuple[str, bytes | None]]) -> list[tuple[str, bytes | None]]:
    """Entries of a tree folder by folder: what lies in a folder by name, then the folders below it, the last name first, each with all below it."""
    entries = list(entries)
    names = sorted({part for path, _ in entries for part in path.split("/")})
    behind = {name: -i for i, name in enumerate(names)}

    def key(entry: tuple[str, bytes | None]) -> tuple:
        *folders, name = entry[0].split("/")
        return tuple(behind[f] for f in folders), name

    return sorted(entries, key=key)


def tree_digest(entries: Iterable[tuple[str, bytes | None]], domain: str) -> str:
    """A digest of a tree of paths: directories (None) and files with their bytes.

    Entries are taken in :func:`tree_order`; each is a frame of its kind, path and content.
    """
    h = hashlib.sha256(domain.encode() + b"\0")
    for path, data in tree_order(entries):
        name = path.encode()
        h.update((b"D" if data is None else b"F") + len(name).to_bytes(8, "big") + name)
        if data is not None:
            h.update(len(data).to_bytes(8, "big") + data)
    return h.hexdigest()
