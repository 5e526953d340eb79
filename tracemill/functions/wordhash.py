"""Words of texts as 64-bit hashes, a whole Arrow batch at once.

A word is a longest run of a-z and 0-9 in the lower-cased text. The bytes of a
batch are classified through one lookup table, word bounds come from shifted
masks, and word hashes from prefix sums of a polynomial modulo 2**64, so no
Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; bounds the size of the tables of powers.
BLOCK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _BYTE[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _BYTE[_c] = _c + 32

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]).cumprod(dtype=np.uint64)
        _inverse = np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]).cumprod(dtype=np.uint64)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (that of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array | pa.ChunkedArray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds between them; a null text is empty.

    Of the characters beyond ASCII only two have an ASCII letter in their lower
    case; with ``fold`` they are written out here, all others merely part words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for wide, low in (("\u0130", "i\u0307"), ("\u212a", "k")):
        if fold and len(texts) and pc.any(pc.match_substring(texts, wide)).as_py():
            texts = pc.replace_substring(texts, wide, low)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def scan_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, hashes)`` of the words between ``bounds`` in ``raw``."""
    n, at, parts = len(raw), 0, []
    low = _BYTE[raw]
    is_bound = np.zeros(n + 1, bool)
    is_bound[bounds] = True
    while at < n:
        to = min(n, at + BLOCK)
        while to < n and low[to - 1] and low[to] and not is_bound[to]:  # not within a word
            tail = low[to : to + BLOCK]
            stop = np.flatnonzero((tail == 0) | is_bound[to : to + len(tail)])
            to = to + int(stop[0]) if len(stop) else to + len(tail)
        part = low[at:to]
        word = part != 0
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | is_bound[at + 1 : to]
        end[:-1] &= ~word[1:] | is_bound[at + 1 : to]
        begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        powers, inverse = _tables(max(BLOCK, len(part)))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part.astype(np.uint64) * powers[: len(part)], dtype=np.uint64, out=sums[1:])
        parts.append((begins + at, ends + at, mix((sums[ends] - sums[begins]) * inverse[begins])))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: the words of text i are ``hashes[bounds[i]:bounds[i + 1]]``."""
    raw, bounds = text_bytes(texts)
    starts, _, hashes = scan_words(raw, bounds)
    return hashes, np.searchsorted(starts, bounds)


def grams_of(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words within one text, and their bounds."""
    sizes = np.maximum(0, np.diff(bounds) - (k - 1))
    out = np.concatenate([[0], np.cumsum(sizes)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], sizes)
    total = np.zeros(len(at), np.uint64)
    for i in range(k):
        total = total * _BASE + hashes[at + i]
    return mix(total), out


def order_in(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The places of all values, those of each part in ascending order of value, equal ones as they stand."""
    sizes = np.diff(bounds)
    if len(values) < 16 * len(sizes):  # many short parts: all of them at once
        return np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))
    order = np.arange(len(values))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        order[a:b] = values[a:b].argsort(kind="stable")
        order[a:b] += a
    return order


def distinct_in(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each part, ascending, and their bounds."""
    sizes = np.diff(bounds)
    part = np.repeat(np.arange(len(sizes)), sizes)
    if len(values) < 16 * len(sizes):  # many short parts: all of them at once
        values = values[np.lexsort((values, part))]
    else:
        values = values.copy()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (part[1:] != part[:-1])
    counts = np.bincount(part[keep], minlength=len(sizes))
    return values[keep], np.concatenate([[0], np.cumsum(counts)])


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The rows of a batch in parts whose texts in ``column`` have about ``most`` bytes.

    A longer text stays whole, with what fits beside it.
    """
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """An Arrow list of 64-bit integers from values and bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def list_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (unsigned) and bounds of an Arrow list of 64-bit integers without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    bounds = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values)
    return values[bounds[0] : bounds[-1]].view(np.uint64), bounds - bounds[0]
