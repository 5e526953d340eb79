"""Sets of word shingles: classes of equal sets, a count sketch, rarest shingles, exact similarity.

``t`` is a Jaccard similarity of two sets: those in both over those in either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.wordhash import list_parts, mix, order_in
from tracemill.session import cut

#: Least and most counters of the sketch, 8 bytes each: 32 MB at most, however large the collection.
COUNTERS = 1 << 16, 1 << 22
#: Counters of the sketch that are summed up together.
BLOCK = 1 << 12
#: Bits of a filter of hashes: this many for each, between two bounds (32 MB at most), made in blocks; for over half the upper bound hashes there is none.
FILTER_BITS, FILTER, FILTER_BLOCK = 8, (1 << 18, 1 << 28), 1 << 18
#: Most keys (8 bytes each) that are sent to every task.
MOST_SENT = 1_000_000
_SALTS = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def signatures(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of distinct grams, whatever their order."""
    out = []
    for salt in _SALTS:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ salt), dtype=np.uint64)])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def kept(n: np.ndarray, t: float) -> np.ndarray:
    """How many of ``n`` grams any set of similarity ``t`` to it must share."""
    return np.ceil(t * n - 1e-9).astype(np.int64)


def probes(n: np.ndarray, t: float) -> np.ndarray:
    """So many grams of a set, whichever, contain one that every similar set has."""
    return n - kept(n, t) + 1


def fingerprints(grams: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """Parity fingerprints: bit i of a set is the parity of its grams that leave i when divided by ``bits``, a multiple of 64.

    A gram in one of two sets only flips one bit at most, so the Hamming distance
    of their fingerprints never exceeds the number of such grams.
    """
    rows = len(bounds) - 1
    at = np.repeat(np.arange(rows), np.diff(bounds)) * bits + (grams % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def hamming(a: str, b: str, words: int) -> Column:
    """The distance of two fingerprints in columns ``<a>0`` and so on."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(words)))


def row_ids() -> Iterator[int]:
    """Numbers for the rows a task makes: no two tasks make the same, a task run again makes the same ones.

    Only numbers that were written by :func:`tracemill.session.cut` may be relied on.
    """
    first = TaskContext.get().partitionId() << 33
    return count(first)


def copies_of(units: DataFrame, key: list[str], *flags: Column) -> tuple[DataFrame, DataFrame]:
    """``(several, copies)`` of rows that are alike in ``key``, told apart by ``row``.

    ``several`` has a row per class of two or more rows: its key, ``cls`` (its smallest
    row), ``copies`` and the flags; ``copies`` the ``row`` and ``cls`` of the other rows.
    A row in neither is a class of its own.
    """
    classes = units.groupBy(*key).agg(F.min("row").alias("cls"), F.count("*").alias("copies"), *flags)
    several = cut(classes.where("copies > 1"), "several")
    of = [units[c].eqNullSafe(several[c]) for c in key]
    return several, cut(units.join(several, of).where("row <> cls").select("row", "cls"), "copies")


def sketch(sets: DataFrame, grams, total: int) -> np.ndarray:
    """Counts of all grams of all rows, by the last bits of the gram.

    ``grams(batch)`` gives the values of a batch in parts, ``total`` is about how many there
    are in all; it decides the size. Each task sums its rows into one vector of bounded
    size. Its blocks are shuffled and summed, so that no task reads a vector of every other.
    """
    size = min(max(1 << max(total // 8, 1).bit_length(), COUNTERS[0]), COUNTERS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in grams(batch):
                np.add.at(total, (part & np.uint64(size - 1)).astype(np.int64), 1)
        yield packed({i: x for i, x in enumerate(total.reshape(-1, BLOCK)) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(x), np.int64)
                blocks[i] = blocks[i] + part if i in blocks else part
        yield packed(blocks)

    def packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        values = [zlib.compress(x.tobytes(), 1) for x in blocks.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(values, pa.binary())], ["block", "counts"])

    out = np.zeros((size // BLOCK, BLOCK), np.int64)
    parts = sets.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary")
    for row in parts.toLocalIterator():  # one row a block
        out[row.block] += np.frombuffer(zlib.decompress(row.counts), np.int64)
    return out.ravel()


def hash_filter(hashes: DataFrame, column: str, n: int) -> np.ndarray | None:
    """Bits of about ``n`` hashes; each block of them is made by one task. None if there are too many for a filter."""
    if 2 * n > FILTER[1]:
        return None
    size = min(max(1 << (FILTER_BITS * n).bit_length(), FILTER[0]), FILTER[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            h = (np.asarray(batch.column(0)).view(np.uint64) & np.uint64(size - 1)).astype(np.int64)
            for i in np.unique(h // FILTER_BLOCK).tolist():
                blocks.setdefault(i, np.zeros(FILTER_BLOCK, bool))[h[h // FILTER_BLOCK == i] % FILTER_BLOCK] = True
        packed = [np.packbits(x, bitorder="little").tobytes() for x in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

    bits = np.zeros((size // FILTER_BLOCK, FILTER_BLOCK // 8), np.uint8)
    blocks = hashes.select(column).repartition(F.expr(f"({column} & {size - 1}L) div {FILTER_BLOCK}"))
    for row in blocks.mapInArrow(mark, "block int, bits binary").toLocalIterator():
        bits[row.block] |= np.frombuffer(row.bits, np.uint8)
    return bits.ravel()


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter; all that are."""
    h = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0


def ranks(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """An order of grams, rare ones first by the sketch, the same for all rows."""
    often = counts[(grams & np.uint64(len(counts) - 1)).astype(np.int64)] >> max(0, int(counts.max(initial=0)).bit_length() - 24)
    return (often.astype(np.uint64) << np.uint64(40)) | (grams >> np.uint64(24))


def rarest(grams: np.ndarray, bounds: np.ndarray, counts: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct ascending grams of sets, where the rarest are that every similar set shares one of, their rows and ranks in the row.

    If two sets are similar, the rarest gram they share is among these in both.
    """
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    order = order_in(ranks(grams, counts), bounds)
    most = np.minimum(n, probes(n, t))
    take = first_of(order, bounds, most)
    return take, row[take], np.arange(len(take)) - np.repeat(np.cumsum(most) - most, most)


def packed(n: np.ndarray, place: np.ndarray, flag: np.ndarray | int = 0) -> pa.Array:
    """Size of a set, place of a gram and a flag as one number, so that the rows of a join are small."""
    return pa.array(n.astype(np.int64) << 32 | place.astype(np.int64) << 1 | flag)


def size_sql(at: str) -> str:
    return f"shiftright({at}, 32)"


def meet_sql(a: str, b: str, t: float) -> str:
    """Sets that meet at a gram, with sizes and places packed in ``a`` and ``b``, can be similar: enough grams are left in both."""
    na, nb = size_sql(a), size_sql(b)
    place = lambda x: f"shiftright({x} & 4294967295L, 1)"
    return f"least({na}, {nb}) >= {t!r}D * greatest({na}, {nb}) - 1e-9D and least({na} - {place(a)}, {nb} - {place(b)}) >= {least_common_sql(na, nb, t)}"


def only_of(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among ``wanted`` (a written frame of one column), where these are few enough to be sent to
    every task; else all rows: it only spares a shuffle what the join behind it drops."""
    few = wanted.distinct()
    return rows.join(F.broadcast(few.toDF(key)), key, "left_semi") if few.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def first_of(order: np.ndarray, bounds: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of rows sorted part by part, the places of the first ``most`` of each part."""
    n = np.minimum(np.diff(bounds), most)
    return order[np.repeat(bounds[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def common(a: np.ndarray, ab: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """How many values the distinct ascending sets a[i] and b[i] share, for all i."""
    out = np.zeros(len(ab) - 1, np.int64)
    for i, (p, q, r, s) in enumerate(zip(ab[:-1].tolist(), ab[1:].tolist(), bb[:-1].tolist(), bb[1:].tolist())):
        x, y = a[p:q], b[r:s]
        if len(x) and len(y):
            out[i] = np.count_nonzero(y[np.minimum(y.searchsorted(x), len(y) - 1)] == x)
    return out


def least_common(na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    """The common grams two sets of these sizes need for similarity ``t``."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)


def least_common_sql(na: str, nb: str, t: float) -> str:
    return f"ceil({t / (1 + t)!r}D * ({na} + {nb}) - 1e-9D)"


def most_apart_sql(na: str, nb: str, t: float) -> str:
    """The most grams that may be in one of two similar sets only."""
    return f"{na} + {nb} - 2 * {least_common_sql(na, nb, t)}"


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    return list_parts(column(batch, name))


def parts_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
