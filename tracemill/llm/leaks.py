"""Evaluation texts leaking into training text, by greedy string tiling.

Seeds are Karp-Rabin hashes of ``min_words`` consecutive words that an item and
a document share. The seeds of a pair are extended along their diagonal into
maximal matches; the longest match is marked as a tile, what overlaps it is
shortened, and so on until no match of ``min_words`` is left. The share of an
item's words under tiles is its coverage, whatever the order of the passages.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.wordhash import grams_of, slices, words_of
from tracemill.llm.shingles import hash_filter, may_hold
from tracemill.session import cut

#: Items of up to so many bytes of text go to every task; beyond, seeds are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_FILTER = 1 << 20

TILES = "doc_id bigint, item_id bigint, n_tiles int, tile_words int, longest int, item_words int, coverage double"


def tiles(item: np.ndarray, doc: np.ndarray, least: int, most_seeds: int = 4_000_000) -> list[tuple[int, int, int]]:
    """Tiles ``(item position, document position, words)`` of two word sequences, longest first.

    Ties go to the earlier item position, then the earlier document position.
    A word of either side lies in one tile at most. Beyond ``most_seeds`` matches
    of ``least`` words the tiles, the same ones, are found without listing matches.
    """
    if len(item) < least or len(doc) < least:
        return []
    a, _ = grams_of(item, np.array([0, len(item)]), least)
    b, _ = grams_of(doc, np.array([0, len(doc)]), least)
    order = np.argsort(a, kind="stable")
    at = np.flatnonzero(np.isin(b, a))
    left, right = np.searchsorted(a[order], b[at]), np.searchsorted(a[order], b[at], "right")
    if int((right - left).sum()) > most_seeds:
        return _tiles_by_length(item, doc, least, np.flatnonzero(np.isin(a, b)), at)
    n = right - left
    j = np.repeat(at, n)
    i = order[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j - i) != 0)
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(i)]) + least - 1
    heap = [(-int(s), int(i[k]), int(j[k])) for k, s in zip(start, size)]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        s, x, y = heapq.heappop(heap)
        taken = in_item[x : x - s] | in_doc[y : y - s]
        if not taken.any():
            in_item[x : x - s] = in_doc[y : y - s] = True
            out.append((x, y, -s))
            continue
        free = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))  # starts and ends of what is free
        for p, q in zip(free[::2], free[1::2]):
            if q - p >= least:
                heapq.heappush(heap, (-int(q - p), x + int(p), y + int(p)))
    return out


def _tiles_by_length(item: np.ndarray, doc: np.ndarray, least: int, at_item: np.ndarray, at_doc: np.ndarray) -> list[tuple[int, int, int]]:
    """The same tiles, all of a length at a time: of the greatest length that free words still share, then the next.

    ``at_item`` and ``at_doc`` are where shared sequences of ``least`` words begin. A
    sequence of any length is named by the ranks of the two powers of two that
    cover it. Lengths differ from round to round, so that rounds are at most as
    the root of the words, each a few sorts.
    """
    ranks = [np.unique(np.r_[item, doc], return_inverse=True)[1].astype(np.int32)]
    n, whole = len(item), len(item) + len(doc)
    side = np.r_[np.full(n, n), np.full(len(doc), whole)]  # where each word's text ends

    def names(at: np.ndarray, size: int) -> np.ndarray:
        k = size.bit_length() - 1
        while len(ranks) <= k:
            half, last = 1 << (len(ranks) - 1), ranks[-1]
            begin = np.flatnonzero(np.arange(whole) + 2 * half <= side)
            longer = np.full(whole, -1, np.int32)
            longer[begin] = np.unique(last[begin].astype(np.int64) << 32 | last[begin + half], return_inverse=True)[1]
            ranks.append(longer)
        return ranks[k][at].astype(np.int64) << 32 | ranks[k][at + size - (1 << k)]

    def shared(size: int) -> tuple[np.ndarray, ...]:
        """Places of both sides from which ``size`` free words begin that the other has too, with their names."""
        x, y = at_item[room_item >= size], at_doc[room_doc >= size]
        p, q = names(x, size), names(y + n, size)
        in_both = np.isin(p, q), np.isin(q, p)
        return x[in_both[0]], y[in_both[1]], p[in_both[0]], q[in_both[1]]

    def room(free: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many free words begin at each place."""
        taken = np.r_[np.flatnonzero(~free), len(free)]
        return taken[np.searchsorted(taken, at)] - at

    free_item, free_doc, out = np.ones(n, bool), np.ones(len(doc), bool), []
    most = min(n, len(doc))
    while True:
        room_item, room_doc = room(free_item, at_item), room(free_doc, at_doc)
        at_item, room_item = at_item[room_item >= least], room_item[room_item >= least]
        at_doc, room_doc = at_doc[room_doc >= least], room_doc[room_doc >= least]
        if most < least or not len(shared(least)[0]):
            return out
        low = least
        while low < most and len(shared(min(2 * low, most))[0]):
            low = min(2 * low, most)
        high = min(2 * low - 1, most)
        while low < high:  # the greatest shared length
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)[0]) else (low, middle - 1)
        x, y, p, q = shared(low)
        by = np.argsort(q, kind="stable")
        y, q = y[by], q[by]
        place = np.searchsorted(q, p).tolist()
        end = np.searchsorted(q, p, "right").tolist()
        following = dict(zip(place, place))
        for i, first, to in zip(x.tolist(), place, end):
            if not (free_item[i] and free_item[i + low - 1]):
                continue
            k = following[first]
            while k < to and not (free_doc[y[k]] and free_doc[y[k] + low - 1]):
                k += 1
            following[first] = k
            if k < to:
                free_item[i : i + low] = free_doc[y[k] : y[k] + low] = False
                out.append((i, int(y[k]), low))
        most = low - 1


def _row(doc: int, item: int, words: np.ndarray, text: np.ndarray, least: int) -> tuple | None:
    found = tiles(words, text, least)
    if not found:
        return None
    covered = sum(s for _, _, s in found)
    return doc, item, len(found), covered, found[0][2], len(words), covered / len(words)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    names = ["doc_id", "item_id", "n_tiles", "tile_words", "longest", "item_words", "coverage"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    min_words: int = 12,
    min_coverage: float = 0.0,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Documents with a passage of ``min_words`` consecutive words of an item.

    One row per document and item: the number of tiles, words under them, the
    longest tile, the item's words and their share under tiles, at least
    ``min_coverage``. A null id, a null, empty or too short text matches
    nothing; equal rows each give their own row; other columns are ignored.
    Items whose texts exceed ``broadcast_bytes`` are joined on their seeds by a
    shuffle instead of being sent to all tasks, with the same result.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    held = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("item_text")).where("item_id is not null and item_text is not null")
    size = held.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        out = _scan(docs, held, min_words)
    else:
        out = _joined(docs, held, min_words)
    return out.where(F.col("coverage") >= min_coverage) if min_coverage > 0 else out


def _scan(docs: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """One pass over the documents; the items, of checked size, are in every task."""
    rows = held.collect()  # at most broadcast_bytes
    words, bounds = words_of(pa.array([r.item_text for r in rows], pa.string()))
    grams, at = grams_of(words, bounds, least)
    owner = np.repeat(np.arange(len(rows)), np.diff(at))
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    known, first = np.unique(grams, return_index=True)
    first = np.r_[first, len(grams)]
    ids = np.array([r.item_id for r in rows], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((words, bounds, known, first, owner, ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bounds, known, first, owner, ids = shared.value
        maybe = np.zeros(_FILTER, bool)
        maybe[(known & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        for whole in batches:
            for batch in slices(whole, "text"):
                doc_ids = np.asarray(batch.column(0))
                text, edges = words_of(batch.column(1))
                seeds, begin = grams_of(text, edges, least)
                hit = np.flatnonzero(maybe[(seeds & np.uint64(_FILTER - 1)).astype(np.int64)])
                if not len(hit) or not len(known):
                    continue
                place = np.minimum(np.searchsorted(known, seeds[hit]), len(known) - 1)
                good = known[place] == seeds[hit]
                hit, place = hit[good], place[good]
                doc = np.searchsorted(begin, hit, "right") - 1
                n = first[place + 1] - first[place]
                of = owner[np.repeat(first[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                pairs = np.unique(np.repeat(doc, n) * len(ids) + of)
                out = []
                for p in pairs.tolist():
                    d, i = divmod(p, len(ids))
                    row = _row(int(doc_ids[d]), int(ids[i]), words[bounds[i] : bounds[i + 1]], text[edges[d] : edges[d + 1]], least)
                    if row:
                        out.append(row)
                if out:
                    yield _batch(out)

    return docs.mapInArrow(scan, TILES)


def _joined(docs: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """Seeds of both sides meet in a shuffle; then each pair is tiled from its texts.

    Of the documents only seeds that pass a filter of the items' are shuffled, where
    the items have few enough for one. Rows are told apart by a row key, so that
    repeated ids keep their own rows.
    """

    def seeds(of: str, key: str, known=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, of):
                    words, bounds = words_of(batch.column(batch.schema.get_field_index(of)))
                    grams, at = grams_of(words, bounds, least)
                    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                    if known is not None:
                        good = may_hold(known.value, grams)
                        grams, row = grams[good], row[good]
                    ids = batch.column(batch.schema.get_field_index(key)).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), ids], ["seed", key])

        return run

    docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    held = held.withColumn("item_key", F.xxhash64("item_id", "item_text"))
    b = cut(held.mapInArrow(seeds("item_text", "item_key"), "seed bigint, item_key bigint").distinct(), "seeds")
    bits = hash_filter(b, "seed", b.count())
    known = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)
    a = docs.mapInArrow(seeds("text", "doc_key", known), "seed bigint, doc_key bigint").distinct()
    pairs = a.join(b, "seed").select("doc_key", "item_key").distinct()
    whole = pairs.join(docs, "doc_key").join(held, "item_key").select("doc_id", "item_id", "text", "item_text")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for outer in batches:
            for batch in slices(outer, "text"):
                x, xb = words_of(batch.column(2))
                y, yb = words_of(batch.column(3))
                ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                rows = [_row(d, i, y[yb[k] : yb[k + 1]], x[xb[k] : xb[k + 1]], least) for k, (d, i) in enumerate(ids)]
                yield _batch([r for r in rows if r])

    return whole.mapInArrow(tile, TILES)
