"""Records of evaluation splits that also stand, exactly or almost, in train.

Winnowing: of each window of consecutive rolling hashes of some words the
minimum is selected, in an order that puts rare hashes first. The selected
hashes of the two sides meet in one join. The seeds a pair of texts shares are
chained where they lie in the same order, the chain is extended word by word,
and the words under it are the coverage. An exact count of the common shingles
decides.

Window minima alone may miss a pair: a shared hash that is the minimum of its
window in one text needn't be in the other. So that none is missed both sides
select their n - ceil(t n) + 1 rarest hashes, most of which are window minima
(``winnowed`` tells of a pair whether minima of both met): of similar texts the
rarest hash they share is among these on both sides. Frequent minima are left
out, so boilerplate is a seed only in texts that are almost nothing else. With
each hash goes a parity fingerprint of the whole set; texts too far apart by it
are dropped within the join.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.wordhash import distinct_in, grams_of, order_in, slices, words_of
from tracemill.llm import shingles as S
from tracemill.session import cut

#: Consecutive hashes of which one is selected; a third of a text's at least, so for any threshold over 2/3.
WINDOW = 3
#: Words of the fingerprints that go with each hash into the join.
PRINT = 2


def _distinct(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_in(*grams_of(words, bounds, k))


def winnowed(keys: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Whether a place holds the minimum of a window; a part shorter than one is all selected."""
    n = len(keys)
    out = np.zeros(n, bool)
    if n:
        ends = np.repeat(bounds[1:], np.diff(bounds))
        whole = np.arange(n) + window <= ends  # a window starts here
        low = keys.copy()
        for i in range(1, window):
            low[: n - i] = np.minimum(low[: n - i], keys[i:])
        for i in range(min(window, n)):
            out[i:] |= whole[: n - i] & (keys[i:] == low[: n - i])
        out |= np.repeat(np.diff(bounds) < window, np.diff(bounds))
    return out


def align(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """``(seeds in the chain, words of a, words of b covered)`` of two word sequences.

    The places of a hash that repeats are paired in order, from the front and from
    the back, so that seeds are no more than twice the selected places.
    """
    if len(a) < k or len(b) < k:
        return 0, 0, 0
    ga, gb = grams_of(a, np.array([0, len(a)]), k)[0], grams_of(b, np.array([0, len(b)]), k)[0]
    at = [np.flatnonzero(winnowed(g, np.array([0, len(g)]), WINDOW)).tolist() for g in (ga, gb)]
    places: list[dict[int, list[int]]] = [{}, {}]
    for known, g, chosen in zip(places, (ga, gb), at):
        for i in chosen:
            known.setdefault(int(g[i]), []).append(i)
    seeds = []
    for h, mine in places[0].items():
        other = places[1].get(h, [])
        n = min(len(mine), len(other))
        seeds += set(zip(mine, other)) | set(zip(mine[len(mine) - n :], other[len(other) - n :]))
    seeds.sort(key=lambda s: (s[0], -s[1]))
    tails: list[int] = []  # longest chain with i and j both ascending; of one i the j come descending
    last: list[int] = []
    back = [-1] * len(seeds)
    for s, (_, j) in enumerate(seeds):
        p = bisect_left(tails, j)
        back[s] = last[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            last.append(s)
        else:
            tails[p], last[p] = j, s
    chain, s = [], last[-1] if last else -1
    while s >= 0:
        chain.append(seeds[s])
        s = back[s]
    chain.reverse()
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    la, lb = a.tolist(), b.tolist()
    ea = eb = 0
    for i, j in chain:
        if i < ea and j < eb and i - j == ea - eb:  # lies under the last extension
            continue
        x, y = i, j
        while x > ea and y > eb and la[x - 1] == lb[y - 1]:
            x, y = x - 1, y - 1
        p, q = i, j
        while p < len(la) and q < len(lb) and la[p] == lb[q]:
            p, q = p + 1, q + 1
        in_a[x:p] = True
        in_b[y:q] = True
        ea, eb = max(ea, p), max(eb, q)
    return len(chain), int(in_a.sum()), int(in_b.sum())


def _units(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = S.row_ids()
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, at = _distinct(*words_of(S.column(batch, "text")), k)
                n = np.diff(at)
                out = pa.RecordBatch.from_arrays(
                    [pa.array([next(ids) for _ in range(batch.num_rows)], pa.int64()), *(S.column(batch, c) for c in ("record_id", "field", "held")), *map(pa.array, S.signatures(grams, at)), pa.array(n.astype(np.int32)), S.column(batch, "text")],
                    ["row", "record_id", "field", "held", "sig1", "sig2", "n", "text"],
                )
                yield out.filter(pa.array(n > 0))

    return run


SELECTED = "gram bigint, cls bigint, size bigint" + "".join(f", f{i} bigint" for i in range(PRINT))


def _selected(shared, t: float, k: int, known=None):
    """The rarest hashes of each class, marked if the minimum of a window; with a filter only those it knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                words, bounds = words_of(S.column(batch, "text"))
                grams, at = grams_of(words, bounds, k)
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                chosen = winnowed(S.ranks(grams, counts), at, WINDOW)
                order = order_in(grams, at)
                grams, row = grams[order], row[order]
                first = np.ones(len(grams), bool)
                first[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
                chosen = np.logical_or.reduceat(chosen[order], np.flatnonzero(first)) if len(grams) else chosen
                grams = grams[first]
                edges = np.searchsorted(row[first], np.arange(batch.num_rows + 1))
                prints = S.fingerprints(grams, edges, 64 * PRINT)
                take, r, place = S.rarest(grams, edges, counts, t)
                keys = grams[take] ^ np.asarray(S.column(batch, "field")).astype(np.uint64)[r]
                if known is not None:
                    good = S.may_hold(known.value, keys)
                    take, r, place, keys = take[good], r[good], place[good], keys[good]
                of = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), S.column(batch, "cls").take(of), S.packed(np.diff(edges)[r], place, chosen[take]), *map(pa.array, prints[r].T)],
                    [x.split()[0] for x in SELECTED.split(", ")],
                )

    return run


def _verified(t: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "held_text"):
                a, ab = words_of(S.column(batch, "held_text"))
                b, bb = words_of(S.column(batch, "train_text"))
                da, dab = _distinct(a, ab, k)
                db, dbb = _distinct(b, bb, k)
                both = S.common(da, dab, db, dbb)
                either = np.diff(dab) + np.diff(dbb) - both
                good = np.flatnonzero(both >= t * either - 1e-9)
                chains = [align(a[ab[i] : ab[i + 1]], b[bb[i] : bb[i + 1]], k) for i in good.tolist()]
                seeds, ca, cb = (np.array(x, np.int32) for x in (zip(*chains) if chains else ([], [], [])))
                r = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [*(S.column(batch, c).take(r) for c in ("held_cls", "train_cls", "winnowed")), pa.array((both / np.maximum(either, 1))[good]), pa.array(seeds), pa.array(ca / np.diff(ab)[good]), pa.array(cb / np.diff(bb)[good])],
                    ["held_cls", "train_cls", "winnowed", "similarity", "seeds", "held_coverage", "train_coverage"],
                )

    return run


def find_overlaps(records: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """Pairs of a held-out and a train record with a similar text.

    ``records`` has ``record_id`` bigint, ``field`` int (only texts of one field
    are compared), ``held`` boolean (true: held out, false: train) and ``text``.
    The result has a row per pair and field: ``record_id_held``,
    ``record_id_train``, ``field``, ``similarity`` (of their sets of ``shingle`` words, at least ``threshold``),
    ``seeds``, ``held_coverage``, ``train_coverage`` (share of words under the
    extended chain), ``winnowed`` (window minima of both met).

    Rows with a null in any of the four, and texts of fewer words,
    pair with nothing; other columns are ignored. Equal texts form one class,
    compared once and expanded at the end; an id given twice with one field
    appears for each of its texts.
    """
    t = threshold
    source = records.select(F.col("record_id").cast("bigint"), F.col("field").cast("int"), "held", "text").dropna()
    units = cut(source.mapInArrow(_units(shingle), "row bigint, record_id bigint, field int, held boolean, sig1 bigint, sig2 bigint, n int, text string"), "units")
    flags = F.max("held").alias("some_held"), F.max(~F.col("held")).alias("some_train")
    several, copies = S.copies_of(units.select("row", "field", "held", "sig1", "sig2"), ["field", "sig1", "sig2"], *flags)
    sides = several.select(F.col("cls").alias("row"), "some_held", "some_train")
    classes = units.join(copies.select("row"), "row", "left_anti").join(sides, "row", "left")
    classes = classes.select(F.col("row").alias("cls"), "field", "n", "text", F.coalesce("some_held", "held").alias("some_held"), F.coalesce("some_train", ~F.col("held")).alias("some_train"))
    context = units.sparkSession.sparkContext
    total = units.agg(F.sum("n")).first()[0] or 0
    counts = context.broadcast(S.sketch(classes.select("text"), lambda batch: (grams_of(*words_of(x.column(0)), shingle)[0] for x in slices(batch, "text")), total))
    shape = ["cls", "field", "text"]
    selected = classes.where("some_held").select(shape).mapInArrow(_selected(counts, t, shingle), SELECTED)
    about = units.where("held").agg(F.sum(F.ceil((1 - t) * F.col("n")) + 1)).first()[0] or 0
    bits = S.hash_filter(selected, "gram", about)
    known = None if bits is None else context.broadcast(bits)
    index = classes.where("some_train").select(shape).mapInArrow(_selected(counts, t, shingle, known), SELECTED)
    h, x = selected.alias("h"), index.alias("x")
    near = S.hamming("h.f", "x.f", PRINT) <= F.expr(S.most_apart_sql(S.size_sql("h.size"), S.size_sql("x.size"), t))
    pairs = cut(
        h.join(x, (F.col("h.gram") == F.col("x.gram")) & F.expr(S.meet_sql("h.size", "x.size", t)) & near)
        .groupBy(F.col("h.cls").alias("held_cls"), F.col("x.cls").alias("train_cls"))
        .agg(F.max(F.expr("(h.size & x.size & 1L) = 1")).alias("winnowed")),
        "met",
    )

    def texts(side: str) -> DataFrame:
        return S.only_of(classes.where(f"some_{side}").select(F.col("cls").alias(f"{side}_cls"), F.col("text").alias(f"{side}_text")), f"{side}_cls", pairs.select(f"{side}_cls"))

    found = (
        pairs.join(texts("held"), "held_cls")
        .join(texts("train"), "train_cls")
        .mapInArrow(_verified(t, shingle), "held_cls bigint, train_cls bigint, winnowed boolean, similarity double, seeds int, held_coverage double, train_coverage double")
    )
    members = units.select("row", "record_id", "field", "held").join(copies, "row", "left").withColumn("cls", F.coalesce("cls", "row"))
    return (
        found.join(members.where("held").select(F.col("cls").alias("held_cls"), "field", F.col("record_id").alias("record_id_held")), "held_cls")
        .join(members.where("not held").select(F.col("cls").alias("train_cls"), F.col("record_id").alias("record_id_train")), "train_cls")
        .select("record_id_held", "record_id_train", "field", "similarity", "seeds", "held_coverage", "train_coverage", "winnowed")
    )
