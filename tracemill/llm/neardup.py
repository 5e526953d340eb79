"""Near-duplicate records, by shared rare shingles and pivot distance tables.

A record is the set of its word shingles, its fingerprint a vector of parities
(see shingles.fingerprints). The Hamming distance of two fingerprints is at most
the number of shingles that only one of the sets has, and by the triangle
inequality the distances of the two to any reference fingerprint (a pivot)
differ by no more. Sets of sizes a and b and similarity t
have at most (a + b)(1 - t) / (1 + t) such shingles: pairs whose largest
difference of pivot distances is above that are discarded, and no similar pair
is. The survivors are verified, first by the distance of their fingerprints,
then by an exact count.

The table of distances doesn't find pairs by itself: distances of unrelated
sets to a pivot lie closer together than the bound, for any bound of t under
0.9, so cells of the table would hold nearly all records (figures in the
README). Pairs to look at are therefore those that share one of their rarest
shingles: of a set of n the n - ceil(t n) + 1 rarest, of the smaller set of a
pair the n - ceil(2 t n / (1 + t)) + 1 rarest, always meet if the pair is similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.wordhash import distinct_in, grams_of, words_of
from tracemill.llm import shingles as S
from tracemill.llm.components import connected_components
from tracemill.session import cut

#: Bits of the fingerprints the pivots are compared with, and words of the shorter ones within the join.
BITS, PRINT = 512, 3
#: Reference fingerprints, records drawn by hash: a fixed number, whatever the collection.
PIVOTS = 64


def distances(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, a row per fingerprint and a column per pivot."""
    out = np.zeros((len(prints), len(pivots)), np.uint16)
    for i, p in enumerate(pivots):
        out[:, i] = np.bitwise_count((prints ^ p).view(np.uint64)).sum(axis=1)
    return out


def shingles_of(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the texts of each row, each text for itself, and their bounds."""
    grams, at = grams_of(*words_of(texts.flatten()), k)
    offsets = np.asarray(texts.offsets)
    return grams, at[offsets - offsets[0]]


def sets_of(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the texts of each row, and their bounds."""
    return distinct_in(*shingles_of(texts, k))


def _prints(column: pa.Array) -> np.ndarray:
    """Fingerprints from a column of binaries."""
    return np.frombuffer(column.buffers()[2], np.int64)[: (column.offset + len(column)) * BITS // 64].reshape(-1, BITS // 64)[column.offset :]


def _units(k: int):
    """The rows with a shingle, with signatures of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = S.row_ids()
        for whole in batches:
            for batch in S.parts_of(whole, 1000):
                grams, at = sets_of(S.column(batch, "texts"), k)
                n = np.diff(at)
                out = pa.RecordBatch.from_arrays(
                    [pa.array([next(ids) for _ in range(batch.num_rows)], pa.int64()), S.column(batch, "id"), *map(pa.array, S.signatures(grams, at)), pa.array(n.astype(np.int32)), S.column(batch, "texts")]
                    + [pa.array([x.tobytes() for x in S.fingerprints(grams, at, BITS)], pa.binary())],
                    ["row", "id", "sig1", "sig2", "n", "texts", "print"],
                )
                yield out.filter(pa.array(n > 0))

    return run


PROBES = "gram bigint, cls bigint, size bigint" + "".join(f", f{i} bigint" for i in range(PRINT))


def _probes(counts, t: float, k: int):
    """The rarest shingles of each class, with its size and a short fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch in S.parts_of(rows, 1000):
                grams, at = sets_of(S.column(batch, "texts"), k)
                take, r, place = S.rarest(grams, at, counts.value, t)
                prints = S.fingerprints(grams, at, 64 * PRINT)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[take].view(np.int64)), S.column(batch, "cls").take(pa.array(r)), S.packed(np.diff(at)[r], place), *(pa.array(prints[r, i]) for i in range(PRINT))],
                    [x.split()[0] for x in PROBES.split(", ")],
                )

    return run


def _left(pivots, t: float, direct: bool = True):
    """Of pairs with their fingerprints those whose distances to all pivots differ little enough, then those that are close themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in S.parts_of(whole, 2000):
                x, y = _prints(S.column(batch, "print_a")), _prints(S.column(batch, "print_b"))
                na, nb = (np.asarray(S.column(batch, c)).astype(np.int64) for c in ("n_a", "n_b"))
                bound = na + nb - 2 * S.least_common(na, nb, t)
                left = np.abs(distances(x, pivots.value).astype(np.int32) - distances(y, pivots.value)).max(axis=1, initial=0) <= bound
                if direct:
                    left &= np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1) <= bound
                yield batch.select(["cls_a", "cls_b"]).filter(pa.array(left))

    return run


def _verified(t: float, k: int):
    """Pairs whose sets are similar, by an exact count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in S.parts_of(whole, 1000):
                a, b = sets_of(S.column(batch, "texts_a"), k), sets_of(S.column(batch, "texts_b"), k)
                both = S.common(*a, *b)
                either = np.diff(a[1]) + np.diff(b[1]) - both
                good = np.flatnonzero(both >= t * either - 1e-9)
                r = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [S.column(batch, "cls_a").take(r), S.column(batch, "cls_b").take(r), pa.array((both / np.maximum(either, 1))[good])],
                    ["cls_a", "cls_b", "similarity"],
                )

    return run


class NearDuplicates:
    """The classes of equal sets of a collection and the similar pairs of classes.

    ``records`` has a bigint id and an array of texts. Shingles don't reach from
    one text into the next. Rows with a null id, and those without a shingle
    (null or empty array, null, empty or short texts), are alike to nothing and
    in no result. Rows with equal sets form one class, whatever their number;
    two rows with one id both count under that id. Other columns are ignored.
    """

    def __init__(self, records: DataFrame, id_column: str, texts: str, threshold: float = 0.8, shingle: int = 5, pivots: int = PIVOTS):
        self.threshold, self.shingle = threshold, shingle
        source = records.select(F.col(id_column).cast("bigint").alias("id"), F.col(texts).alias("texts")).where("id is not null and size(texts) > 0")
        self.units = cut(source.mapInArrow(_units(shingle), "row bigint, id bigint, sig1 bigint, sig2 bigint, n int, texts array<string>, print binary"), "units")
        self.several, self.copies = S.copies_of(self.units.select("row", "id", "sig1", "sig2"), ["sig1", "sig2"], F.min("id").alias("first_id"))
        self.classes = self.units.join(self.copies.select("row"), "row", "left_anti").select(F.col("row").alias("cls"), "id", "n", "texts", "print")
        self.members = self.units.select("row", "id").join(self.copies, "row", "left").select("id", F.coalesce("cls", "row").alias("cls"))
        context = self.units.sparkSession.sparkContext
        total = self.units.agg(F.sum("n")).first()[0] or 0
        counts = context.broadcast(S.sketch(self.classes.select("texts"), lambda batch: (shingles_of(x.column(0), shingle)[0] for x in S.parts_of(batch, 1000)), total))
        drawn = self.classes.orderBy(F.xxhash64("cls"), "cls").limit(pivots).select("print").collect()  # a fixed number of records
        self._pivots = context.broadcast(np.array([np.frombuffer(r.print, np.int64) for r in drawn]).reshape(-1, BITS // 64))
        self._probes = self.classes.select("cls", "texts").mapInArrow(_probes(counts, threshold, shingle), PROBES)

    def _meetings(self, near: bool = True) -> DataFrame:
        """Pairs of classes, once per rare shingle they share, that pass the bounds of sizes and places and of the short fingerprints; a is the smaller set."""
        # both sides are one plan, so it runs and is shuffled once
        a, b = self._probes.alias("a"), self._probes.alias("b")
        na, nb = S.size_sql("a.size"), S.size_sql("b.size")
        on = (F.col("a.gram") == F.col("b.gram")) & F.expr(f"{na} < {nb} or ({na} = {nb} and a.cls < b.cls)") & F.expr(S.meet_sql("a.size", "b.size", self.threshold))
        if near:
            on = on & (S.hamming("a.f", "b.f", PRINT) <= F.expr(S.most_apart_sql(na, nb, self.threshold)))
        return a.join(b, on).select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"))

    def _candidates(self) -> DataFrame:
        return self._meetings().distinct()

    def _close(self) -> DataFrame:
        """Candidates that the tables of distances to pivots and the distance of the whole fingerprints leave."""
        prints = self.classes.select("cls", "n", "print")
        pairs = self._candidates().join(prints.toDF("cls_a", "n_a", "print_a"), "cls_a").join(prints.toDF("cls_b", "n_b", "print_b"), "cls_b")
        return pairs.mapInArrow(_left(self._pivots, self.threshold), "cls_a bigint, cls_b bigint")

    def class_pairs(self) -> DataFrame:
        """Similar classes and their ``similarity``, each pair once."""
        left = cut(self._close(), "close")
        texts = S.only_of(self.classes.select("cls", "texts"), "cls", left.select("cls_a").union(left.select("cls_b")))
        return (
            left.join(texts.toDF("cls_a", "texts_a"), "cls_a")
            .join(texts.toDF("cls_b", "texts_b"), "cls_b")
            .mapInArrow(_verified(self.threshold, self.shingle), "cls_a bigint, cls_b bigint, similarity double")
        )

    def pruning(self) -> dict[str, int]:
        """How many meetings at a rare shingle there are, and how many pairs (each once) the steps leave:
        the short fingerprints, the pivots alone, and pivots and distance."""
        all_pairs, prints = cut(self._meetings(False).distinct(), "pairs"), self.classes.select("cls", "n", "print")
        joined = all_pairs.join(prints.toDF("cls_a", "n_a", "print_a"), "cls_a").join(prints.toDF("cls_b", "n_b", "print_b"), "cls_b")
        by_pivots = joined.mapInArrow(_left(self._pivots, self.threshold, False), "cls_a bigint, cls_b bigint")
        return {"meetings": self._meetings(False).count(), "pairs": all_pairs.count(), "short": self._candidates().count(), "pivots": by_pivots.count(), "close": self._close().count()}

    def pairs(self) -> DataFrame:
        """Similar records ``id_a < id_b``, copies included."""
        a = self.members.select(F.col("id").alias("id_a"), F.col("cls").alias("cls_a"))
        b = self.members.select(F.col("id").alias("id_b"), F.col("cls").alias("cls_b"))
        own = a.join(self.several, a.cls_a == self.several.cls, "left_semi")
        within = own.join(b, own.cls_a == b.cls_b).select("id_a", "id_b").where("id_a < id_b")
        across = self.class_pairs().join(a, "cls_a").join(b, "cls_b").select("id_a", "id_b").where("id_a <> id_b")
        return within.unionByName(across).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))

    def groups(self) -> DataFrame:
        """A row per record: its class (``class_id``, the smallest id of its equals), the
        number of similar other classes (``links``), and ``group_id``, the smallest id
        among all that are linked to it, also by way of others."""
        pairs = cut(self.class_pairs().select("cls_a", "cls_b"), "pairs")
        first = self.classes.join(self.several.select("cls", "first_id"), "cls", "left").select("cls", F.coalesce("first_id", "id").alias("first_id"))
        edges = (
            pairs.join(first.toDF("cls_a", "a"), "cls_a").join(first.toDF("cls_b", "b"), "cls_b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        )
        found = connected_components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
        links = pairs.select(F.col("cls_a").alias("cls")).unionByName(pairs.select(F.col("cls_b").alias("cls"))).groupBy("cls").agg(F.count("*").cast("int").alias("links"))
        whole = self.members.join(first.withColumnRenamed("first_id", "class_id"), "cls").join(links, "cls", "left").join(found, "class_id", "left")
        return whole.select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "class_id").alias("group_id"))
