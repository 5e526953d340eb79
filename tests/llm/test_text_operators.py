"""Overlaps, near-duplicates, leaks: against plain versions, and on awkward rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import reference as ref
from tracemill.functions.wordhash import words_of
from tracemill.llm import leaks
from tracemill.llm import shingles as S
from tracemill.llm.components import connected_components
from tracemill.llm.leaks import find_leaks
from tracemill.llm.neardup import NearDuplicates
from tracemill.llm.overlap import align, find_overlaps
from tracemill.llm.queries import queries
from tracemill.tables import load

VOCABULARY = [f"w{i}" for i in range(40)]


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        i, how = rnd.randrange(len(w)), rnd.random()
        if how < 0.4:
            w[i] = rnd.choice(VOCABULARY)
        elif how < 0.6:
            w.insert(i, rnd.choice(VOCABULARY))
        elif how < 0.8 and len(w) > 4:
            del w[i]
        else:
            w = w[i:] + w[:i]
    return " ".join(w)


def family_of_texts(seed, families=25, most=5):
    """Random texts with edited, reordered and equal copies, some of them tiny, some sharing a long opening."""
    rnd, out = random.Random(seed), []
    for f in range(families):
        n = rnd.choice([3, 4, 5, 8, 20, 60])
        base = " ".join(rnd.choice(VOCABULARY) for _ in range(n))
        if f % 5 == 0:
            base = "the same opening of all these texts goes on for some time " + base
        out += [base, base.upper() + " !"] + [edited(rnd, base, rnd.randint(1, 6)) for _ in range(rnd.randint(0, most))]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_against_all_pairs(spark, seed):
    texts = family_of_texts(seed)
    rows = [(i, i % 2, i % 3 == 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id bigint, field int, held boolean, text string")
    got = {(r.record_id_held, r.record_id_train, r.field) for r in find_overlaps(df, 0.7, 3).collect()}
    sets = [ref.shingles([t]) for t in texts]
    want = {(a[0], b[0], a[1]) for a in rows for b in rows if a[2] and not b[2] and a[1] == b[1] and ref.alike(sets[a[0]], sets[b[0]], 0.7)}
    assert got == want and want


@pytest.mark.parametrize("seed,k,t", [(3, 3, 0.7), (4, 5, 0.8)])
def test_near_duplicates_against_all_pairs(spark, seed, k, t):
    texts = family_of_texts(seed)
    df = spark.createDataFrame([(i, x.split(" of ")) for i, x in enumerate(texts)], "id bigint, texts array<string>")
    found = NearDuplicates(df, "id", "texts", t, k)
    rows = [(r.id_a, r.id_b) for r in found.pairs().collect()]
    sets = [ref.shingles(x.split(" of "), k) for x in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if ref.alike(sets[a], sets[b], t)}
    assert set(rows) == want and len(rows) == len(want) and want
    groups = {r.id: (r.class_id, r.group_id, r.links) for r in found.groups().collect()}
    root = ref.components(want)
    assert set(groups) == {i for i, s in enumerate(sets) if s}
    assert all(group == root.get(i, i) for i, (_, group, _) in groups.items())
    classes = {i: min(j for j, s in enumerate(sets) if s == sets[i]) for i in groups}
    assert all(groups[i][0] == c for i, c in classes.items())
    assert all(groups[i][2] == sum(1 for c in set(classes.values()) if c != classes[i] and ref.alike(sets[i], sets[c], t)) for i in groups)


def test_pivots_discard_no_similar_pair():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        base = rnd.integers(0, 1 << 63, rnd.integers(5, 200), dtype=np.int64).view(np.uint64)
        other = np.concatenate([base[rnd.random(len(base)) < 0.9], rnd.integers(0, 1 << 63, 4, dtype=np.int64).view(np.uint64)])
        prints = [S.fingerprints(np.unique(x), np.array([0, len(np.unique(x))]), 1024).view(np.uint64)[0] for x in (base, other)]
        apart = len(set(base.tolist()) ^ set(other.tolist()))
        assert int(np.bitwise_count(prints[0] ^ prints[1]).sum()) <= apart
        pivot = rnd.integers(0, 1 << 63, 16, dtype=np.int64).view(np.uint64)
        far = [int(np.bitwise_count(p ^ pivot).sum()) for p in prints]
        assert abs(far[0] - far[1]) <= apart


def test_alignment_covers_common_words():
    number = {}
    ids = lambda text: np.array([number.setdefault(w, len(number) + 1) for w in text.split()], np.uint64)
    a, b = ids("a b c d e f g h i j"), ids("x a b c d e y f g h i j")
    seeds, in_a, in_b = align(a, b, 3)
    assert seeds > 0 and in_a == 10 and in_b == 10
    assert align(ids("a b"), b, 3) == (0, 0, 0)


def test_tiles_find_the_longest_common_passage():
    rnd = random.Random(7)
    for _ in range(60):
        a = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 40))], np.uint64)
        b = np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 60))], np.uint64)
        found = leaks.tiles(a, b, 4)
        longest = ref.longest_common(a.tolist(), b.tolist())
        assert (found[0][2] if found else 0) == (longest if longest >= 4 else 0)
        used_a, used_b = [], []
        for x, y, n in found:
            assert (a[x : x + n] == b[y : y + n]).all() and n >= 4
            used_a += range(x, x + n)
            used_b += range(y, y + n)
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)


def test_tiles_of_endless_repetition():
    word = np.full(100, 7, np.uint64)
    found = leaks.tiles(word, np.full(200_000, 7, np.uint64), 12)
    assert sum(n for _, _, n in found) == 100


def test_tiles_without_listing_matches():
    rnd = random.Random(8)
    for _ in range(400):
        k = rnd.randint(0, 3)
        a = np.array([rnd.randint(0, k) for _ in range(rnd.randint(1, 60))], np.uint64)
        b = np.array([rnd.randint(0, k) for _ in range(rnd.randint(1, 90))], np.uint64)
        assert leaks.tiles(a, b, 3, most_seeds=-1) == leaks.tiles(a, b, 3)


def test_tiles_of_long_passages_behind_short_ones():
    """17 million matches of seeds; the short passages stand first."""
    own = iter(range(1, 1 << 20))
    runs = lambda n, size: np.array([w for _ in range(n) for w in [0] * size + [next(own)]], np.uint64)
    item = runs(200, 23)
    found = leaks.tiles(item, np.r_[runs(4800, 12), runs(200, 23)], 12)
    assert len(found) == 200 and {n for _, _, n in found} == {23} and len(item) == 4800


def test_leaks_by_scan_and_by_shuffle(spark, small):
    docs, items = load(spark, small, "documents"), load(spark, small, "eval_items")
    scan = sorted(map(tuple, find_leaks(docs, items).collect()))
    assert scan and scan == sorted(map(tuple, find_leaks(docs, items, broadcast_bytes=0).collect()))
    item = {r.item_id: ref.words(r.text) for r in items.collect()}
    text = {r.doc_id: ref.words(r.text) for r in docs.collect()}
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    held = {i: grams(w) for i, w in item.items()}
    want = {(d, i) for d, w in text.items() for i, g in held.items() if g & grams(w)}
    assert {(r[0], r[1]) for r in scan} == want


def test_reordered_passages_count_towards_coverage(spark):
    passage = [f"a{i}" for i in range(40)]
    moved = passage[20:] + ["between"] + passage[:20]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(passage[:13])), (3, " ".join(passage[:11]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(passage))], "item_id bigint, text string")
    got = {r.doc_id: (r.n_tiles, r.coverage) for r in find_leaks(docs, items).collect()}
    assert got == {1: (2, 1.0), 2: (1, 13 / 40)}
    assert [r.doc_id for r in find_leaks(docs, items, min_coverage=0.5).collect()] == [1]


LONG = " ".join(f"v{i % 977} z{i}" for i in range(60_000))


def test_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing and other columns, empty tables."""
    texts = [None, "", " \n", "one two", LONG, LONG, LONG + " more", "İstanbul Kelvin Kelvin one"]
    rows = [(i, 0, i % 2 == 0, t, "x", i) for i, t in enumerate(texts)] + [(None, 0, True, LONG, "x", 0), (4, 0, True, LONG, "y", 0), (99, 0, None, LONG, "x", 0)]
    records = spark.createDataFrame(rows, "record_id bigint, field int, held boolean, text string, gram string, cls int")
    got = {(r.record_id_held, r.record_id_train) for r in find_overlaps(records, 0.7, 3).collect()}
    assert got == {(4, 5), (6, 5)}
    empty = records.limit(0)
    assert find_overlaps(empty, 0.7, 3).count() == 0 and len(find_overlaps(empty).columns) == 8

    lists = records.select("record_id", F.array("text", F.lit(None)).alias("texts"), "gram", "cls")
    lists = lists.unionByName(spark.createDataFrame([(50, None, "g", 1), (51, [], "g", 1)], "record_id bigint, texts array<string>, gram string, cls int"))
    pairs = {(r.id_a, r.id_b) for r in NearDuplicates(lists, "record_id", "texts", 0.7, 3).pairs().collect()}
    assert pairs == {(4, 5), (4, 6), (5, 6), (4, 99), (5, 99), (6, 99)}
    none = NearDuplicates(lists.limit(0), "record_id", "texts")
    assert none.pairs().count() == 0 and none.groups().count() == 0

    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, LONG, 5), (3, LONG, 5), (None, LONG, 5)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, " ".join(LONG.split()[:30]), "d"), (8, None, "d"), (9, "", "d"), (None, LONG, "d")], "item_id bigint, text string, doc_id string")
    for size in (1 << 24, 0):
        assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items, broadcast_bytes=size).collect()) == [(3, 7), (3, 7)]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(11)
    for n, m in ((1, 0), (60, 40), (200, 260)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(3000, 3000), (None, 5), (5, None)]
        df = spark.createDataFrame(edges, "src bigint, dst bigint")
        got = {r.node: r.component for r in connected_components(df).collect()}
        assert got == ref.components([(a, b) for a, b in edges if a is not None and b is not None])
    assert connected_components(df.limit(0)).count() == 0


def test_words_of_the_two_odd_letters():
    hashes, bounds = words_of(pa.array(["\u0130a", "i a", "\u212aa", "ka"]))
    assert np.diff(bounds).tolist() == [2, 2, 1, 1]
    assert hashes[0] == hashes[2] and hashes[4] == hashes[5]


@pytest.mark.parametrize("name", ["p1_report", "p3_groups", "p7_coverage"])
def test_queries_run(spark, small, name):
    assert queries()[name](spark, small).count() > 0
