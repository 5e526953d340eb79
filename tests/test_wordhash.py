"""Words of batches against a regular expression; cutting lineage."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill import session
from tracemill.functions import wordhash as W

TEXT = st.text(alphabet=st.one_of(st.sampled_from("aZ09 -_\n"), st.characters(codec="utf-8")), max_size=60)


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.none() | TEXT, max_size=8))
def test_words(block, texts):
    old, W.BLOCK = W.BLOCK, block
    try:
        hashes, bounds = W.words_of(pa.array(texts, pa.string()))
    finally:
        W.BLOCK = old
    known = {}
    for i, text in enumerate(texts):
        own = words(text)
        assert bounds[i + 1] - bounds[i] == len(own)
        for w, h in zip(own, hashes[bounds[i] : bounds[i + 1]].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_slices_and_long_words():
    texts = ["ab " * 10, "x" * 3_000_000, "", None, "a b c"]
    hashes, bounds = W.words_of(pa.array(texts))
    assert np.diff(bounds).tolist() == [10, 1, 0, 0, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    parts = list(W.slices(batch, "t", 10))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) > 1
    sliced = pa.array(texts).slice(4)
    assert (W.words_of(sliced)[0] == hashes[11:]).all()
    assert list(W.slices(batch.slice(0, 0), "t")) == []


def test_grams_and_distinct_values():
    hashes, bounds = W.words_of(pa.array(["a b a b a", "b", "a b a"]))
    grams, at = W.grams_of(hashes, bounds, 2)
    assert np.diff(at).tolist() == [4, 0, 2] and grams[0] == grams[2] == grams[4] and grams[0] != grams[1]
    values, edges = W.distinct_in(grams, at)
    assert np.diff(edges).tolist() == [2, 0, 2] and (values[:2] == values[2:]).all()
    column = W.list_array(values, edges)
    back, again = W.list_parts(column.slice(1))
    assert (back == values[2:]).all() and again.tolist() == [0, 0, 2]


def test_cut_runs_once_and_is_dropped(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    kept = session.cut(spark.range(10).mapInArrow(seen, "id bigint"), "x")
    assert kept.count() == 10 and kept.agg(F.sum("id")).first()[0] == 45 and calls.value == 10
    paths = [p for _, p in session._written]
    assert paths and all(p.startswith(session.shared_dir(spark)) for p in paths)
    session.drop_cuts()
    assert not any(os.path.exists(p) for p in paths)


def test_sorting_within_parts():
    """Short and long parts take different ways to the same result."""
    rnd = np.random.default_rng(3)
    for sizes in ([0, 1, 3, 0, 2], [200, 0, 1, 90], [40] * 5, []):
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        values = rnd.integers(0, 30, bounds[-1]).astype(np.uint64)
        before = values.copy()
        order = W.order_in(values, bounds)
        found, at = W.distinct_in(values, bounds)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            assert order[a:b].tolist() == sorted(range(a, b), key=lambda k: (values[k], k))
            assert found[at[i] : at[i + 1]].tolist() == sorted(set(values[a:b].tolist()))
        assert (values == before).all() and len(at) == len(sizes) + 1


def test_cuts_that_are_replaced_go(spark):
    one = session.cut(spark.range(3), "one")
    folder = session._places[id(one)][0]
    two = session.cut(one.where("id > 0"), "two", one)
    assert not os.path.exists(os.path.dirname(folder)) and two.count() == 2
