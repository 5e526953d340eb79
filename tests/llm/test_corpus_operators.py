"""Splits, mixtures and pieces: against plain versions, round trips, and on awkward rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import reference as ref
from tracemill.llm.chunking import PARAGRAPH, SENTENCE, RangeMaximum, pieces, split_oversized, strengths
from tracemill.llm.mixing import Mixture, count_tokens
from tracemill.llm.queries import queries
from tracemill.llm.splits import assign_splits, related_groups, task_entities
from tracemill.llm.tokens import LONG_RUN, RANKS, tokenizer
from tracemill.tables import load

import numpy as np


def test_marks_and_spellings(spark, small):
    rows = [
        (1, " Hot_Family ", "drill-yard/x-1@2", 2), (2, "hot family", None, 1), (3, "n/a", "Drill_Yard/x-1/", 1), (4, None, "drill-yard/x-1 (rev 4)", 4), (5, None, "drill-yard/x-1#r5", 5),
        (6, None, "drill-yard/x-1@3", 2), (7, "UNKNOWN ", " - ", 1), (8, "---", "", 1), (9, None, "other-7", 7), (10, "zzz", "other-7", 7), (11, None, "lone", 1), (11, None, "lone", 1),
    ]
    tasks = spark.createDataFrame([(*r, "x") for r in rows], "record_id bigint, family string, task_id string, task_revision bigint, component string")
    entities = task_entities(tasks, load(spark, small, "spellings"))
    got = Counter((r.record_id, r.group_name) for r in related_groups(entities, "record_id", ["family", "task"]).collect())
    group = {i: "hot-family" for i in (1, 2, 3, 4, 5)} | {9: "zzz", 10: "zzz"}
    assert got == Counter(group.items()) + Counter({(11, "lone"): 2})
    assert related_groups(entities.limit(0), "record_id", ["family", "task"]).count() == 0


def test_groups_and_splits_of_random_entities(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, f"a{rnd.randint(0, 80)}"]), rnd.choice([None, f"b{rnd.randint(0, 80)}"]), rnd.choice([None, None, f"c{rnd.randint(0, 80)}"])) for i in range(300)]
    rows += [(1000 + i, "hot", f"h{i}", None) for i in range(150)]  # a third of all rows
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string")
    targets = spark.createDataFrame([("train", 8.0), ("validation", 1.0), ("holdout", 1.0), ("none", 0.0)], "split string, share double")
    edges = [(f"{k}{x}", f"{m}{y}") for _, *v in rows for k, x in enumerate(v) for m, y in enumerate(v) if x is not None and y is not None]
    root = ref.components(edges)
    name = {i: next((root[f"{k}{x}"] for k, x in enumerate(v) if x is not None), None) for i, *v in rows}
    size = Counter(v for v in name.values() if v)
    got = {r.record_id: r.group_name for r in related_groups(df, "id", ["a", "b", "c"]).collect()}
    assert got == {i: n[1:] for i, n in name.items() if n and size[n] > 1}
    split = {r.record_id: r.split for r in assign_splits(df, "id", ["a", "b", "c"], targets).collect()}
    assert set(split) == {r[0] for r in rows}
    by = defaultdict(set)
    for i, n in name.items():
        by[n if n else i].add(split[i])
    assert all(len(s) == 1 for s in by.values())
    assert assign_splits(df.limit(0), "id", ["a"], targets).count() == 0
    with pytest.raises(ValueError):
        assign_splits(df, "id", ["a"], targets.limit(0))


def test_split_shares(spark):
    df = spark.range(20_000).select("id", F.concat(F.lit("e"), (F.col("id") / 3).cast("int")).alias("e"))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("holdout", 0.1)], "split string, share double")
    counts = {r.split: r["count"] for r in assign_splits(df, "id", ["e"], targets).groupBy("split").count().collect()}
    assert abs(counts["train"] / 20_000 - 0.8) < 0.015 and abs(counts["validation"] / 20_000 - 0.1) < 0.015


def documents(spark, seed=0, n=600):
    rnd = random.Random(seed)
    rows = [(i, rnd.choices(["a", "b", "c", None, "other"], [70, 20, 8, 1, 1])[0], " ".join(rnd.choice(["alpha", "beta", "of", "x1"]) for _ in range(rnd.randint(0, 60)))) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "a", "no id"), (n, "a", None), (n + 1, "b", "")], "doc_id bigint, source string, text string").withColumn("salt", F.lit("x")).withColumn("copies", F.lit(1))


def test_fixed_ranges_keep_splits(spark):
    """With fixed ranges a component's split doesn't depend on the other rows, however large one of them is."""
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, share double")
    few = spark.range(600).selectExpr("id", "concat('f', id % 300) AS family")
    more = few.unionByName(spark.range(600, 1500).selectExpr("id", "'large' AS family"))
    one, two = ({r.component: r.split for r in assign_splits(x, "id", ["family"], targets, fixed=True).collect()} for x in (few, more))
    assert {c: two[c] for c in one} == one and set(one.values()) == {"train", "test"}


def test_mixture_reaches_its_shares(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 4), ("absent", 0.5, 1), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    mix = Mixture(docs, targets)
    rows = mix.copies().collect()
    caps = {"a": 2, "b": 3, "c": 4}
    assert rows and all(1 <= r.copies <= caps[r.source] and r.n_tokens > 0 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    shares = {r.source: r for r in mix.shares().collect()}
    assert {s: round(r.target_share, 9) for s, r in shares.items()} == {"a": 0.5, "b": 0.3, "c": 0.2}
    for s, r in shares.items():
        assert abs(r.share - r.target_share) < 0.002
        assert r.tokens == sum(x.copies * x.n_tokens for x in rows if x.source == s)
    assert rows == mix.copies().collect()  # the same on every call
    less = Mixture(docs, targets, total=2000.0)
    assert abs(sum(r.copies * r.n_tokens for r in less.copies().collect()) - 2000) < 40
    assert Mixture(docs.limit(0), targets).copies().count() == 0
    assert Mixture(docs, targets.limit(0)).copies().count() == 0


def test_multipliers_solve_the_dual(spark):
    """The uses of each source sum to its tokens, by the multipliers found."""
    mix = Mixture(documents(spark, 3), spark.createDataFrame([("a", 0.2, 2), ("b", 0.6, 3), ("c", 0.2, 6)], "source string, weight double, max_repeats int"), total=3000.0)
    docs = mix.documents.collect()
    for s, x in mix.sources.items():
        v = mix.lambdas[s]
        uses = [(float(x["cap"]) if v is None else min(x["cap"], float(np.exp(v * r.n_tokens / x["mean"])))) * r.n_tokens for r in docs if r.source == s]
        assert abs(sum(uses) - x["weight"] * mix.total) < 1e-3


def test_mixture_without_solution_is_an_error(spark):
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.8, 3)], "source string, weight double, max_repeats int")
    with pytest.raises(RuntimeError, match="no solution"):
        Mixture(documents(spark, 3), targets, total=3000.0, most_steps=1)


def test_long_texts_have_the_tokens_of_the_whole():
    """White space and words far longer than the pattern's matcher takes; near the limit the plain call says the same."""
    tok, n = tokenizer(RANKS), LONG_RUN
    for text in ("a b" + " " * n + "c d", "a" + "\n" * n + "b", " " * n, " " * n + "x", "x" + "\t \n" * n, "a" + " " * (n - 1) + "b", "a \x1c" + "\u3000" * n + "!", ("word " * 30 + "\n" * n) * 3 + "é"):
        assert tok.encode(text) == tok._encode(text)
    assert tok.count("abcdefghij" * 12_000) == 8 * 6000 == tok.count("abcdefghij") * 12_000
    assert tok.count("x" + "\n" * 3_000_000 + "y") == 2 + tok.count("\n" * (3_000_000 - 1)) + 1


def test_tokens_are_those_of_the_tokenizer(spark):
    tok = tokenizer(RANKS)
    texts = ["", "plain words", "né à   Zürich\r\n\n§", "x" * 250_000, " " * 5000]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert got[0] == 0 and all(got[i] == tok.count(t) for i, t in enumerate(texts))
    assert all(sum(tok.sizes[x] for x in tok.encode(t)) == len(t.encode()) for t in texts)


def check_pieces(text, limit, overlap):
    tok = tokenizer(RANKS)
    found = pieces(text, limit, overlap, tok)
    data = text.encode()
    assert found[0][0] == 0 and found[-1][1] == len(data)
    for a, b, n, _ in found:
        assert tok.count(data[a:b].decode()) == n <= limit
    for (a, b, *_), (c, d, *_) in zip(found, found[1:]):
        assert a < c <= b < d
    if limit > 32 and overlap:
        assert all(b > c for (_, b, *_), (c, *_) in zip(found, found[1:]))
    return found


def test_pieces_of_random_texts():
    rnd = random.Random(4)
    parts = ["word ", "Satz. ", "\n", "\n\n", "\r\n\r\n", "élan, ", "日本語", "x" * 40, "foo_bar(", "  ", "1234567 ", "🙂", "end! ", "\t"]
    for _ in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 400)))
        limit = rnd.choice([8, 16, 64])
        check_pieces(text, limit, rnd.choice([0, 1, limit // 4, limit // 2 - 1]))


def test_texts_without_a_place_to_cut():
    for text in ("x" * 60_000, "🙂" * 4000, "".join(random.Random(1).choice("abcdefXYZ012é") for _ in range(20_000)), " " * 9000, "́" * 3000):
        check_pieces(text, 64, 8)


def test_cuts_at_the_strongest_boundary():
    sentence = "Some words stand here in a row of ten or so. "
    text = (sentence * 5 + "\n\n") * 12
    found = check_pieces(text, 100, 0)
    assert all(s == PARAGRAPH for *_, s in found)
    flat = check_pieces(sentence * 60, 100, 10)
    assert all(s == SENTENCE for *_, s in flat[:-1])


def test_strengths_of_places():
    text = "ab, c.\n\nd e\r\nf"
    raw = np.frombuffer(text.encode(), np.uint8)
    got = dict(zip(range(1, len(text)), strengths(raw, np.arange(1, len(text))).tolist()))
    assert got[1] == 1 and got[2] == 2 and got[3] == got[4] == 4 and got[6] == got[7] == got[8] == 7 and got[9] == 3 and got[11] == got[12] == got[13] == 6


def test_range_maximum():
    rnd = random.Random(9)
    keys = np.array([rnd.randint(0, 50) for _ in range(77)])
    table = RangeMaximum(keys)
    for a in range(77):
        for b in range(a + 1, 78):
            assert table.largest(a, b) == keys[a:b].max()


def test_split_oversized(spark, small):
    docs = load(spark, small, "documents")
    rows = split_oversized(docs, 128, 16).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    by = defaultdict(list)
    for r in rows:
        assert text[r.doc_id][r.start : r.end] == r.text and r.n_tokens <= 128
        by[r.doc_id].append(r)
    assert set(by) == {i for i, t in text.items() if t is not None}
    for i, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        whole = own[0].text
        for a, b in zip(own, own[1:]):
            whole += b.text[a.end - b.start :]
        assert whole == text[i]
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a", 0), (3, "b", 0), (3, "b", 0), (4, "wörter " * 50_000, 0)], "doc_id bigint, text string, piece int")
    got = split_oversized(odd, 128, 16).collect()
    assert Counter(r.doc_id for r in got if r.doc_id != 4) == {2: 1, 3: 2} and max(r.end for r in got if r.doc_id == 4) == 350_000
    assert split_oversized(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(odd, 100, 50)


@pytest.mark.parametrize("name", ["p4_splits", "p8_mix", "p8_shares", "p9_pieces"])
def test_queries_run(spark, small, name):
    assert queries()[name](spark, small).count() > 0
