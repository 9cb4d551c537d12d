"""Near duplicates by the LSH forest against brute force; words that a hash of powers would confuse, in all that hash words."""

import random

import pyarrow as pa
import pytest

from tessera.llm import common, decontaminate, jaccard_join, katz, line_dedup, lsh_forest

from test_jaccard_regions import brute, chain


def found(spark, rows, k, percent):
    df = spark.createDataFrame([(d, t, 0, 0, "x", 1, 2) for d, t in rows], "doc_id long, text string, region long, tail long, comp string, m long, n long")
    out = lsh_forest.near_duplicates(df, k, percent).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr)


def near_copies(rng, n, size, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(size)] = f"e{i}{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = near_copies(rng, 25, 120, 1) + near_copies(rng, 12, 300, 3) + chain(rng, 30, 40) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    rows = list(enumerate(texts))
    assert found(spark, rows, 5, 85) == brute(rows, 5, 85)


@pytest.mark.parametrize("few", [0, 3])
def test_dense_regions_go_deeper(spark, monkeypatch, few):
    monkeypatch.setattr(lsh_forest, "FEW", few)
    monkeypatch.setattr(lsh_forest, "SPLIT", 5)
    rng = random.Random(2)
    shared = [f"p{i}" for i in range(60)]
    texts = [" ".join(shared + near_copies(rng, 1, 30, 0)[0].split()) for _ in range(25)]  # alike, not linked
    texts += [t + " x" for t in texts[:9]] + near_copies(rng, 20, 200, 2)
    rows = list(enumerate(texts))
    assert found(spark, rows, 5, 85) == brute(rows, 5, 85)


def test_ids_nulls_short_and_empty_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(2, a), (0, a), (2, b), (1, b + " z"), (None, a), (None, "c d e f g h"), (None, None), (7, ""), (7, ""), (8, "one"), (9, "One"), (10, "one two"), (11, "q " * 60_000)]
    assert found(spark, rows, 5, 85) == brute(rows, 5, 85)
    assert found(spark, [], 5, 85) == []


def test_enough_trees():
    for depth in (4, 8, 12):
        assert (1 - 0.85**depth) ** lsh_forest.trees(depth, 85) <= lsh_forest.MISS


def thue_morse(n, x, y):
    s = [0]
    while len(s) < n:
        s += [1 - v for v in s]
    return "".join((x, y)[v] for v in s[:n])


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_word_hashes_tell_swapped_words_apart(n):
    h, _ = common.words(pa.array([thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]))
    assert h[0] != h[1]


def test_operators_tell_swapped_words_apart(spark):
    a, b = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rows = [(1, f"{a} k0 k1 k2"), (2, f"{b} k0 k1 k2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for f in (jaccard_join.jaccard_components, lsh_forest.near_duplicates):
        assert {r.component_id for r in f(df, 4, 85).collect()} == {1, 2}
    items = spark.createDataFrame([(0, f"{a} k0 k1 k2 k3")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{a} k0 k1 k2 k3"), (2, f"{b} k0 k1 k2 k3")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contained(docs, items).collect()] == [1]
    lines = spark.createDataFrame([(1, f"{a} x\nq"), (2, f"{b} x\nr")], "doc_id long, text string")
    assert line_dedup.repeated_lines(lines, 1).count() == 0
    scores = {r.doc_id: r.n_known for r in katz.score(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), katz.F.col("doc_id") == 2).collect()}
    assert scores == {1: 2, 2: 1}  # the other word is unknown
