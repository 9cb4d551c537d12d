"""Fuzzy joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.operators import fuzzy_join as J
from tessera.operators.contains import contains_join


def names(rng, n):
    base = ["".join(rng.choice("ABC 1ñ") for _ in range(rng.randint(1, 14))) for _ in range(n)]
    out = list(base)
    for b in base:
        x = list(b)
        for _ in range(rng.randint(0, 3)):
            if x and rng.random() < 0.5:
                x.pop(rng.randrange(len(x)))
            else:
                x.insert(rng.randint(0, len(x)), rng.choice("ABC 1ñ"))
        out.append("".join(x))
    return out + ["L200", "L 200", "l-200", "x" * 400, "x" * 300 + "y", " ", "", None]


@pytest.mark.parametrize("percent", [67, 80, 90])
def test_similar_pairs_equal_all_pairs(spark, percent):
    rng = random.Random(percent)
    every = names(rng, 60)
    a, b = [(t, i % 2) for i, t in enumerate(every)], [(t, i % 2) for i, t in enumerate(every)]
    x, y = spark.createDataFrame(a, "a string, g int"), spark.createDataFrame(b, "b string, g int")
    got = {(r.g, r.a, r.b, round(r.ratio, 9)) for r in J.similar_pairs(x, "a", y, "b", ("g",), percent).collect()}
    want = {(g, s, t, round(fuzzy.ratio(s, t), 9)) for s, g in a for t, h in b if s and t and g == h and 2 * 100 * fuzzy.common(s, t) >= percent * (len(s) + len(t))}
    assert got == want and len(want) > 40


def test_models(spark):
    rng = random.Random(5)
    a, b = names(rng, 50), names(rng, 50)
    x, y = spark.createDataFrame([(t,) for t in a], "a string"), spark.createDataFrame([(t, "c") for t in b], "b string, ratio string")
    got = {(r.a, r.b, round(r.similarity, 9)) for r in J.fuzzy_models(x, "a", y, "b").collect()}
    want = set()
    for s in {t.upper().strip() for t in a if t and t.strip()}:
        for t in {t.upper().strip() for t in b if t and t.strip()}:
            r = 1.0 if s == t else max(fuzzy.ratio(s, t), 0.9) if s in t or t in s else fuzzy.ratio(s, t)
            if r >= 0.8:
                want.add((s, t, round(r, 9)))
    assert got == want
    assert J.fuzzy_models(x.limit(0), "a", y, "b").count() == 0


def test_no_pair_breaks_the_length_bound(spark):
    x = spark.createDataFrame([("A" * n,) for n in range(1, 40)], "a string")
    plan = J.similar_pairs(x, "a", x.withColumnRenamed("a", "b"), "b")
    assert all(max(len(r.a), len(r.b)) <= 1.5 * min(len(r.a), len(r.b)) for r in plan.collect())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_contains_join_within_blocks(spark):
    x = spark.createDataFrame([("abcd", 1), ("xabc", 2), ("abc", 1), (None, 1)], "t string, g int")
    n = spark.createDataFrame([("abc", 1), ("ab", 2), ("b", None)], "n string, g int")
    assert {tuple(r) for r in contains_join(x, "t", n, "n", ("g",)).collect()} == {(1, "abc", "abcd"), (1, "abc", "abc"), (2, "ab", "xabc")}


def test_ratio_sql_equals_the_program():
    duckdb = pytest.importorskip("duckdb")
    from tessera.plans.fuzzy import lcs_sql

    rng = random.Random(9)
    rows = [(s, t) for s in names(rng, 10) if s and len(s) < 60 for t in names(rng, 4) if t]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert [r[0] for r in con.execute(f"SELECT {lcs_sql('a', 'b')} FROM t").fetchall()] == [fuzzy.common(s, t) for s, t in rows]
