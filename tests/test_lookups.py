"""Searches, coverages, tables and requests on small inputs, against plain Python."""

import random

from pyspark.sql import functions as F

from tessera.functions import coverage as C
from tessera.functions import values as V
from tessera.operators import requests as R
from tessera.operators.contains import contains_join, description_search, text_search
from tessera.operators.search import tfidf, tfidf_cosine
from tessera.operators.vectors import ladder


def test_contains_join_equals_all_pairs(spark):
    r = random.Random(1)
    word = lambda most: "".join(r.choice("abñ ") for _ in range(r.randint(0, most)))
    texts, needles = [word(12) for _ in range(80)] + [None, ""], [word(5) for _ in range(60)] + [None, "", "%", "a_"]
    got = contains_join(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n").collect()
    want = {(n, t) for n in needles if n for t in texts if t and n in t}
    assert len(got) == len(want) and {(x.n, x.t) for x in got} == want


def test_text_search_scores(spark):
    entries = spark.createDataFrame([(1, "Toyota Hilux 2019"), (2, "toyota yaris"), (3, "Honda"), (4, None)], "code long, t string")
    asked = spark.createDataFrame([(1, "hilux toyota"), (2, "OYOTA HI"), (3, "toy toy"), (4, ""), (5, None), (6, "zzz")], "q long, p string")
    got = {(x.q, x.code): (x.score, x["rank"]) for x in text_search(asked, "q", "p", entries, "code", "t").collect()}
    assert got == {(1, 1): (2, 1), (1, 2): (1, 2), (2, 1): (4, 1), (2, 2): (1, 2), (3, 1): (2, 1), (3, 2): (2, 2)}
    assert text_search(asked.limit(0), "q", "p", entries, "code", "t").count() == 0


def test_ladder_filters_and_rungs(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.8, 0.6], "b"), (3, [0.0, 1.0], None), (4, None, "a"), (5, [0.6, 0.8], "c")]
    asked = [(-1, [1.0, 0.0], None), (-2, [1.0, 0.0], "b"), (-3, [1.0, 0.0], "c"), (-4, [-1.0, 0.0], None), (-5, [1.0, 0.0], "none")]
    table = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>, label string")
    got = {(x.query_id, x.vec_id, x.strategy) for x in ladder(table(rows), table(asked), 10, "label").collect()}
    assert got == {(-1, 1, "high_similarity"), (-2, 2, "medium_similarity"), (-3, 5, "low_similarity"), (-4, None, "no_match"), (-5, None, "no_match")}
    assert {x.strategy for x in ladder(table([]), table(asked), 10, "label").collect()} == {"no_match"}


def test_coverages(spark):
    df = spark.createDataFrame([("Amplia", "$25,000", "500"), ("pd", "25 USD", "100"), (None, ",", None), ("colisión", "2m", "10%"), ("x", "$", "7%")], "k string, l string, d string")
    c, lim, ded = F.col("k"), F.col("l"), F.col("d")
    got = [tuple(x) for x in df.select(C.coverage(c), C.limit_text(lim), C.deductible_text(ded), C.needs_review(c, lim, ded)).collect()]
    assert got == [("TODO RIESGO", "$25,000", "$500", False), ("DAÑOS A PROPIEDAD", "$25", None, True), ("UNKNOWN", "TBD", None, True), ("COLISION", "$2,000,000", "10% of vehicle value", False), ("UNKNOWN", "TBD", None, True)]
    text = spark.createDataFrame([("coverage: Full  Coverage\n límite: $1,000\nCOVERAGE: RoboLIMIT: 5",), (None,), ("",)], "t string")
    assert [x[0] and [tuple(y) for y in x[0]] for x in text.select(C.coverage_pairs(F.col("t"))).collect()] == [[("Full  Coverage", "$1,000"), ("Robo", "5")], None, []]


def test_table_vehicles_of_odd_tables(spark):
    car = "1. Ford Fiesta 2012"
    rows = [[["n", "Unidad"], [car, car, car]], [["a", "b"], [car], [None, "x"]], [["vehicle"]], [], None, [[], [car]], [[None, "x"], [car, "Ford"]]]
    df = spark.createDataFrame([(r,) for r in rows], "rows array<array<string>>")
    name = "FORD FIESTA 2012"
    assert [x[0] for x in df.select(V.table_vehicles(F.col("rows"))).collect()] == [[name], [name], [], [], [], [], [name]]


def test_batch_errors_first_five_and_rest(spark):
    rows = [("a", i, "" if i % 2 else "fine one") for i in range(14)] + [("b", 0, None), ("c", 0, "all right")]
    df = spark.createDataFrame(rows, "batch string, pos long, d string")
    df = df.withColumn("errors", R.vehicle_errors(F.col("d"), F.lit("i"), F.lit(0), F.lit("")))
    got = {x.batch: (x.n, x.n_invalid, x.messages) for x in R.batch_errors(df, "batch", "pos", "errors", 10).collect()}
    bad = "Vehicle description is required; Vehicle description too short (min 5 characters)"
    assert got["a"] == (14, 7, ["Batch size 14 exceeds maximum (10)", *(f"Vehicle {i}: {bad}" for i in (1, 3, 5, 7, 9)), "Additional 2 vehicles have validation errors"])
    assert got["b"] == (1, 1, [f"Vehicle 0: {bad}"]) and got["c"] == (1, 0, [])
    assert R.batch_errors(df.limit(0), "batch", "pos", "errors").count() == 0


def test_results_summary_adds_in_the_order_given(spark):
    def average(values):
        total = 0.0
        for v in values:
            total += v
        return int(total / len(values) * 100 * 10 + 0.5) / 10

    r = random.Random(1)
    orders = [[r.choice((0.1, 0.2, 0.4, 0.5, 0.7, 0.0)) for _ in range(8)] for _ in range(4000)]
    runs = [x for x in orders if average(x) != average(x[::-1])]  # a half that falls to either side
    assert runs
    rows = [(run, at, v, "c") for run, x in enumerate(runs) for at, v in enumerate(x)]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "run int, at int, v double, code string").repartition(5, "at")
    for step in (1, -1):
        order = [F.col("at") * step]
        assert {x.run: x.average for x in R.results_summary(table, "run", "v", "code", order).collect()} == {run: average(x[::step]) for run, x in enumerate(runs)}


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_searches_send_no_table_through_the_driver(spark):
    asked = spark.createDataFrame([(i, f"small ring {i}") for i in range(50)], "q long, d string")
    entries = spark.createDataFrame([(i, f"small ring {i}") for i in range(200)], "code long, t string")
    got = description_search(asked, "q", "d", entries, "code", "t", k=3)
    texts = [(i, f"small ring {i}") for i in range(200)]
    want = {(q, code) for q in range(50) for code in [c for c, t in texts if f"small ring {q}" in t][:3]}
    assert {(x.q, x.code) for x in got.collect()} == want
    assert _joins(got) == 0
    x = tfidf(entries, "code", "t")
    found = tfidf_cosine(x, entries.select("code", (F.col("code") + 1).alias("other")), "code", "other")
    assert found.count() == 199 and _joins(found) <= 4  # the 1,000 terms alone: for the weights and lengths of each side


def test_text_search_of_equal_phrases_and_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 3)))
    texts = [" ".join(word() for _ in range(3)) for _ in range(12)]
    entries = [(i, r.choice(texts)) for i in range(150)]
    phrases = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(6)]
    asked = [(i, r.choice(phrases)) for i in range(40)]

    def score(p, t):
        terms = p.upper().split()
        return sum(w in t.upper() for w in terms) + (len(terms) if p.upper() in t.upper() else 0)

    want = set()
    for q, p in asked:
        best = sorted((-score(p, t), code) for code, t in entries if any(w in t.upper() for w in p.upper().split()))[:7]
        want |= {(q, code, -s, i + 1) for i, (s, code) in enumerate(best)}
    got = text_search(spark.createDataFrame(asked, "q long, p string"), "q", "p", spark.createDataFrame(entries, "code long, t string"), "code", "t", 7)
    assert {(x.q, x.code, x.score, x["rank"]) for x in got.collect()} == want
