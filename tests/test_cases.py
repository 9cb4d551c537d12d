"""The steps around the match on small inputs with nulls and ties."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import cases as C


def test_uploads_and_replies(spark):
    df = spark.createDataFrame([("a.CSV", 1, " 2)", 3), (None, 1, None, 3), ("x", 1, "option 12", 12), (".csv", 1, "7 8", 2), ("a.b/c.pdf", 30_000_000, "0 3 1", 3)], "n string, s long, r string, k int")
    got = df.select(C.upload_error(F.col("n"), F.col("s")).alias("e"), C.chosen_option(F.col("r"), F.col("k")).alias("c")).collect()
    assert [r.e and r.e.split(".")[0] for r in got] == [None, "No filename provided", "File type  not allowed", "File type  not allowed", "File size 30000000 bytes exceeds maximum 20971520 bytes"]
    assert [r.c for r in got] == [1, None, 0, None, 2]


def test_a_header_claimed_twice_goes_to_the_first_field():
    assert C.synonyms_of(["Serie", "modelo", "x", "placa", "AÑO"]) == {"Serie": "vin", "modelo": "model_year", "AÑO": "model_year", "placa": "license_plate"}


def test_labels(spark):
    df = spark.createDataFrame([("Kia", None, 0, "a/c"), (None, "", 2001, None)], "b string, m string, y int, d string")
    got = df.select(C.label(F.col("b"), F.col("m"), F.col("y"), F.col("d")).alias("l"), C.query_text(F.col("b"), F.col("m"), F.col("d")).alias("q")).collect()
    assert got[0].l.startswith("kia ") and got[1].l == "2001" and [r.q for r in got] == ["Kia a/c", ""]


def test_lookups(spark):
    e = spark.createDataFrame([(1, "Ford", "Fiesta 100%", 2010), (1, "Ford", "Zeta", 2010), (2, "Fordson", "fiesta", 2011), (3, None, "x", None)], "code long, brand string, model string, year int")
    asked = spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "code long")
    assert sorted((r.code, r.model) for r in C.by_code(e, asked).collect()) == [(1, "Fiesta 100%"), (3, "x")]
    q = spark.createDataFrame([(1, "FORD", "iesta", None), (2, None, "0%", None), (3, "ford", "", 2011), (4, None, None, 2010), (5, "for", "f_esta", None)], "q int, brand string, model string, year int")
    got = {(r.q, r.code) for r in C.find_like(q, "q", e).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (3, 2)}
    # equal demands of many records over equal entries: the least codes of all of them
    many = e.limit(0).unionByName(spark.createDataFrame([(i, "Ford", f"Fiesta {i % 4}", None if i % 5 == 0 else 2000 + i % 3) for i in range(200)], "code long, brand string, model string, year int"))
    asked = spark.createDataFrame([(i, "ford", "fiesta", 2001 if i % 2 else None) for i in range(30)], "q int, brand string, model string, year int")
    codes = {0: list(range(7)), 1: [i for i in range(200) if i % 5 and i % 3 == 1][:7]}
    assert {(r.q, r.code, r["rank"]) for r in C.find_like(asked, "q", many, 7).collect()} == {(q, c, i + 1) for q in range(30) for i, c in enumerate(codes[q % 2])}


def test_assembly_prefers_the_mail_then_the_first_attachment(spark):
    mails = spark.createDataFrame([(1, "a", None, "s@x", None), (2, None, " ", "s@y", "S")], "m int, client string, broker_name string, from_email string, from_name string")
    att = spark.createDataFrame([(2, "late", None, 2), (2, "", "b", 0), (2, "first", None, 1), (1, "other", "B1", 0)], "m int, client string, broker_name string, place int")
    got = {r.m: (r.client, r.broker_name) for r in C.assembled_case(mails, att, "m", ["client", "broker_name"], "place").collect()}
    assert got == {1: ("a", "B1"), 2: ("first", "S")}


def test_triggers_and_catch_up(spark):
    t = lambda i: datetime(2024, 1, i)
    rows = [(1, 1, "TRANSFORM", "SUCCESS", True, t(1)), (1, 2, "TRANSFORM", "SUCCESS", True, t(3)), (1, 3, "CODIFY", "SUCCESS", None, t(2)), (2, 4, "TRANSFORM", "SUCCESS", True, t(1)), (2, 5, "CODIFY", "SUCCESS", None, t(2)), (3, 6, "TRANSFORM", "FAILED", True, t(1))]
    runs = spark.createDataFrame(rows, "case_id int, run_id int, component string, status string, ready boolean, at timestamp")
    assert [(r.case_id, r.run_id, r.component) for r in C.codify_triggers(runs).collect()] == [(1, 2, "CODIFY")]
    m = spark.createDataFrame([("a", "f"), ("b", "f"), (None, "f"), ("c", "g")], "id string, folder string")
    known = spark.createDataFrame([("a", "PROCESSED"), ("a", "NEW"), ("b", "NEW")], "id string, status string")
    work, counts = C.catch_up(m, known, "id", "status")
    assert {r.id for r in work.collect()} == {"b", "c"} and {tuple(r) for r in counts.collect()} == {("f", 3, 1, 1, 1), ("g", 1, 1, 0, 0)}
