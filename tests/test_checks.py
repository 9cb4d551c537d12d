"""Attributes, row checks and tables of mails on small inputs."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import attributes as A
from tessera.functions.html import html_tables, parse_tables
from tessera.operators import checks as C


def test_tables_of_html(spark):
    assert parse_tables("<table><tr><th>a<th>b</tr><tr></tr></table><table></table>") == [{"rows": [["ab", "b"]], "row_count": 1, "column_count": 2}]  # an open cell holds the next one
    assert parse_tables("<TABLE><tr><td>1</td></tr></tr><tr><td>2<br>x &amp; &#233;</td></table><p>") == [{"rows": [["1"], ["2x & é"]], "row_count": 2, "column_count": 1}]
    assert parse_tables("<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>") == [{"rows": [["oi", "i"], ["i"]], "row_count": 2, "column_count": 2}, {"rows": [["i"]], "row_count": 1, "column_count": 1}]
    assert parse_tables("</td></table><td>x</td><table><td>no row</td></table>") == [] == parse_tables(None) == parse_tables("") == parse_tables("<table><tr><td>")[1:]
    assert len(parse_tables("<table>" + "<tr><td>x</td></tr>" * 20_000)[0]["rows"]) == 20_000
    df = spark.createDataFrame([("<table><tr><td>1</td></tr></table>",), (None,)], "h string")
    assert [[(x.rows, x.row_count) for x in r[0]] for r in df.select(html_tables(F.col("h"))).collect()] == [[([["1"]], 1)], []]


def test_merge_takes_the_first_that_tells(spark):
    row = lambda **own: tuple(own.get(f) for f in A.FIELDS)
    kind = "struct<" + ",".join(f"{f}:{t}" for f, t in A.FIELDS.items()) + ">"
    df = spark.createDataFrame([(row(brand="", year=0, doors=4), row(brand="m", fuel="TD"), row(brand="r", year=2001, fuel="gas", doors=9))], f"x {kind}, m {kind}, r {kind}")
    a = A.merged(F.col("x"), F.col("m"), F.col("r"))
    r = df.select(a.alias("a"), A.code(F.lit("camioneta"), A.BODY_CODES).alias("b"), A.code(F.lit(""), A.BODY_CODES).alias("e"), A.overall_confidence(a, F.lit(0.5), F.lit(None).cast("double")).alias("c"), A.overall_confidence(a, F.lit(0.0), F.lit(0.4)).alias("d")).head()
    assert (r.a.brand, r.a.year, r.a.fuel, r.a.doors, r.b, r.e, round(r.c, 6), r.d) == ("m", 2001, "TD", 4, "PICKUP", None, 0.35, 0.4)


def test_settings_of_a_match():
    w, a = {"brand": 0.4, "model": 0.35, "year": 0.15, "attributes": 0.1}, {"fuel": 0.3, "drivetrain": 0.25, "body": 0.25, "trim": 0.2}
    C.check_criteria(w, a, 0.5, 0.7, 0.9, 10)
    for bad in (({"brand": 0.4}, a, 0.5, 0.7, 0.9, 10), (w, {"fuel": 2}, 0.5, 0.7, 0.9, 10), (w, a, 0.8, 0.7, 0.9, 10), (w, a, 0.5, 0.7, 1.9, 10), (w, a, 0.5, 0.7, 0.9, 0)):
        with pytest.raises(ValueError):
            C.check_criteria(*bad)


def test_rows_without_the_columns(spark):
    df = spark.createDataFrame([(1,)], "k int")
    assert df.select(C.extracted_errors(df, ["vin"], 2025)).head()[0] == ["Row is completely empty"]
    assert df.select(C.template_errors(df)).head()[0] == [f"{c} is required" for c in ("MARCA", "MODELO", "AÑO", "COBERTURA", "CVEGS")]
    assert C.canonical(df).head().errors == [f"{c} is required" for c in ("vin", "description", "brand", "model_year")]
