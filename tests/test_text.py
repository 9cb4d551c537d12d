from pyspark.sql import functions as F

from tessera.functions import text as T


def values(spark, f, *xs):
    return [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x string").select(f(F.col("x"))).collect()]


def test_deburr_and_ascii(spark):
    assert values(spark, T.deburr, "ñáéßøæÑü", None) == ["naeßøæNu", None]
    assert values(spark, T.ascii_letters, "ßøæ É") == ["ssoae E"]


def test_clean_value(spark):
    assert values(spark, T.clean_value, " nan ", "N/A", "no  aplica", " a   b ", "", None) == [None, None, None, "a b", None, None]


def test_years(spark):
    assert values(spark, T.first_year, "modelo 2019", "19", "2019.0", "1899", "x2019") == [2019, None, 2019, None, None]
    assert values(spark, T.bounded_year, "2026", "2025") == [None, 2025]
    assert values(spark, T.year_code, "1401", "2002", "2099", "3000", "abc", None) == [2001, 2002, 2099, None, None, None]


def test_currency(spark):
    assert values(spark, T.parse_currency, "$1,234", "1,234.56", "", "abc", "12.5") == [1.234, None, None, None, 12.5]


def test_similarity(spark):
    rows = spark.createDataFrame([("Ford", "FORD"), ("Ford", "Ford Fiesta"), ("a b", "b c"), (None, "x"), ("", "x")], "a string, b string")
    assert [r[0] for r in rows.select(T.similarity(F.col("a"), F.col("b"), 0.9)).collect()] == [1.0, 0.9, 1 / 3, 0.0, 0.0]


def test_vin(spark):
    assert values(spark, T.vin_errors, "1HGCM82633A004352", "short", "IHGCM82633A004352", None) == [[], ["VIN must be 17 characters"], ["VIN contains I, O or Q"], []]
