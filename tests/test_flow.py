"""The whole flow of matching on small inputs: every kind of row, nulls, ties, repeated entries."""

from pyspark.sql import functions as F

from tessera.operators import flow as L
from tessera.operators import matching as M

RECORDS = "query_id long, q_brand string, q_model string, q_year int, fuel string, drivetrain string, body string, error string"
ENTRIES = "code long, brand string, model string, year int, description string"


def run(spark, records, entries):
    return {r.query_id: r for r in L.match_records(spark.createDataFrame(records, RECORDS), spark.createDataFrame(entries, ENTRIES), F.col("error")).collect()}


def test_kinds_of_rows(spark):
    entries = [(1, "Ford", "Fiesta", 2012, "Ford Fiesta diesel"), (2, "FORD ", "Focus", 2012, "Ford Focus"), (3, "ford", "Fiesta", 2015, "Ford Fiesta gas 4x4"), (4, "Kia", "Rio", 2010, None), (4, "Kia", "Rio", 2010, None)]
    none = (None, None, None, None)
    got = run(spark, [
        (1, " ford", "FIESTA", 2012, "DIESEL", None, None, None), (2, "Ford", "Fiesta", None, *none), (3, "Opel", "Corsa", 2010, *none), (4, None, "Fiesta", 2012, *none), (5, "Ford", "Fiesta", 2012, None, None, None, "bad"),
        (6, "Ford", None, 2012, *none), (7, "Ford", "Zzz", 1999, *none), (8, "kia", "Rio", 2011, *none),
    ], entries)
    assert {q: r.status for q, r in got.items()} == {1: "MATCHED", 2: "MATCHED", 3: "NO_MATCH", 4: "NO_MATCH", 5: "ERROR", 6: "MATCHED", 7: "MATCHED", 8: "MATCHED"}
    assert (got[1].code, got[1].strategy, got[1].matches, got[1].candidates, got[1].decision) == (1, "brand_year_model", "brand,model,year,fuel", 1, "auto_accept")
    assert got[2].strategy == "brand_model" and got[2].candidates == 2 and "Year not provided in Excel data" in got[2].warnings
    assert (got[3].code, got[3].warnings, got[3].decision, got[3].level) == (None, "No matching vehicle found in dataset", "no_match", "very_low")
    assert got[5].warnings == "Error: bad" and got[5].candidates == 0 and got[5].confidence == 0
    assert got[6].strategy == "brand_year" and got[6].candidates == 2
    assert got[7].strategy == "brand" and "Model mismatch: Excel 'Zzz'" in got[7].warnings
    assert got[8].code == 4 and got[8].candidates == 2  # the entry is there twice


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a", "b", 2000, "c")]) == {}
    assert {r.status for r in run(spark, [(1, "a", "b", 2000, None, None, None, None)], []).values()} == {"NO_MATCH"}


def test_no_year_among_tied(spark):
    rows = [("q", 1, 0.9, None, None, 0.5, 0.0, 3), ("q", 2, 0.9, None, None, 0.5, 0.0, 3)]
    df = spark.createDataFrame(rows, "q string, code long, score double, y int, qy int, full double, strength double, detail int")
    assert [(r.code, r.tied) for r in M.break_ties(df, "q").collect()] == [(1, 2)]


def test_what_is_stored_grows_with_keys_not_pairs(spark, monkeypatch):
    """Records and entries of one brand and year that differ in their attributes alone: nothing is kept for each pair of them."""
    fuels, drives, bodies = ("DIESEL", "GASOLINA", "HYBRID", "ELECTRIC"), ("4X4", "AWD", "FWD", "RWD"), ("SEDAN", "SUV", "PICKUP")
    kinds = [(f, d, b) for f in fuels for d in drives for b in bodies]
    entries = [(i, "Ford", "Fiesta", 2012, " ".join(k)) for i, k in enumerate(kinds)]
    records = [(i, "Ford", "Fiesta", 2012, k[0].replace("GASOLINA", "GASOLINE"), k[1], k[2], None) for i, k in enumerate(kinds)]
    sizes, stored = [], L.stored

    def counted(df):
        out = stored(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(L, "stored", counted)
    got = run(spark, records, entries)
    assert all((got[i].code, got[i].candidates) == (i, len(kinds)) for i in range(len(kinds)))
    assert max(sizes) <= 2 * len(kinds)  # before, one row for each of 48 * 48 pairs
