"""years_and_money against its SQL where the price holds the only year."""

import pytest

from tessera.plans import contract

duckdb = pytest.importorskip("duckdb")


def test_a_price_may_hold_the_year(spark, tmp_path):
    rows = [(1, 1950.12), (2, 2005.0), (3, 19501.5), (60, 1950.12), (300, 20_100_000.5), (301, None), (302, 1899.999)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(c.execute(contract.oracle_sql()["years_and_money"]).fetchall())
    assert sorted(tuple(r) for r in contract.queries()["years_and_money"](spark, str(tmp_path)).collect()) == want
    assert [r[1] for r in want] == [1950, 2005, None, 1910, None, None, 1900]
