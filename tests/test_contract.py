"""Every registered query with SQL against DuckDB over the smallest tables."""

import glob
import math
import os

import pytest

from tessera.plans import cases, checks, contract, fuzzy, lookups, matches, records, rows, states, tables, vectors  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    rel = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()], key=repr)
    assert sorted(names) == cols
    assert got == want


def test_no_cross_join_and_group_limit(spark):
    plan = lambda name: contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    best = plan("queue_match")  # the best of a key by an aggregate that is combined before the shuffle
    assert "Cartesian" not in best and "NestedLoop" not in best and "Window" not in best
    assert "WindowGroupLimit" in plan("candidate_cap")
