"""Work that is made of the rows of a small file is dealt over the cores."""

import os

import pytest

from tessera.plans import contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", ["html_mail_tables", "domain_confidence"])
def test_one_file_is_many_tasks(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression [{'c_custkey' if name == 'html_mail_tables' else 'p_partkey'}" in plan


def test_parts_of_a_join_grow_in_number(spark, monkeypatch):
    """Both sides of the join are dealt in as many parts as their rows ask for."""
    rows = sum(contract.table(spark, SF, t).count() for t in ("orders", "lineitem"))
    monkeypatch.setattr(contract, "PART_ROWS", 500, raising=False)
    plan = contract.queries()["processed_split"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"], {-(-rows // 500)}") == 4  # two sides of two joins
