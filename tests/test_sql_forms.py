"""Every registered query against its SQL form on the smallest tables."""

import re

import compare
import pytest

import __spark_entry__ as entry_module
from gridverify.plans import oracles
from gridverify.plans import queries as registered

SF_DIR = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_a_sql_form():
    assert set(SQL) == set(registered.queries())
    assert set(SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_sql(spark, con, name):
    found = registered.queries()[name](spark, SF_DIR)
    plan = compare.plan(found)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search("PythonUDF|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)
    assert compare.differences(found, con, SQL[name]) == []


def test_entry(spark):
    df = entry_module.entry(spark)
    assert set(df.columns) == {"member", "bin_min", "bin_max", "ME", "MAE", "RMSE"}
    assert df.count() > 0
