"""Every registered query against its SQL, and what its plan may not contain."""

import re

import pytest
from compare import duck, run

import __spark_entry__ as entry_module
from pacemark.plans import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
# on the smallest tables the rank test takes its exact path, which the SQL does not have
NEEDS_MORE_ROWS = {"wilcoxon_test", "model_comparison", "sensitivity_analysis", "sensitivity_verdict"}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result_as_sql(spark, con, name):
    folder = "/root/testdata/sf0.01" if name in NEEDS_MORE_ROWS else SMALL
    r = run(spark, duck(folder) if folder != SMALL else con, QUERIES[name], SQL[name], folder)
    assert r["verdict"] == "ok"
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", r["plan"])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:3] == ["model", "n", "mae"] and df.count() == 3


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["pairs_first_resolution"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type, [error,purchase])" in plan
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", QUERIES["repo_shares"](spark, SMALL)
                       ._jdf.queryExecution().executedPlan().toString())
    assert scans and all("props" not in s for s in scans)
