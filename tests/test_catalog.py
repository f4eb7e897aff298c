from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from checks.catalog import QUERIES, templated
from checks.compare import compare, duck
from checks.oracle import ORACLES
from stmtflow.operators import stats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, con, name):
    verdict, _, _ = compare(spark, con, SF, name)
    assert verdict.startswith("ok")


def test_approximate_p95_is_near(spark):
    exact = {r.normalized_query: r.p95_us for r in QUERIES["template_p95"](spark, SF).collect()}
    near = {r.normalized_query: r.p95_us_approx for r in stats.template_p95_approx(templated(spark, SF)).collect()}
    assert near.keys() == exact.keys()
    assert all(abs(near[k] - exact[k]) <= 0.25 * exact[k] for k in exact)
    assert all(r.within for r in QUERIES["template_p95_approx"](spark, SF).collect())


def test_contract(spark):
    assert driver.queries().keys() >= driver.oracle_sql().keys()
    assert driver.entry(spark).count() > 0
