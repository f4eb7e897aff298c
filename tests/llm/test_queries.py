"""Every registered query against its DuckDB counterpart; the others against their own tests."""

from __future__ import annotations

import os

import duckdb
import pytest

from checks.compare import canonical, duck, spark_rows
from stmtflow.llm.queries import QUERIES
from stmtflow.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, name):
    names, got = spark_rows(QUERIES[name](spark, SF))
    rel = duck(SF).sql(ORACLES[name])
    keep = [i for i, c in enumerate(names) if c in rel.columns]
    wanted = rel.select(*[duckdb.ColumnExpression(names[i]) for i in keep]).fetchall()
    assert canonical([tuple(r[i] for i in keep) for r in got]) == canonical([tuple(r) for r in wanted])


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))
