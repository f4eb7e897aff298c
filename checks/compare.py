"""Run catalogue queries in Spark and their SQL in DuckDB, and compare rows without regard to order."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.catalog import QUERIES
from checks.oracle import ORACLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with every table as a view."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows: list[tuple]) -> list[tuple]:
    """Rows in a comparable order."""

    def cell(v: object) -> object:
        if isinstance(v, float):
            return 0.0 if v == 0 else (float(f"{v:.9g}") if math.isfinite(v) else str(v))
        return v

    return sorted((tuple(cell(v) for v in row) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> tuple[str, float, float]:
    """'ok', 'rows only' or a difference, with seconds in Spark and DuckDB."""
    begin = time.time()
    names, got = spark_rows(QUERIES[name](spark, sf_dir))
    took = time.time() - begin
    if name not in ORACLES:
        return f"rows only ({len(got)})", took, 0.0
    begin = time.time()
    rel = con.sql(ORACLES[name])
    wanted_names = sorted(rel.columns)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}", took, 0.0
    wanted = [tuple(r) for r in rel.select(*[duckdb.ColumnExpression(n) for n in wanted_names]).fetchall()]
    duck_took = time.time() - begin
    got, wanted = canonical(got), canonical(wanted)
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}", took, duck_took
    for a, b in zip(got, wanted):
        if a != b:
            return f"{names}\n   spark  {a}\n   duckdb {b}", took, duck_took
    return f"ok ({len(got)})", took, duck_took
