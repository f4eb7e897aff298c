"""Intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stmtflow.session import work_dir


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it from there.

    For results that several branches of a plan use: they are computed once, and a lost executor costs
    a re-read, not the lineage.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
