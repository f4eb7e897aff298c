"""The enrichment lineage: template, flags and transaction labels on a statement log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.config import DEFAULTS, DetectionConfig
from stmtflow.functions.text import normalize_query
from stmtflow.operators.nplus1 import with_nplus1
from stmtflow.operators.transactions import assign_tx


def with_template(log: DataFrame) -> DataFrame:
    """Add `normalized_query`."""
    return log.withColumn("normalized_query", normalize_query(F.col("query")))


def with_slow(log: DataFrame, config: DetectionConfig = DEFAULTS) -> DataFrame:
    """Add `slow_query`: a duration at or over the limit, whatever the operation."""
    slow = F.coalesce(F.col("dur_us") >= config.slow_us, F.lit(False)) if config.slow_us > 0 else F.lit(False)
    return log.withColumn("slow_query", slow)


def enrich(log: DataFrame, config: DetectionConfig = DEFAULTS, key: str = "raw", driver: str = "postgres") -> DataFrame:
    """The full event: template, N+1 and slow flags, operation by text, transaction label.

    N+1 counts statements by their raw text, or by template with key='template'.
    """
    if key not in ("raw", "template"):
        raise ValueError(f"unknown N+1 key: {key}")
    scalar = with_slow(with_template(log), config)
    by = F.col("query") if key == "raw" else F.col("normalized_query")
    return with_nplus1(assign_tx(scalar, driver), by, config, detect_on=scalar)
