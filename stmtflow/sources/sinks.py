"""Writing logs, feeds and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stmtflow.operators.export import event_json


def write_enriched(events: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The enriched log as Parquet, so that templates and flags are computed once."""
    writer = events.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_event_feed(events: DataFrame, path: str) -> None:
    """One JSON object per line."""
    event_json(events).select("json").write.mode("overwrite").text(path)


def write_document(lines: DataFrame, path: str) -> None:
    """Export lines as text files whose concatenation by name is the document."""
    ordered = lines.orderBy("section", "position").select("line")
    ordered.write.mode("overwrite").text(path)
