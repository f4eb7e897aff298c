"""Filtering, searching and match counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.filters import compile_filter, compile_search, describe_filter


def filter_events(events: DataFrame, filter_text: str = "", search: str = "", web: bool = False) -> DataFrame:
    """Events that meet every token of the filter and hold the search text."""
    return events.filter(compile_filter(filter_text, web)).filter(compile_search(search))


def match_counts(events: DataFrame, filter_text: str = "", search: str = "", web: bool = False) -> DataFrame:
    """One row: events that match, and all events."""
    wanted = compile_filter(filter_text, web) & compile_search(search)
    return events.agg(F.count_if(wanted).alias("matched"), F.count(F.lit(1)).alias("total"))


def describe_filters(saved: DataFrame, column: str = "filter") -> DataFrame:
    """Saved filter lines counted by their canonical form."""
    return saved.groupBy(describe_filter(F.col(column)).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


def op_pattern_counts(events: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """For each pattern of an op: token the events it matches, and all events. Unknown patterns match none."""
    found = F.struct(*[F.count_if(compile_filter(f"op:{p}")).alias(f"p{i}") for i, p in enumerate(patterns)])
    counted = events.agg(found.alias("found"), F.count(F.lit(1)).alias("total"))
    rows = F.array(*[F.struct(F.lit(p.lower()).alias("pattern"), F.col(f"found.p{i}").alias("matched")) for i, p in enumerate(patterns)])
    return counted.select(F.inline(rows), "total")
