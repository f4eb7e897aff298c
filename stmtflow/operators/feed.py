"""Event status and the feed of alert lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status marks and bar classes.
STATUS_MARKS = ("E", "N+1", "SLOW", "")
BAR_CLASSES = ("error", "nplus1", "slow", "normal")


def _ladder(names: tuple[str, ...]) -> Column:
    failed, repeated, slow, plain = map(F.lit, names)
    return (
        F.when(F.col("error") != "", failed)
        .when(F.col("n_plus_1"), repeated)
        .when(F.col("slow_query"), slow)
        .otherwise(plain)
    )


def event_status() -> Column:
    """The mark of an event: error before N+1 before slow."""
    return _ladder(STATUS_MARKS)


def bar_class() -> Column:
    """The class of an event's timeline bar."""
    return _ladder(BAR_CLASSES)


def alert_feed(events: DataFrame, web: bool = False) -> DataFrame:
    """One line per flagged event."""
    query = F.col("query")
    label = F.when(F.col("n_plus_1"), F.lit("N+1 detected: ")).otherwise(F.lit("Slow query: "))
    if web:
        shown = F.substring(query, 1, 80)
    else:
        shown = F.when(F.length(query) > 60, F.concat(F.substring(query, 1, 57), F.lit("..."))).otherwise(query)
    return events.filter(F.col("n_plus_1") | F.col("slow_query")).select("seq", F.concat(label, shown).alias("line"))
