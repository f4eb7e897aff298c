"""Per-template statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.filters import compile_template_filter
from stmtflow.functions.ints import int_div
from stmtflow.plans.quantile import stats_with_quantile
from stmtflow.schema import is_lifecycle_op

P95 = 0.95
SORT_MODES = {"total": "total_us", "count": "n", "avg": "avg_us", "p95": "p95_us", "max": "max_us"}


def measured(events: DataFrame) -> DataFrame:
    """What statistics count: everything but lifecycle operations; a missing duration is 0."""
    return events.filter(~is_lifecycle_op(F.col("op"))).withColumn("dur_us", F.coalesce("dur_us", F.lit(0)))


def _stats(measured_events: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Statistics of every template that is not empty."""
    keep = F.col("normalized_query") != ""
    return stats_with_quantile(measured_events, ["normalized_query"], "dur_us", P95, extra, keep)


def template_stats(events: DataFrame) -> DataFrame:
    """Count, total, whole-number average, p95 and maximum per template, in microseconds."""
    stats = _stats(measured(events))
    return stats.select(
        "normalized_query",
        "n",
        F.col("total").alias("total_us"),
        int_div(F.col("total"), F.col("n")).alias("avg_us"),
        F.col("quantile").alias("p95_us"),
        F.col("largest").alias("max_us"),
    )


def _milliseconds(stats: DataFrame) -> list[Column]:
    total = F.col("total") / F.lit(1000.0)
    return [
        F.col("n").alias("count"),
        total.alias("total_ms"),
        (total / F.col("n")).alias("avg_ms"),
        (F.col("quantile") / F.lit(1000.0)).alias("p95_ms"),
        (F.col("largest") / F.lit(1000.0)).alias("max_ms"),
    ]


def template_stats_export(exported: DataFrame) -> DataFrame:
    """The statistics of an export in milliseconds; `first_seq` is the order of first appearance."""
    stats = _stats(measured(exported), {"first_seq": F.col("seq")})
    return stats.select("normalized_query", *_milliseconds(stats), "first_seq")


def template_stats_web(events: DataFrame, filter_text: str = "") -> DataFrame:
    """Statistics whose template holds the text tokens of the filter; other tokens do not count."""
    kept = measured(events).filter(compile_template_filter(filter_text))
    stats = _stats(kept)
    return stats.select("normalized_query", *_milliseconds(stats))


def template_p95(events: DataFrame) -> DataFrame:
    """The exact lower p95 per template."""
    stats = _stats(measured(events))
    return stats.select("normalized_query", F.col("quantile").alias("p95_us"))


def template_p95_approx(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """An approximate p95 per template from one mergeable sketch."""
    sketches = measured(events).groupBy("normalized_query").agg(
        F.percentile_approx("dur_us", P95, accuracy).alias("p95_us_approx"), F.count(F.lit(1)).alias("n")
    )
    return sketches.filter(F.col("normalized_query") != "")


def template_p95_check(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Per template the events and whether the approximate p95 has a rank within the sketch's stated accuracy."""
    near = template_p95_approx(events, accuracy).withColumnRenamed("p95_us_approx", "p95_us")
    return rank_check(near, events, 1 / accuracy)


def rank_check(near: DataFrame, events: DataFrame, error: float) -> DataFrame:
    """Per template its events and whether `p95_us` has a rank within `error` of all its events from the true one."""
    placed = measured(events).join(near.select("normalized_query", "n", "p95_us"), "normalized_query")
    below, upto = F.count_if(F.col("dur_us") < F.col("p95_us")), F.count_if(F.col("dur_us") <= F.col("p95_us"))
    ranks = placed.groupBy("normalized_query", "n").agg(below.alias("_below"), upto.alias("_upto"))
    slack, rank = F.col("n") * error + 1, F.col("n") * P95
    within = (F.col("_below") <= rank + slack) & (F.col("_upto") >= rank - slack)
    return ranks.select("normalized_query", "n", within.alias("within"))


def top_templates(stats: DataFrame, mode: str = "total", top: int | None = None, ascending: bool = False) -> DataFrame:
    """Statistics sorted by total, count, avg, p95 or max, ties by template; the first `top` when given."""
    column = F.col(SORT_MODES[mode])
    ordered = stats.orderBy(column.asc() if ascending else column.desc(), "normalized_query")
    return ordered if top is None else ordered.limit(top)
