"""The CI gate: problems per template, verdict and text report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ints import int_div
from stmtflow.functions.render import duration_text
from stmtflow.plans.materialize import materialize

REPORT_TITLE = "SQL traffic CI report"


def folded(events: DataFrame) -> DataFrame:
    """Counts per template, or raw text where there is none; all unflagged events share the null key."""
    flagged = F.col("n_plus_1") | F.col("slow_query")
    key = F.when(flagged, F.coalesce(F.nullif("normalized_query", F.lit("")), F.col("query")))
    slow_us = F.when(F.col("slow_query"), F.coalesce("dur_us", F.lit(0)))
    return events.groupBy(key.alias("query")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("n_plus_1").alias("nplus1"),
        F.count_if("slow_query").alias("slow"),
        F.sum(slow_us).alias("slow_us"),
    )


def problems_of(counts: DataFrame) -> DataFrame:
    nplus1 = F.struct(
        F.lit("N+1").alias("kind"), F.col("nplus1").alias("n"), F.lit(None).cast("bigint").alias("avg_us")
    )
    average = int_div(F.col("slow_us"), F.greatest(F.col("slow"), F.lit(1)))
    slow = F.struct(F.lit("SLOW").alias("kind"), F.col("slow").alias("n"), average.alias("avg_us"))
    return (
        counts.select("query", F.explode(F.array(nplus1, slow)).alias("_p"))
        .filter(F.col("_p.n") > 0)
        .select("_p.kind", "query", "_p.n", "_p.avg_us")
    )


def verdict_of(counts: DataFrame) -> DataFrame:
    found = (F.col("nplus1") > 0).cast("bigint") + (F.col("slow") > 0).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return counts.agg(
        F.coalesce(F.sum("events"), zero).alias("total"), F.coalesce(F.sum(found), zero).alias("problems")
    ).select(
        "total",
        "problems",
        (F.col("problems") > 0).alias("has_problems"),
        (F.col("problems") > 0).cast("int").alias("exit_code"),
    )


def ci_problems(events: DataFrame) -> DataFrame:
    """Problems (kind, query, n, avg_us), to be ordered by kind, n descending, query.

    A template, or the raw text where it has none, gives an N+1 row, a SLOW row, or both.
    """
    return problems_of(folded(events))


def ordered_problems(problems: DataFrame) -> DataFrame:
    """Problems in report order."""
    return problems.orderBy("kind", F.col("n").desc(), "query")


def ci_summary(events: DataFrame) -> DataFrame:
    """One row: statements of every kind, problems found, verdict and exit code."""
    return verdict_of(folded(events))


def ci_report(events: DataFrame) -> DataFrame:
    """Report lines, to be ordered by (section, kind, n descending, query)."""
    # Head and body both read the folded counts; the events are read once.
    return report_of(materialize(folded(events), "ci"))


def report_of(counts: DataFrame) -> DataFrame:
    """The report of folded counts."""
    average = duration_text(int_div(F.col("avg_us"), 1000) * 1_000_000)
    shown = F.when(
        F.col("kind") == "N+1",
        F.concat(
            F.lit("  [N+1]  "), F.col("query"), F.lit("  (detected "), F.col("n").cast("string"), F.lit(" times)")
        ),
    ).otherwise(
        F.concat(
            F.lit("  [SLOW] "),
            F.col("query"),
            F.lit("  (avg "),
            average,
            F.lit(", "),
            F.col("n").cast("string"),
            F.lit(" occurrences)"),
        )
    )
    problems = problems_of(counts).select(
        F.lit(3).alias("section"), "kind", "n", "query", shown.alias("line")
    )
    total, found = F.col("total").cast("string"), F.col("problems").cast("string")
    bad = F.col("has_problems")
    head = [
        (0, F.lit(REPORT_TITLE)),
        (1, F.concat(F.lit("Captured: "), total, F.lit(" queries"))),
        (2, F.when(bad, F.lit("Problems found:")).otherwise(F.lit("No problems found."))),
        (4, F.when(bad, F.concat(F.lit("Exit: 1 ("), found, F.lit(" problems found)")))),
    ]
    parts = F.array(*[F.struct(F.lit(s).alias("section"), line.alias("line")) for s, line in head])
    frame = verdict_of(counts).select(F.inline(parts)).filter(F.col("line").isNotNull())
    return frame.select(
        "section", F.lit("").alias("kind"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("query"), "line"
    ).unionByName(problems)
