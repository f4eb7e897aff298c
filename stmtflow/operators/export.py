"""Exports: the event feed as JSON, and the JSON and Markdown documents as ordered text lines.

A document is never gathered into one value: it is a set of lines with an order, (section, position),
that a range-sorted text write turns into consecutive files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.binding import format_args
from stmtflow.functions.filters import compile_filter, compile_search
from stmtflow.functions.render import format_ms, format_time, format_time_full, rfc3339_time
from stmtflow.functions.text import escape_pipes
from stmtflow.operators.stats import template_stats_export
from stmtflow.operators.transactions import tx_label
from stmtflow.plans.materialize import materialize
from stmtflow.plans.ordered import laid_out, part_starts
from stmtflow.schema import is_lifecycle_op, op_name

TITLE = "# SQL traffic export"
# The headings below "## ..." and "| ... |" and the head lines "- ..." are the document's format.


def _ms() -> Column:
    return F.coalesce("dur_us", F.lit(0)) / F.lit(1000.0)


def _args() -> Column:
    return F.coalesce("args", F.array().cast("array<string>"))


def event_json(events: DataFrame) -> DataFrame:
    """(seq, json): an event as the feed sends it; empty texts and false flags are left out."""
    flag = {name: F.when(F.col(name), F.lit(True)).alias(name) for name in ("n_plus_1", "slow_query")}
    record = F.struct(
        F.col("seq").cast("string").alias("id"),
        op_name(F.col("op")).alias("op"),
        "query",
        _args().alias("args"),
        rfc3339_time(F.col("start_us")).alias("start_time"),
        _ms().alias("duration_ms"),
        "rows_affected",
        F.nullif("error", F.lit("")).alias("error"),
        F.nullif("tx_id", F.lit("")).alias("tx_id"),
        flag["n_plus_1"],
        flag["slow_query"],
        F.nullif("normalized_query", F.lit("")).alias("normalized_query"),
    )
    return events.select("seq", F.to_json(record).alias("json"))


def exported_events(events: DataFrame, filter_text: str = "", search: str = "", web: bool = False) -> DataFrame:
    """The rows of an export."""
    return events.filter(compile_filter(filter_text, web) & compile_search(search))


def export_summary(events: DataFrame, filter_text: str = "", search: str = "", web: bool = False) -> DataFrame:
    """One row: captured, exported, filter, search, first and last start of the exported rows by arrival."""
    return _summary(events, filter_text, search, web).drop("measured")


def _evaluated(events: DataFrame, filter_text: str, search: str, web: bool) -> DataFrame:
    """The events' columns that documents show, with `_wanted`, stored: filter, template and labels are evaluated once.

    Of rows that are not exported only numbers are kept. The rows are stored by range partitions, exported ones first
    and by arrival, so that their places in the document follow from the partitions' sizes.
    """
    wanted = F.coalesce(compile_filter(filter_text, web) & compile_search(search), F.lit(False))
    numbers = [c for c in ("seq", "start_us", "dur_us", "op", "rows_affected") if c in events.columns]
    shown = [c for c in ("query", "args", "error", "tx_id", "normalized_query") if c in events.columns]
    told = events.withColumn("_wanted", wanted)
    kept = told.select(*numbers, *[F.when(F.col("_wanted"), F.col(c)).alias(c) for c in shown], "_wanted")
    return laid_out(kept, [~F.col("_wanted"), F.col("seq")], "export")


def _summary(events: DataFrame, filter_text: str, search: str, web: bool) -> DataFrame:
    """The summary, with the number of exported rows that statistics may count."""
    wanted = F.col("_wanted") if "_wanted" in events.columns else compile_filter(filter_text, web) & compile_search(search)
    at = F.when(wanted, F.col("seq"))
    counts = wanted & ~is_lifecycle_op(F.col("op"))
    if "normalized_query" in events.columns:
        counts = counts & (F.col("normalized_query") != "")
    return events.agg(
        F.count(F.lit(1)).alias("captured"),
        F.count_if(wanted).alias("exported"),
        F.count_if(counts).alias("measured"),
        F.min_by("start_us", at).alias("_first"),
        F.max_by("start_us", at).alias("_last"),
    ).select(
        "measured",
        "captured",
        "exported",
        F.lit(filter_text).alias("filter"),
        F.lit(search).alias("search"),
        F.when(F.col("exported") > 0, format_time_full(F.col("_first"))).otherwise("").alias("period_start"),
        F.when(F.col("exported") > 0, format_time_full(F.col("_last"))).otherwise("").alias("period_end"),
    )


def _lines(section: int, lines: list[Column]) -> list[Column]:
    return [
        F.struct(F.lit(section).alias("section"), F.lit(i).cast("bigint").alias("position"), line.alias("line"))
        for i, line in enumerate(lines)
    ]


def _numbered(evaluated: DataFrame) -> DataFrame:
    """The exported rows with their `position` and `_total`, from the stored layout."""
    starts = part_starts(evaluated, F.count_if("_wanted"), "_start", "_total")
    position = (F.col("_start") + F.col("_place") + 1).cast("bigint")
    return evaluated.filter("_wanted").join(F.broadcast(starts), "_part").withColumn("position", position)


def export_markdown(events: DataFrame, filter_text: str = "", search: str = "", web: bool = False) -> DataFrame:
    """Lines (section, position, line) of the Markdown document.

    The browser form has no search, escapes pipes in the filter and the arguments too, and rounds
    half up.
    """
    if web and search:
        raise ValueError("the browser export has no search")
    events = _evaluated(events, filter_text, search, web)
    exported = events.filter("_wanted")
    escaped = escape_pipes if web else (lambda c: c)
    named = [("filter: ", filter_text), ("search: ", search)]
    given = [F.concat(F.lit(label), escaped(F.lit(text))) for label, text in named if text]
    suffix = F.concat(F.lit(" ("), F.concat_ws(", ", *given), F.lit(")")) if given else F.lit("")
    head = [
        F.lit(TITLE),
        F.lit(""),
        F.concat(F.lit("- Captured: "), F.col("captured").cast("string"), F.lit(" queries")),
        F.concat(F.lit("- Exported: "), F.col("exported").cast("string"), F.lit(" queries"), suffix),
        F.when(
            F.col("period_start") != "",
            F.concat(F.lit("- Period: "), F.col("period_start"), F.lit(" — "), F.col("period_end")),
        ),
        F.lit(""),
        F.lit("## Queries"),
        F.lit(""),
        F.lit("| # | Time | Op | Duration | Query | Args | Error |"),
        F.lit("|---|------|----|----------|-------|------|-------|"),
    ]
    stats_head = [
        F.lit(""),
        F.lit("## Analytics"),
        F.lit(""),
        F.lit("| Query | Count | Avg | P95 | Max | Total |"),
        F.lit("|-------|-------|-----|-----|-----|-------|"),
    ]
    shown = [F.when(F.col("measured") > 0, line) for line in stats_head]
    frame = (
        _summary(events, filter_text, search, web)
        .select(F.inline(F.array(*_lines(0, head), *_lines(2, shown))))
        .filter(F.col("line").isNotNull())
    )

    def table_row(*cells: Column) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    args = _args()
    if web:
        args = F.transform(args, escape_pipes)
    row = table_row(
        F.col("position").cast("string"),
        format_time(F.col("start_us")),
        op_name(F.col("op")),
        format_ms(_ms(), web),
        escape_pipes(F.col("query")),
        format_args(args),
        escape_pipes(F.col("error")),
    )
    body = _numbered(events).select(F.lit(1).alias("section"), "position", row.alias("line"))
    stats = template_stats_export(exported)
    stats_row = table_row(
        escape_pipes(F.col("normalized_query")),
        F.col("count").cast("string"),
        *[format_ms(F.col(c), web) for c in ("avg_ms", "p95_ms", "max_ms", "total_ms")],
    )
    stats_body = stats.select(
        F.lit(3).alias("section"), F.col("first_seq").alias("position"), stats_row.alias("line")
    )
    return frame.unionByName(body).unionByName(stats_body)


def export_json(events: DataFrame, filter_text: str = "", search: str = "", web: bool = False) -> DataFrame:
    """Lines (section, position, line) of the JSON document; read in order they are one valid object."""
    if web and search:
        raise ValueError("the browser export has no search")
    events = _evaluated(events, filter_text, search, web)
    exported = events.filter("_wanted")
    summary = export_summary(events, filter_text, search, web)

    def text(value: Column) -> Column:
        # A JSON string: the one-element array without its brackets.
        return F.regexp_replace(F.to_json(F.array(value)), r"\A\[|\]\z", "")

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'  "{name}": '), value, F.lit(","))

    period = F.to_json(F.struct(F.col("period_start").alias("start"), F.col("period_end").alias("end")))
    head = [
        F.lit("{"),
        field("captured", F.col("captured").cast("string")),
        field("exported", F.col("exported").cast("string")),
        field("filter", text(F.col("filter"))),
        field("search", text(F.col("search"))),
        field("period", period),
        F.lit('  "queries": ['),
    ]
    frame = summary.select(
        F.inline(
            F.array(
                *_lines(0, head),
                *_lines(2, [F.lit("  ],"), F.lit('  "analytics": [')]),
                *_lines(4, [F.lit("  ]"), F.lit("}")]),
            )
        )
    )
    record = F.struct(
        format_time(F.col("start_us")).alias("time"),
        op_name(F.col("op")).alias("op"),
        "query",
        _args().alias("args"),
        _ms().alias("duration_ms"),
        "rows_affected",
        F.coalesce("error", F.lit("")).alias("error"),
        tx_label(F.col("tx_id")).alias("tx_id"),
    )

    def element(json: Column, last: Column) -> Column:
        return F.concat(F.lit("    "), json, F.when(last, F.lit("")).otherwise(F.lit(",")))

    rows = _numbered(events).select(
        F.lit(1).alias("section"),
        "position",
        element(F.to_json(record), F.col("position") == F.col("_total")).alias("line"),
    )
    stats = materialize(template_stats_export(exported), "export-stats")
    stat = F.struct(
        F.col("normalized_query").alias("query"), "count", "total_ms", "avg_ms", "p95_ms", "max_ms"
    )
    final = stats.agg(F.max("first_seq").alias("_final"))
    stat_rows = stats.crossJoin(F.broadcast(final)).select(
        F.lit(3).alias("section"),
        F.col("first_seq").alias("position"),
        element(F.to_json(stat), F.col("first_seq") == F.col("_final")).alias("line"),
    )
    return frame.unionByName(rows).unionByName(stat_rows)
