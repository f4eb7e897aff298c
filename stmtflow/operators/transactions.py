"""Transactions: labels, summaries, the grouped listing and per-transaction detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.render import format_duration, format_time_full
from stmtflow.functions.text import classify_op, squash_truncate
from stmtflow.plans.ordered import LAST, running
from stmtflow.schema import BEGIN, COMMIT, ROLLBACK, is_lifecycle_op, is_query_op, op_name

SUMMARY_ROW, EVENT_ROW = 0, 1
NONE_OPEN = -(1 << 62)


def assign_tx(log: DataFrame, driver: str = "postgres", chunk_rows: int | None = None) -> DataFrame:
    """Set `op` to Begin, Commit or Rollback by the text and add `tx_id`, null outside transactions.

    BEGIN opens a label on its connection, replacing an open one; COMMIT and ROLLBACK carry the label and
    close it. Labels are connection-seq of the BEGIN. The state before a row is the last boundary before
    it, so one running value per connection is enough.
    """
    classified = log.withColumn("op", classify_op(F.col("op"), F.col("query"), driver))
    opens = F.col("op") == BEGIN
    closes = F.col("op").isin(COMMIT, ROLLBACK)
    # A number, not a struct, so that chunks are summarised by hash aggregation.
    boundary = F.when(opens, F.col("seq")).when(closes, F.lit(NONE_OPEN))
    state = running(classified, ["conn_id"], "seq", {"_open": (LAST, boundary)}, inclusive=False, chunk_rows=chunk_rows)
    begin_seq = F.when(opens, F.col("seq")).when(F.col("_open") != NONE_OPEN, F.col("_open"))
    label = F.concat(F.col("conn_id").cast("string"), F.lit("-"), begin_seq.cast("string"))
    return state.withColumn("tx_id", label).drop("_open")


def tx_summary(events: DataFrame) -> DataFrame:
    """Per transaction: statements run, wall time from the first to the end of the last arrival, start.

    `n_queries` counts Query, Exec and Execute; `n_not_lifecycle` counts everything but the lifecycle
    operations, as the browser does.
    """
    end = F.col("start_us") + F.coalesce(F.col("dur_us"), F.lit(0))
    return (
        events.filter(F.col("tx_id").isNotNull())
        .groupBy("tx_id")
        .agg(
            F.count_if(is_query_op(F.col("op"))).alias("n_queries"),
            F.count_if(~is_lifecycle_op(F.col("op"))).alias("n_not_lifecycle"),
            F.count(F.lit(1)).alias("n_events"),
            F.min_by("start_us", "seq").alias("start_us"),
            F.max_by(end, "seq").alias("_end"),
        )
        .withColumn("wall_us", F.col("_end") - F.col("start_us"))
        .drop("_end")
    )


def tx_listing(events: DataFrame, collapsed: DataFrame | None = None) -> DataFrame:
    """Rows of the grouped list, to be ordered by (anchor, kind, seq).

    A transaction shows at its first Begin: a summary row, then its events unless its id is in
    `collapsed`. Events outside transactions, or of one without a Begin, stay at their own place.
    """
    anchors = (
        events.filter((F.col("op") == BEGIN) & F.col("tx_id").isNotNull())
        .groupBy("tx_id")
        .agg(F.min("seq").alias("anchor"))
    )
    if collapsed is not None:
        folded = collapsed.select("tx_id", F.lit(True).alias("_folded")).distinct()
        placed = anchors.join(folded, "tx_id", "left")
    else:
        placed = anchors.withColumn("_folded", F.lit(None).cast("boolean"))
    # Events outside transactions get join keys of their own, or they would all meet in one task.
    single = F.concat(F.lit("none-"), F.col("seq").cast("string"))
    keyed = events.select("tx_id", "seq", F.coalesce("tx_id", single).alias("_tx"))
    shown = keyed.join(placed.withColumnRenamed("tx_id", "_tx"), "_tx", "left").filter(F.col("_folded").isNull())
    rows = shown.select(
        F.coalesce("anchor", "seq").alias("anchor"), F.lit(EVENT_ROW).alias("kind"), "seq", "tx_id"
    )
    heads = anchors.select("anchor", F.lit(SUMMARY_ROW).alias("kind"), F.col("anchor").alias("seq"), "tx_id")
    return rows.unionByName(heads)


def flat_by_duration(events: DataFrame, top: int | None = None) -> DataFrame:
    """Slowest first without grouping; the first `top` rows when given."""
    ordered = events.orderBy(F.coalesce("dur_us", F.lit(0)).desc(), "seq")
    return ordered if top is None else ordered.limit(top)


def tx_detail(events: DataFrame, query_width: int = 60, preview: bool = False) -> DataFrame:
    """Text of each transaction, one row per line, ordered by (tx_id, section, seq).

    The lines stay rows: a transaction of any length is never gathered into one value. A `preview` lists
    only the statements run.
    """
    named = F.when(F.col("n_queries") == 1, F.lit("1 query")).otherwise(
        F.concat(F.col("n_queries").cast("string"), F.lit(" queries"))
    )
    head_lines = [
        F.lit("Type:     Transaction"),
        F.concat(F.lit("Queries:  "), named),
        F.concat(F.lit("Duration: "), format_duration(F.col("wall_us"))),
        F.concat(F.lit("Time:     "), format_time_full(F.col("start_us"))),
        F.concat(F.lit("Tx:       "), F.col("tx_id")),
    ]
    heads = tx_summary(events).select("tx_id", F.posexplode(F.array(*head_lines)).alias("section", "line"))
    text = F.coalesce(F.nullif(squash_truncate(F.col("query"), query_width), F.lit("")), F.lit("-"))
    line = F.concat(F.lit("  "), F.rpad(op_name(F.col("op")), 8, " "), F.lit(" "), text)
    body = events.filter(F.col("tx_id").isNotNull())
    if preview:
        body = body.filter(is_query_op(F.col("op")))
    else:
        line = F.concat(line, F.lit(" "), format_duration(F.col("dur_us")))
    lines = body.select("tx_id", F.lit(len(head_lines)).alias("section"), "seq", line.alias("line"))
    return heads.select("tx_id", "section", F.lit(-1).cast("bigint").alias("seq"), "line").unionByName(lines)


def event_detail(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Detail of the events whose `seq` is wanted; what the viewer leaves out is null."""
    args = F.array_join("args", ", ")
    return events.join(wanted.select("seq").distinct(), "seq", "left_semi").select(
        "seq",
        op_name(F.col("op")).alias("op"),
        F.nullif("query", F.lit("")).alias("query"),
        F.when(F.size("args") > 0, F.concat(F.lit("["), args, F.lit("]"))).alias("args"),
        format_duration(F.col("dur_us")).alias("duration"),
        format_time_full(F.col("start_us")).alias("time"),
        F.when(F.col("rows_affected") > 0, F.col("rows_affected")).alias("rows_affected"),
        F.nullif("error", F.lit("")).alias("error"),
        "tx_id",
    )


def tx_label(tx_id: Column) -> Column:
    """The label as exported: empty outside transactions."""
    return F.coalesce(tx_id, F.lit(""))
