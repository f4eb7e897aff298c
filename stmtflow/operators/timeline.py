"""The timeline: bounds, bar layout, axis ticks, and running statements over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.ints import floor_div, int_div
from stmtflow.functions.render import format_duration_ns, format_ms
from stmtflow.plans.ordered import LAST, prefix_sum, running
from stmtflow.schema import is_query_op


def drawn(events: DataFrame, last: int | None = None) -> DataFrame:
    """The statements a timeline draws; only the `last` arrivals when given."""
    kept = events.filter(is_query_op(F.col("op"))).withColumn("dur_us", F.coalesce("dur_us", F.lit(0)))
    return kept if last is None else kept.orderBy(F.col("seq").desc()).limit(last)


def timeline_bounds(bars: DataFrame) -> DataFrame:
    """One row: first start, last end, and the span in whole milliseconds, at least 1."""
    return bars.agg(
        F.min("start_us").alias("min_us"),
        F.max(F.col("start_us") + F.col("dur_us")).alias("max_us"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("span_ms", F.greatest(int_div(F.col("max_us") - F.col("min_us"), 1000), F.lit(1).cast("bigint")))


def timeline_layout(bars: DataFrame, width: int) -> DataFrame:
    """Place of every bar on a chart of `width` columns."""
    bounds = timeline_bounds(bars).select("min_us", "span_ms")
    start = int_div(F.col("start_us") - F.col("min_us"), 1000) / F.col("span_ms").cast("double")
    share = int_div(F.col("dur_us"), 1000) / F.col("span_ms").cast("double")
    first = F.floor(F.col("start_frac") * width)
    size = F.greatest(F.ceil(F.col("dur_frac") * width), F.lit(1).cast("bigint"))
    return (
        bars.crossJoin(F.broadcast(bounds))
        .withColumns({"start_frac": start, "dur_frac": share})
        .withColumn("bar_start", first)
        .withColumn("bar_end", F.least(F.col("bar_start") + size, F.lit(width).cast("bigint")))
        .select("seq", "start_frac", "dur_frac", "bar_start", "bar_end")
    )


def timeline_layout_web(bars: DataFrame, width: int, label_width: int = 0) -> DataFrame:
    """Browser form: x and w in pixels, bars at least 2 wide, start times in whole milliseconds."""
    begin = floor_div(F.col("start_us"), 1000)
    placed = bars.withColumns({"_ms": begin, "_dur": F.col("dur_us") / F.lit(1000.0)})
    bounds = placed.agg(F.min("_ms").alias("_min"), F.max(F.col("_ms") + F.col("_dur")).alias("_max"))
    span = F.greatest(F.col("_max") - F.col("_min"), F.lit(1.0))
    return placed.crossJoin(F.broadcast(bounds)).select(
        "seq",
        (F.lit(label_width) + (F.col("_ms") - F.col("_min")) / span * width).alias("x"),
        F.greatest(F.col("_dur") / span * width, F.lit(2.0)).alias("w"),
    )


def timeline_ticks(bars: DataFrame, width: int, web: bool = False) -> DataFrame:
    """Axis ticks with their millisecond, column and label."""
    ticks = max(min(width // 80, 10), 1) if web else max(min(width // 12, 6), 2)
    share = F.col("tick") / F.lit(float(ticks))
    span = F.col("span_ms").cast("double")
    if web:
        label = format_ms(F.col("tick_ms"), ties_up=True)
        column = (share * width).alias("col")
    else:
        label = format_duration_ns((F.col("tick_ms") * 1_000_000).cast("bigint"))
        column = F.floor(share * (width - 1)).alias("col")
    return (
        timeline_bounds(bars)
        .select("span_ms", F.explode(F.sequence(F.lit(0), F.lit(ticks))).alias("tick"))
        .select("tick", (share * span).alias("tick_ms"), column)
        .withColumn("label", label)
    )


def timeline_concurrency(bars: DataFrame, bucket_us: int) -> DataFrame:
    """(bucket, until, running): statements running in each time bucket in which one starts or has just ended.

    The number holds for all buckets before `until`, the next one with a change; null on the last row, after which
    nothing runs. Each statement adds one at its first bucket and takes it off after its last: two rows per statement
    however long it runs, folded per bucket before the running sum.
    """
    first = floor_div(F.col("start_us"), bucket_us)
    after = floor_div(F.col("start_us") + F.col("dur_us"), bucket_us) + 1
    changes = F.array(
        F.struct(first.alias("bucket"), F.lit(1).alias("change")),
        F.struct(after.alias("bucket"), F.lit(-1).alias("change")),
    )
    folded = bars.select(F.inline(changes)).groupBy("bucket").agg(F.sum("change").alias("change"))
    return prefix_sum(folded, "bucket", "change", "running", following="until").select("bucket", "until", "running")


def running_at(levels: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket, running) for any asked buckets, changed or not, from the rows of `timeline_concurrency`.

    Asked buckets are put beside the levels in one order; each takes the last level at or before it. Before the first
    level and after the last statement nothing runs.
    """
    asked = buckets.select("bucket").distinct()
    marks = levels.select("bucket", F.lit(0).alias("_kind"), "running").unionByName(
        asked.select("bucket", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("running"))
    )
    # Bucket and kind as one number: a level comes before a question about its own bucket.
    numbered = marks.withColumn("_at", F.col("bucket") * 2 + F.col("_kind")).withColumn("_all", F.lit(0))
    held = running(numbered, ["_all"], "_at", {"_held": (LAST, F.col("running"))})
    return held.filter("_kind = 1").select("bucket", F.coalesce("_held", F.lit(0)).cast("bigint").alias("running"))


def timeline_peaks(levels: DataFrame, per: int) -> DataFrame:
    """(cell, peak, busy): most statements running at once, and statement-buckets, in each cell of `per` buckets.

    A level that holds over several cells counts in each of them: in its first and its last by what it covers there,
    and cells wholly inside it are listed too.
    """
    spans = levels.filter("running > 0").select("bucket", F.coalesce("until", F.col("bucket") + 1).alias("until"), "running")
    cells = F.sequence(floor_div(F.col("bucket"), per), floor_div(F.col("until") - 1, per))
    shown = spans.withColumn("cell", F.explode(cells))
    covered = F.least("until", (F.col("cell") + 1) * per) - F.greatest("bucket", F.col("cell") * per)
    return shown.groupBy("cell").agg(F.max("running").alias("peak"), F.sum(F.col("running") * covered).alias("busy"))
