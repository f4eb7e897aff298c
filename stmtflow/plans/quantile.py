"""Exact lower discrete quantile per key, with counts, totals and maxima, from one histogram.

The rows are first folded to (key, value, count), which map-side aggregation shrinks. A running count
over coarse value buckets (at most 2,048 per power of two) finds the bucket that holds the wanted rank,
and only that bucket is opened. No window sees more than the coarse buckets of a key, or one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE_BITS = 11


def _coarse(value: Column) -> Column:
    """Bucket number rising with a bigint value: its power of two and leading bits; negatives share one."""
    shift = F.greatest(F.length(F.bin(value)) - COARSE_BITS, F.lit(0))
    lead = F.call_function("shiftright", value, shift)
    return F.when(value < 0, F.lit(-1).cast("bigint")).otherwise(shift.cast("bigint") * (1 << COARSE_BITS) + lead)


def stats_with_quantile(
    df: DataFrame,
    keys: list[str],
    value: str,
    share: float,
    extra: dict[str, Column] | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Per key: count, total, max, and the value of 0-based rank floor((count - 1) * share).

    `extra` names columns of which the least value is wanted. `keep` is a condition on the keys, tested on
    the folded rows, so that a costly key expression is not evaluated once more in a filter below.
    Output columns: keys, n, total, quantile, largest and the extras.
    """
    extra = extra or {}
    histogram = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_or(F.lit(True) if keep is None else keep).alias("_keep"),
        *[F.min(c).alias(name) for name, c in extra.items()],
    )
    histogram = histogram.filter("_keep").withColumn("_coarse", _coarse(F.col(value)))
    buckets = histogram.groupBy(*keys, "_coarse").agg(
        F.sum("_n").alias("_n"),
        F.sum(F.col("_n") * F.col(value)).alias("_total"),
        F.max(value).alias("_max"),
        *[F.min(name).alias(name) for name in extra],
    )
    whole = Window.partitionBy(*keys)
    upward = whole.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, 0)
    ranked = buckets.withColumns(
        {
            "_upto": F.sum("_n").over(upward),
            "n": F.sum("_n").over(whole),
            "total": F.sum("_total").over(whole),
            "largest": F.max("_max").over(whole),
        }
        | {name: F.min(name).over(whole) for name in extra}
    )
    rank = F.floor((F.col("n") - 1).cast("double") * F.lit(share))
    target = ranked.filter((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))).select(
        *keys, "_coarse", "n", "total", "largest", *extra, (rank - F.col("_upto") + F.col("_n")).alias("_rank")
    )
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    opened = (
        histogram.select(*keys, "_coarse", value, F.col("_n").alias("_m"))
        .join(target, [*keys, "_coarse"])
        .withColumn("_upto", F.sum("_m").over(inside))
        .filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_m")))
    )
    return opened.select(*keys, "n", "total", F.col(value).alias("quantile"), "largest", *extra)
