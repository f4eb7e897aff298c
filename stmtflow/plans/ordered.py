"""Ordered computation without putting a whole key, or the whole table, into one task.

A plain window over `conn_id` sorts a connection's whole history in one task. Here every key is cut into chunks of at
most about CHUNK_ROWS rows. Each chunk is scanned on its own, one summary row per (key, chunk) is scanned to find what
earlier chunks carry in, and the carry is joined back on (key, chunk). The result equals the plain window; the largest
group is a chunk.

Chunks follow the rows, not the numbers: if the unique order numbers are dense, a chunk is a span of them as wide as
their measured density asks for; if they are sparse or come in bursts, such as times, the rows are put in order by
range partitions, numbered, and cut by that rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.functions.ints import floor_div
from stmtflow.plans.materialize import materialize

CHUNK_ROWS = 1 << 20
#: Numbers per row up to which spans of numbers serve as chunks: a span never holds more than this many times CHUNK_ROWS.
SPARSE = 8
#: Spark's monotonic row number is the partition number above this many bits, the place in the partition below.
PLACE_BITS = 33

LAST, SUM, MIN, MAX = "last", "sum", "min", "max"


def chunk_width(df: DataFrame, order: str, rows: int = CHUNK_ROWS) -> int | None:
    """How wide, in values of a unique `order`, chunks must be to hold about `rows` rows each; None for sparse numbers."""
    n, low, high = df.agg(F.count(F.lit(1)), F.min(order), F.max(order)).first()
    if not n or low is None:
        return rows
    gap = -(-(high - low + 1) // n)
    return rows * gap if gap <= SPARSE else None


def _free(name: str, df: DataFrame) -> str:
    """A column name that is not taken."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def laid_out(
    df: DataFrame,
    order: list[str | Column],
    purpose: str = "ordered",
    store: Callable[[DataFrame, str], DataFrame] = materialize,
    part: str = "_part",
    place: str = "_place",
) -> DataFrame:
    """The rows stored by range partitions in `order`, with `part` and `place`, the partition and the place in it.

    Spark samples the order columns to deal out partitions of like size, so neither gaps nor bursts in them matter.
    Stored, because a partition's number would not outlast a second evaluation.
    """
    columns, row = [F.col(c) if isinstance(c, str) else c for c in order], _free("_row", df)
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(row, F.monotonically_increasing_id())
    stored = store(placed, purpose)
    return stored.withColumns(
        {part: F.shiftright(row, PLACE_BITS), place: F.col(row).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}
    ).drop(row)


def part_starts(laid: DataFrame, amount: Column, name: str, total: str | None = None, part: str = "_part") -> DataFrame:
    """(part, name): the sum of `amount` in all earlier partitions; one row for each partition of a stored layout."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = laid.groupBy(part).agg(amount.alias("_amount"))
    added = [] if total is None else [F.sum("_amount").over(whole).alias(total)]
    return sums.select(part, F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias(name), *added)


def with_ordinal(df: DataFrame, order: list[str | Column], name: str, total: str | None = None, first: int = 1) -> DataFrame:
    """Number all rows by `order`, without sorting them in one task; optionally add the number of rows.

    Only the sizes of the range partitions meet in one window. Rows equal in `order` are numbered in any order.
    """
    part, place, start = (_free(c, df) for c in ("_part", "_place", "_start"))
    laid = laid_out(df, order, part=part, place=place)
    starts = part_starts(laid, F.count(F.lit(1)), start, total, part)
    position = (F.col(start) + F.col(place) + first).cast("bigint").alias(name)
    added = [position] if total is None else [position, F.col(total)]
    return laid.join(F.broadcast(starts), part).select(*df.columns, *added)


def with_chunk(df: DataFrame, order: str, chunk_rows: int | None = None) -> DataFrame:
    """Add `_chunk`, which rises with the unique `order`; by measured density or rank where no width is given."""
    width = chunk_width(df, order) if chunk_rows is None else chunk_rows
    if width is not None:
        return df.withColumn("_chunk", floor_div(F.col(order), width))
    return with_ordinal(df, [order], "_rank", first=0).withColumn("_chunk", floor_div(F.col("_rank"), CHUNK_ROWS)).drop("_rank")


def _aggregate(kind: str, value: Column) -> Column:
    if kind == LAST:
        return F.last(value, ignorenulls=True)
    return {SUM: F.sum, MIN: F.min, MAX: F.max}[kind](value)


def _summary(kind: str, value: Column, order: Column) -> Column:
    if kind == LAST:
        return F.max_by(value, F.when(value.isNotNull(), order))
    return _aggregate(kind, value)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == LAST:
        return F.coalesce(local, carried)
    if kind == SUM:
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return (F.least if kind == MIN else F.greatest)(carried, local)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add running aggregates of each key in `order` (a unique bigint column).

    `values` maps a new column to (kind, expression), kind being last (non-null), sum, min or max, over
    the rows up to the current one, or strictly before it when not `inclusive`. `chunk_rows` fixes the width of a
    chunk in numbers; without it chunks follow the rows.
    """
    chunked = with_chunk(df, order, chunk_rows).withColumns({f"_v_{name}": v for name, (_, v) in values.items()})
    within = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumns(
        {f"_l_{name}": _aggregate(kind, F.col(f"_v_{name}")).over(within) for name, (kind, _) in values.items()}
    )
    carry = (
        chunked.groupBy(*keys, "_chunk")
        .agg(*[_summary(kind, F.col(f"_v_{n}"), F.col(order)).alias(f"_s_{n}") for n, (kind, _) in values.items()])
        .select(
            *keys,
            "_chunk",
            *[_aggregate(kind, F.col(f"_s_{n}")).over(earlier).alias(f"_c_{n}") for n, (kind, _) in values.items()],
        )
    )
    return local.join(carry, [*keys, "_chunk"]).select(
        *df.columns,
        *[_combine(kind, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (kind, _) in values.items()],
    )


def following(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], chunk_rows: int | None = None
) -> DataFrame:
    """Add values of the next row of each key in `order`; null on the last row of a key."""
    record = F.struct(*[v.alias(name) for name, v in values.items()])
    chunked = with_chunk(df, order, chunk_rows).withColumn("_record", record)
    within = Window.partitionBy(*keys, "_chunk").orderBy(order)
    local = chunked.withColumn("_local", F.lead("_record").over(within))
    carry = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.min_by("_record", order).alias("_first"))
        .select(*keys, "_chunk", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"))
    )
    chosen = F.coalesce(F.col("_local"), F.col("_carried"))
    return local.join(carry, [*keys, "_chunk"]).select(*df.columns, *[chosen[name].alias(name) for name in values])


def prefix_sum(df: DataFrame, position: str, value: str, name: str, following: str | None = None) -> DataFrame:
    """Running sum of `value` over rows with distinct bigint positions, range partition by range partition.

    `following` names a column for the next position, null on the last row.
    """
    laid = laid_out(df, [position])
    own = Window.partitionBy("_part").orderBy(position)
    starts = part_starts(laid, F.sum(value), "_start")
    columns = {"_sum": F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))}
    if following:
        edges = laid.groupBy("_part").agg(F.min(position).alias("_first"))
        after = edges.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))
        starts = starts.join(after, "_part")
        columns["_next"] = F.lead(position).over(own)
    added = [(F.col("_start") + F.col("_sum")).alias(name)]
    if following:
        added.append(F.coalesce("_next", "_after").alias(following))
    return laid.withColumns(columns).join(F.broadcast(starts), "_part").select(*df.columns, *added)
