"""Integer division on bigint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(value: Column, by: Column | int) -> Column:
    """Integer division, truncating."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def floor_div(value: Column, by: int) -> Column:
    """Integer division rounding down, so that negative times fall into whole buckets too."""
    return int_div(value - F.pmod(value, F.lit(by)), by)
