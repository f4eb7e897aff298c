"""Times and durations as text. Rounding works on the exact binary value, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtflow.functions.ints import int_div

_ONE = 1 << 52


def fixed(value: Column, digits: int, ties_up: bool = False) -> Column:
    """A double >= 1 with `digits` decimals, rounded on its exact value.

    Doubles from 1 up are multiples of 2^-52, so the fraction is an exact integer of that unit and
    the rounding needs no floating point. Ties go to the even digit, or up.
    """
    scale = 10**digits
    whole = F.floor(value)
    units = ((value - whole) * F.lit(float(_ONE))).cast("bigint") * scale
    quotient = F.shiftright(units, 52)
    rest = units - quotient * F.lit(_ONE)
    at_tie = rest == _ONE // 2
    up = (rest > _ONE // 2) | (at_tie if ties_up else at_tie & (quotient % 2 == 1))
    rounded = quotient + up.cast("bigint")
    carried = whole + F.floor(rounded / F.lit(scale))
    return F.concat(
        carried.cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((rounded % scale).cast("string"), digits, "0"),
    )


def format_ms(ms: Column, ties_up: bool = False) -> Column:
    """Milliseconds (double) as 12µs, 3.4ms or 5.67s."""
    micros = F.floor(ms * 1000 + 0.5) if ties_up else F.rint(ms * 1000)
    return (
        F.when(ms < 1, F.concat(micros.cast("bigint").cast("string"), F.lit("µs")))
        .when(ms < 1000, F.concat(fixed(ms, 1, ties_up), F.lit("ms")))
        .otherwise(F.concat(fixed(ms / 1000, 2, ties_up), F.lit("s")))
    )


def format_duration_ns(ns: Column) -> Column:
    """Nanoseconds (bigint) as 12µs, 3.4ms or 5.67s; a dash when missing."""
    us = int_div(ns, 1000)
    seconds = int_div(ns, 1_000_000_000) + (ns % 1_000_000_000) / F.lit(1e9)
    return (
        F.when(ns.isNull(), F.lit("-"))
        .when(ns < 1_000_000, F.concat(us.cast("string"), F.lit("µs")))
        .when(ns < 1_000_000_000, F.concat(fixed(us / F.lit(1000.0), 1), F.lit("ms")))
        .otherwise(F.concat(fixed(seconds, 2), F.lit("s")))
    )


def format_duration(us: Column) -> Column:
    """Microseconds (bigint) as 12µs, 3.4ms or 5.67s; a dash when missing."""
    return format_duration_ns(us * 1000)


def _unit(count: Column, part: Column, width: int, suffix: str) -> Column:
    """count.part with trailing zeros of the part removed."""
    fraction = F.regexp_replace(F.lpad(part.cast("string"), width, "0"), "0+$", "")
    dotted = F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction))
    return F.concat(count.cast("string"), dotted, F.lit(suffix))


def duration_text(ns: Column) -> Column:
    """Nanoseconds (bigint >= 0) in hour-minute-second form: 0s, 523ms, 1.5s, 1m2s, 1h0m0s."""
    seconds = int_div(ns, 1_000_000_000)
    minutes = int_div(seconds, 60)
    hours = int_div(minutes, 60)
    in_minute = _unit(seconds % 60, ns % 1_000_000_000, 9, "s")
    return (
        F.when(ns == 0, F.lit("0s"))
        .when(ns < 1000, F.concat(ns.cast("string"), F.lit("ns")))
        .when(ns < 1_000_000, _unit(int_div(ns, 1000), ns % 1000, 3, "µs"))
        .when(ns < 1_000_000_000, _unit(int_div(ns, 1_000_000), ns % 1_000_000, 6, "ms"))
        .when(seconds < 60, in_minute)
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), in_minute))
        .otherwise(
            F.concat(hours.cast("string"), F.lit("h"), (minutes % 60).cast("string"), F.lit("m"), in_minute)
        )
    )


def format_time(us: Column) -> Column:
    """Epoch microseconds as HH:mm:ss.SSS in the session zone; a dash when missing."""
    return F.coalesce(F.date_format(F.timestamp_micros(us), "HH:mm:ss.SSS"), F.lit("-"))


def format_time_full(us: Column) -> Column:
    """Epoch microseconds as HH:mm:ss in the session zone; a dash when missing."""
    return F.coalesce(F.date_format(F.timestamp_micros(us), "HH:mm:ss"), F.lit("-"))


def rfc3339_time(us: Column) -> Column:
    """Epoch microseconds as 2026-02-20T15:04:05.123Z, fraction without trailing zeros."""
    second = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"), "0+$", "")
    dotted = F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction))
    return F.concat(second, dotted, F.lit("Z"))
