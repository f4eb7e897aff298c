"""Arguments: inlining them into statement text, typing them, printing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as a number, and so stay unquoted.
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
HEX_FLOAT = r"[+-]?0[xX](?:[0-9a-fA-F_]+\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)[pP][+-]?[0-9]+"
NAMED_FLOAT = r"(?i:[+-]?inf(?:inity)?|nan)"
BROWSER_NUMBER = rf"\s*(?:{DECIMAL}|[+-]?Infinity|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)\s*"
BARE_WORDS = ("true", "false", "null", "NULL")
PG_EPOCH_US = 946_684_800_000_000


def _quoted(arg: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(arg, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_arg(arg: Column) -> Column:
    """A number or a bare word as it is, anything else as an SQL string."""
    infinite = F.abs(arg.try_cast("double")) == F.lit(float("inf"))
    decimal = arg.rlike(rf"\A{DECIMAL}\z") & ~F.coalesce(infinite, F.lit(False))
    bare = decimal | arg.rlike(rf"\A(?:{HEX_FLOAT}|{NAMED_FLOAT})\z") | arg.isin(*BARE_WORDS)
    return F.when(bare, arg).otherwise(_quoted(arg))


def quote_arg_web(arg: Column) -> Column:
    """Browser form: only numbers stay bare, a missing or empty value becomes ''."""
    return (
        F.when(F.coalesce(arg, F.lit("")) == "", F.lit("''"))
        .when(arg.rlike(rf"\A{BROWSER_NUMBER}\z"), arg)
        .otherwise(_quoted(arg))
    )


def _fill_marks(query: Column, args: Column, quote) -> Column:
    """Replace the n-th ? by the n-th argument; marks beyond the arguments stay."""
    gaps = F.split(query, r"\?")

    def piece(part: Column, i: Column) -> Column:
        mark = F.when(i <= F.size(args), quote(F.get(args, i - 1))).otherwise(F.lit("?"))
        return F.when(i == 0, part).otherwise(F.concat(mark, part))

    return F.array_join(F.transform(gaps, piece), "")


def bind_args(query: Column, args: Column) -> Column:
    """Inline arguments: $n from the highest number down, or else ? from left to right."""
    numbers = F.sequence(F.size(args), F.lit(1), F.lit(-1))

    def holder(n: Column) -> Column:
        return F.concat(F.lit("$"), n.cast("string"))

    numbered = F.exists(numbers, lambda n: F.contains(query, holder(n)))
    filled = F.aggregate(
        numbers, query, lambda text, n: F.replace(text, holder(n), quote_arg(F.get(args, n - 1)))
    )
    return (
        F.when(F.size(args) <= 0, query).when(numbered, filled).otherwise(_fill_marks(query, args, quote_arg))
    )


def bind_args_web(query: Column, args: Column) -> Column:
    """Browser form: every $n in one pass, unknown numbers stay; without any, ? from left to right."""
    gaps = F.split(query, r"\$[0-9]+")
    names = F.regexp_extract_all(query, F.lit(r"\$([0-9]+)"), F.lit(1))

    def value(name: Column) -> Column:
        number = name.try_cast("int")
        known = F.coalesce(number <= F.size(args), F.lit(False))
        arg = F.when(number >= 1, F.get(args, number - 1))
        return F.when(known, quote_arg_web(arg)).otherwise(F.concat(F.lit("$"), name))

    filled = F.array_join(
        F.transform(
            gaps,
            lambda part, i: F.when(i == 0, part).otherwise(F.concat(value(F.get(names, i - 1)), part)),
        ),
        "",
    )
    return (
        F.when(F.size(args) <= 0, query)
        .when(F.size(names) > 0, filled)
        .otherwise(_fill_marks(query, args, quote_arg_web))
    )


def typed_args(query: Column, args: Column) -> Column:
    """Arguments as (text, ts): integers whose $n is cast to a timestamp become instants."""
    cast_numbers = F.transform(
        F.regexp_extract_all(query, F.lit(r"(?i)\$([0-9]+)\s*::\s*TIMESTAMP"), F.lit(1)),
        lambda n: n.try_cast("int"),
    )

    def typed(arg: Column, i: Column) -> Column:
        whole = F.when(arg.rlike(r"\A[+-]?[0-9]+\z"), arg.try_cast("bigint"))
        instant = F.timestamp_micros(whole + F.lit(PG_EPOCH_US))
        is_cast = F.coalesce(F.array_contains(cast_numbers, (i + 1).cast("int")), F.lit(False))
        return F.struct(arg.alias("text"), F.when(is_cast, instant).alias("ts"))

    return F.transform(args, typed)


def format_args(args: Column) -> Column:
    """['a', 'b'], or nothing when there are none."""
    listed = F.array_join(F.transform(args, lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", ")
    return F.when(F.size(args) > 0, F.concat(F.lit("["), listed, F.lit("]"))).otherwise(F.lit(""))
