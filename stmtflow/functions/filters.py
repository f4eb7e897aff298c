"""The filter language of the viewers: a few words, compiled once into one Column.

All tokens must hold. `d>100ms` and `d<10ms` compare the duration, `error`, `n+1` and `slow` test the
flags, `op:` tests the operation or the leading keyword, anything else is searched for in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtflow.functions.render import duration_text
from stmtflow.functions.text import SPACE, trim_space
from stmtflow.schema import OP_CODES, op_name

# The words and units of the language.
SQL_KEYWORDS = ("select", "insert", "update", "delete")
NPLUS1_WORDS = ("n+1", "nplus1")
UNIT_NS = {"us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000}
MOST_NS = (1 << 63) - 1
DURATION = r"d([><])([0-9]+(?:\.[0-9]+)?)(us|µs|ms|s|m)"


@dataclass(frozen=True)
class Condition:
    """One parsed token; `value` is the text, the op pattern, or the duration in ns."""

    kind: str
    value: str | int = ""
    less: bool = False


def parse_filter(text: str) -> list[Condition]:
    """Tokens of a filter line, in order."""
    return [_parse_token(token) for token in text.split()]


def _parse_token(token: str) -> Condition:
    duration = re.fullmatch(DURATION, token)
    if duration:
        sign, number, unit = duration.groups()
        ns = _nanoseconds(number, UNIT_NS[unit])
        if ns <= MOST_NS:
            return Condition("duration", ns, sign == "<")
    word = token.lower()
    if word in ("error", "slow"):
        return Condition(word)
    if word in NPLUS1_WORDS:
        return Condition("n+1")
    if word.startswith("op:") and len(word) > 3:
        return Condition("op", word[3:])
    return Condition("text", word)


def _nanoseconds(number: str, scale: int) -> int:
    """Whole nanoseconds of a decimal number of units, whatever its length."""
    whole, _, part = number.partition(".")
    return int(whole) * scale + int(part or 0) * scale // 10 ** len(part)


def _duration(dur_us: Column, cond: Condition) -> Column:
    # Whole microseconds against a limit in ns: round so that a bare column meets a literal.
    ns = int(cond.value)
    test = dur_us < -(-ns // 1000) if cond.less else dur_us > ns // 1000
    return test & dur_us.isNotNull()


def _op(op: Column, query: Column, pattern: str) -> Column:
    if pattern in OP_CODES:
        return op == OP_CODES[pattern]
    if pattern in SQL_KEYWORDS:
        return query.rlike(rf"\A{SPACE}*+(?i:{pattern})")
    return F.lit(False)


def _holds(text: Column, word: str) -> Column:
    return F.contains(F.lower(text), F.lit(word))


def compile_filter(text: str, web: bool = False) -> Column:
    """The condition of a filter line; `web` also searches the operation name and the error."""

    def compiled(cond: Condition) -> Column:
        if cond.kind == "duration":
            return _duration(F.col("dur_us"), cond)
        if cond.kind == "error":
            return F.col("error") != ""
        if cond.kind == "n+1":
            return F.col("n_plus_1")
        if cond.kind == "slow":
            return F.col("slow_query")
        if cond.kind == "op":
            return _op(F.col("op"), F.col("query"), str(cond.value))
        word = str(cond.value)
        found = _holds(F.col("query"), word)
        if web:
            found = found | _holds(op_name(F.col("op")), word) | _holds(F.col("error"), word)
        return found

    return reduce(lambda a, b: a & b, map(compiled, parse_filter(text)), F.lit(True))


def compile_template_filter(text: str) -> Column:
    """Only the text tokens of a filter line, searched for in the template."""
    words = [str(c.value) for c in parse_filter(text) if c.kind == "text"]
    return reduce(lambda a, b: a & b, [_holds(F.col("normalized_query"), w) for w in words], F.lit(True))


def compile_search(text: str) -> Column:
    """The whole search text, spaces kept, found in the statement in any case."""
    return _holds(F.col("query"), text.lower()) if text else F.lit(True)


def describe_filter(text: Column) -> Column:
    """Canonical form of filter lines held in a column."""
    tokens = F.filter(F.split(trim_space(text), rf"{SPACE}+"), lambda t: t != "")

    def described(token: Column) -> Column:
        word = F.lower(token)
        sign, number, unit = (F.regexp_extract(token, rf"\A{DURATION}\z", i) for i in (1, 2, 3))
        scale = F.lit(None).cast("decimal(11,0)")
        for name, ns in UNIT_NS.items():
            scale = F.when(unit == name, F.lit(ns).cast("decimal(11,0)")).otherwise(scale)
        # Units and their parts apart, so that no length of the number is cut; too long a duration is a text.
        whole = F.regexp_replace(F.regexp_extract(number, r"\A([0-9]+)", 1), r"\A0+(?=.)", "").try_cast("decimal(20,0)")
        part = F.rpad(F.substring(F.regexp_extract(number, r"\.([0-9]+)", 1), 1, 18), 18, "0").cast("decimal(18,0)")
        unit_part = part * scale
        billionth = F.lit(Decimal(10**18)).cast("decimal(19,0)")
        ns = whole * scale + ((unit_part - unit_part % billionth) / billionth).cast("decimal(20,0)")
        fits = F.coalesce(ns <= F.lit(Decimal(MOST_NS)).cast("decimal(20,0)"), F.lit(False))
        return (
            F.when((sign != "") & fits, F.concat(F.lit("d"), sign, duration_text(ns.try_cast("bigint"))))
            .when(word.isin("error", "slow"), word)
            .when(word.isin(*NPLUS1_WORDS), F.lit("n+1"))
            .when(word.startswith("op:") & (F.length(word) > 3), word)
            .otherwise(F.concat(F.lit("text:"), word))
        )

    return F.when(F.size(tokens) == 0, text).otherwise(F.array_join(F.transform(tokens, described), " "))
