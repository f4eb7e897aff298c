"""Statement text: templates, kinds and squashing. All Catalyst expressions, no Python workers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.schema import BEGIN, COMMIT, ROLLBACK, is_query_op

# Every Unicode space, as a character class.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Possessive repeats run as loops in the JVM matcher, so a long literal cannot exhaust the stack.
STRING_LITERAL = r"'[^']*+(?:''[^']*+)*+'?"
STRING_LITERAL_CAPTURED = r"(')[^']*+(?:''[^']*+)*+'?"
# The byte sequences of well-formed UTF-8.
UTF8_SEQUENCE = (
    r"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}"
    r"|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)
NUMBER_EDGES = r" \t\n\r,()=<>+\-*/;"
# A digit not preceded by anything but an edge, tested digit first, and the same after the number.
NUMBER_LITERAL = rf"[0-9](?<![^{NUMBER_EDGES}][0-9])[0-9.]*+(?![^{NUMBER_EDGES}])"


def trim_space(text: Column) -> Column:
    """Trim every kind of Unicode space from both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}++|{SPACE}++\z", "")


def _starts_with_word(query: Column, word: str) -> Column:
    return query.rlike(rf"\A{SPACE}*+(?i:{word})")


def normalize_query(query: Column) -> Column:
    """Template of a statement: string literals become '?', free-standing numbers ?, spaces one space."""
    # One pass for literals: the captured quote, empty for a number, goes back around the mark.
    text = F.regexp_replace(query, f"{STRING_LITERAL_CAPTURED}|{NUMBER_LITERAL}", "$1?$1")
    # Most statements are already on one line with single spaces; a byte search tells.
    spaced = reduce(or_, [F.contains(query, F.lit(s)) for s in ("  ", "\n", "\t", "\r")])
    flat = F.regexp_replace(text, r"[ \t\n\r]{2,}+|[\t\n\r]", " ")
    return F.trim(F.when(spaced, flat).otherwise(text))


def is_select(op: Column, query: Column) -> Column:
    """A running statement whose text starts with SELECT."""
    return is_query_op(op) & _starts_with_word(query, "select")


def has_from(query: Column) -> Column:
    """The text holds FROM as a whole word."""
    return query.rlike(r"(?i)(?<![0-9A-Za-z_])FROM(?![0-9A-Za-z_])")


def is_metadata_query(op: Column, query: Column) -> Column:
    """A SELECT that reads no table."""
    return is_select(op, query) & ~has_from(query)


def is_table_select(op: Column, query: Column) -> Column:
    """A SELECT that the N+1 detector watches."""
    return is_select(op, query) & has_from(query)


def classify_op(op: Column, query: Column, driver: str = "postgres") -> Column:
    """Replace the operation code by Begin, Commit or Rollback where the text says so."""
    begins = _starts_with_word(query, "begin")
    if driver in ("mysql", "tidb"):
        begins = begins | _starts_with_word(query, "start transaction")
    elif driver != "postgres":
        raise ValueError(f"unknown driver: {driver}")
    return (
        F.when(begins, F.lit(BEGIN))
        .when(_starts_with_word(query, "commit"), F.lit(COMMIT))
        .when(_starts_with_word(query, "rollback"), F.lit(ROLLBACK))
        .otherwise(op)
    )


def squash(text: Column) -> Column:
    """One space for every run of spaces, trimmed."""
    return trim_space(F.regexp_replace(text, r"[\t\n\f\r ]++", " "))


def squash_truncate(text: Column, width: int) -> Column:
    """Squashed text of at most `width` characters, the last one an ellipsis when cut."""
    flat = squash(text)
    if width <= 1:
        return F.substring(flat, 1, max(width, 0))
    return F.when(F.length(flat) <= width, flat).otherwise(
        F.concat(F.substring(flat, 1, width - 1), F.lit("…"))
    )


def truncate_dots(text: Column, width: int) -> Column:
    """Browser form: cut to `width` characters with three dots, a dash for no text."""
    if width <= 0:
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit("-")).otherwise(F.lit(""))
    cut = F.substring(text, 1, width) if width <= 3 else F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("-"))
        .when(F.length(text) <= width, text)
        .otherwise(cut)
    )


def escape_pipes(text: Column) -> Column:
    """Escape the column separator of a Markdown table."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def sanitize_utf8(raw: Column) -> Column:
    """Text of raw bytes, every byte outside a valid sequence replaced by one U+FFFD.

    The bytes are read as Latin-1, so that a pattern over characters is one over bytes.
    """
    bytes_as_chars = F.decode(raw, "ISO-8859-1")
    marked = F.regexp_replace(bytes_as_chars, rf"\G((?:{UTF8_SEQUENCE})*+)[\x80-\xFF]", "$1\u00ef\u00bf\u00bd")
    text = raw.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.encode(marked, "ISO-8859-1").cast("string"))


def sanitize_event(events: DataFrame) -> DataFrame:
    """The same for a whole event: statement, every argument, error and template, where they are there."""
    names = [c for c in ("query", "error", "normalized_query") if c in events.columns]
    repaired = {c: sanitize_utf8(F.col(c).cast("binary")) for c in names}
    if "args" in events.columns:
        repaired["args"] = F.transform("args", lambda a: sanitize_utf8(a.cast("binary")))
    return events.withColumns(repaired)
