"""Bound parameter values: bytes to text. Integers, UUIDs and times stay in the JVM."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtflow.functions.binding import PG_EPOCH_US
from stmtflow.functions.render import rfc3339_time

# Type numbers of the two protocols.
PG_TIMESTAMP_OIDS = (1114, 1184)
MYSQL_TINY = 0x01
MYSQL_TWO_BYTES = (0x02, 0x0D)
MYSQL_FOUR_BYTES = (0x03, 0x09)
MYSQL_FLOAT = 0x04
MYSQL_DOUBLE = 0x05
MYSQL_NULL = 0x06
MYSQL_EIGHT_BYTES = 0x08
LARGE = 1e6


def _signed(hex_text: Column, size: int) -> Column:
    """Big-endian two's complement value of `size` bytes given in hex."""
    if size == 8:
        return F.conv(hex_text, 16, -10).cast("bigint")
    value = F.conv(hex_text, 16, 10).cast("bigint")
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def _reversed_bytes(raw: Column, size: int) -> Column:
    """Hex of the first `size` bytes, last byte first."""
    return F.concat(*[F.hex(F.substring(raw, i, 1)) for i in range(size, 0, -1)])


def is_binary_format(codes: Column, position: Column) -> Column:
    """Whether the parameter at a 0-based position is binary: no codes none, one code all, else its own."""
    own = F.coalesce(F.get(codes, position), F.lit(0).cast("smallint")) == 1
    return (
        F.when(codes.isNull() | (F.size(codes) == 0), F.lit(False))
        .when(F.size(codes) == 1, F.get(codes, F.lit(0)) == 1)
        .otherwise(own)
    )


def binary_format_flags(args: Column, codes: Column) -> Column:
    """One text/binary flag per argument."""
    return F.transform(args, lambda _arg, i: is_binary_format(codes, i))


def decode_pg_param(raw: Column, oid: Column) -> Column:
    """Binary PostgreSQL value as text: times by type, otherwise by length."""
    hexed = F.hex(raw)
    size = F.octet_length(raw)
    groups = [F.substring(hexed, at, length) for at, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    uuid = F.lower(F.concat_ws("-", *groups))
    is_time = oid.isin(*PG_TIMESTAMP_OIDS) & (size == 8)
    return (
        F.when(is_time, rfc3339_time(_signed(hexed, 8) + F.lit(PG_EPOCH_US)))
        .when(size == 1, _signed(hexed, 1).cast("string"))
        .when(size == 2, _signed(hexed, 2).cast("string"))
        .when(size == 4, _signed(hexed, 4).cast("string"))
        .when(size == 8, _signed(hexed, 8).cast("string"))
        .when(size == 16, uuid)
        .otherwise(raw.cast("string"))
    )


@F.pandas_udf(T.StringType())
def float_text(raw: pd.Series, double: pd.Series) -> pd.Series:
    """Shortest text of little-endian floats; exponent form below 1e-4 and from 1e6 up."""

    def text(data: bytes, is_double: bool) -> str | None:
        size, kind = (8, "<f8") if is_double else (4, "<f4")
        if data is None or len(data) < size:
            return None
        value = np.frombuffer(data[:size], dtype=kind)[0]
        if not np.isfinite(value):
            return "NaN" if np.isnan(value) else "+Inf" if value > 0 else "-Inf"
        if value == 0 or 1e-4 <= abs(value) < LARGE:
            return str(value).removesuffix(".0")
        mantissa, power = np.format_float_scientific(value, unique=True, trim="-").split("e")
        return f"{mantissa}e{power[0]}{power[1:].zfill(2)}"

    return pd.Series([text(d, bool(k)) for d, k in zip(raw, double)], dtype=object)


def decode_mysql_param(raw: Column, kind: Column) -> Column:
    """Binary MySQL value as text by type, floats excepted; a question mark when bytes are missing.

    `raw` of a text type is the value without its length prefix.
    """
    size = F.octet_length(raw)
    missing = F.lit("?")

    def whole(width: int) -> Column:
        value = _signed(_reversed_bytes(raw, width), width).cast("string")
        return F.when(size >= width, value).otherwise(missing)

    return (
        F.when(kind == MYSQL_NULL, F.lit("NULL"))
        .when(raw.isNull(), missing)
        .when(kind == MYSQL_TINY, whole(1))
        .when(kind.isin(*MYSQL_TWO_BYTES), whole(2))
        .when(kind.isin(*MYSQL_FOUR_BYTES), whole(4))
        .when(kind == MYSQL_EIGHT_BYTES, whole(8))
        .otherwise(raw.cast("string"))
    )


def decode_params(params: DataFrame) -> DataFrame:
    """Add `value` to parameters (proto pg, mysql or tidb, type_id, payload): one row out for each row in.

    A null or other protocol, and a type that is null, leave the bytes as text. The protocols are decoded in branches
    of their own, which keeps the compiled methods small enough for the JVM to optimise, and only the rows that
    hold floats go through Python.
    """
    raw, kind = F.col("payload"), F.col("type_id")
    proto = F.coalesce(F.col("proto"), F.lit(""))
    pg, mysql = proto == "pg", proto.isin("mysql", "tidb")
    is_float = F.coalesce(kind.isin(MYSQL_FLOAT, MYSQL_DOUBLE), F.lit(False))
    floats = F.coalesce(float_text(raw, kind == MYSQL_DOUBLE), F.lit("?"))
    branches = [
        (pg, decode_pg_param(raw, kind)),
        (mysql & ~is_float, decode_mysql_param(raw, kind)),
        (mysql & is_float, floats),
        (~pg & ~mysql, raw.cast("string")),
    ]
    decoded = [params.filter(wanted).withColumn("value", value) for wanted, value in branches]
    return reduce(DataFrame.unionByName, decoded)
