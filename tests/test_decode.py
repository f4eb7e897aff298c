from __future__ import annotations

import datetime as dt
import struct
import uuid

from pyspark.sql import functions as F

from stmtflow.functions import decode


def run(spark, cases, proto):
    rows = [(i, proto, b, t) for i, (b, t, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, proto string, payload binary, type_id int")
    return [r.value for r in decode.decode_params(df).orderBy("i").collect()]


def test_postgres_values(spark):
    epoch = dt.datetime(2000, 1, 1, tzinfo=dt.UTC)
    instant = epoch + dt.timedelta(days=4004, microseconds=86_399_000_501)
    micros = (instant - epoch) // dt.timedelta(microseconds=1)
    some = uuid.UUID("12345678-9abc-def0-1234-56789abcdef0")
    cases = [
        (struct.pack(">q", micros), 1114, instant.strftime("%Y-%m-%dT%H:%M:%S.%fZ")),
        (struct.pack(">q", 0), 1184, "2000-01-01T00:00:00Z"),
        (struct.pack(">q", -1), 1184, "1999-12-31T23:59:59.999999Z"),
        (struct.pack(">q", micros), 0, str(micros)),
        (struct.pack(">q", -(2**63)), 0, str(-(2**63))),
        (b"\x00\x00\x00\x2a", 0, "42"),
        (struct.pack(">i", -42), 0, "-42"),
        (struct.pack(">h", -2), 0, "-2"),
        (b"\x80", 0, "-128"),
        (some.bytes, 0, str(some)),
        (b"plain text", 0, "plain text"),
        (b"", 0, ""),
    ]
    assert run(spark, cases, "pg") == [w for _, _, w in cases]


def test_mysql_values(spark):
    cases = [
        (b"\xff", 1, "-1"),
        (struct.pack("<h", -300), 2, "-300"),
        (struct.pack("<h", 2026), 0x0D, "2026"),
        (struct.pack("<i", -70000), 3, "-70000"),
        (struct.pack("<i", 5), 9, "5"),
        (struct.pack("<q", -(2**40)), 8, str(-(2**40))),
        (struct.pack("<f", 3.14), 4, "3.14"),
        (struct.pack("<d", 0.1), 5, "0.1"),
        (struct.pack("<d", 1e6), 5, "1e+06"),
        (struct.pack("<d", 123456.0), 5, "123456"),
        (struct.pack("<d", -1.5e-7), 5, "-1.5e-07"),
        (struct.pack("<d", 0.0001), 5, "0.0001"),
        (struct.pack("<d", 2.0), 5, "2"),
        (struct.pack("<d", 0.0), 5, "0"),
        (struct.pack("<d", float("inf")), 5, "+Inf"),
        (b"\x01\x02", 3, "?"),
        (b"\x01\x02", 5, "?"),
        (None, 6, "NULL"),
        (None, 253, "?"),
        (b"text", 253, "text"),
    ]
    assert run(spark, cases, "mysql") == [w for _, _, w in cases]


def test_format_codes(spark):
    df = spark.createDataFrame(
        [(0, ["a", "b", "c"], []), (1, ["a", "b", "c"], [1]), (2, ["a", "b", "c"], [0, 1]), (3, ["a"], None)],
        "i int, a array<string>, c array<smallint>",
    )
    got = [r[0] for r in df.orderBy("i").select(decode.binary_format_flags(F.col("a"), F.col("c"))).collect()]
    assert got == [[False] * 3, [True] * 3, [False, True, False], [False]]
