from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

from helpers import column
from pyspark.sql import functions as F

from stmtflow.functions import render


def plain(us):
    if us < 1000:
        return f"{us}µs"
    if us < 1_000_000:
        return f"{us / 1000:.1f}ms"
    return f"{us // 1_000_000 + (us % 1_000_000) / 1e6:.2f}s"


def test_durations_round_on_the_exact_value(spark):
    rng = random.Random(3)
    values = [0, 1, 999, 1000, 1250, 1350, 99950, 999_949, 999_950, 999_999, 1_000_000, 1_005_000, 1_125_000, 61_000_000]
    values += [rng.randrange(1000, 10**6, 50) for _ in range(3000)] + [rng.randrange(10**6, 10**9, 5000) for _ in range(3000)]
    assert column(spark, values, render.format_duration(F.col("v")), "bigint") == [plain(v) for v in values]
    assert column(spark, [None], render.format_duration(F.col("v")), "bigint") == ["-"]


def test_milliseconds(spark):
    rng = random.Random(4)
    values = [0.0005, 0.0025, 0.9999, 1.25, 1.35, 999.95, 1005.0, 1125.0, 2675.0] + [rng.random() * 5000 for _ in range(2000)]

    def shown(ms, up):
        def at(x, digits):
            exact = Decimal(x)
            if up:
                return str(exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
            return f"{x:.{digits}f}"

        if ms < 1:
            return f"{int(ms * 1000 + 0.5) if up else round(ms * 1000)}µs"
        return f"{at(ms, 1)}ms" if ms < 1000 else f"{at(ms / 1000, 2)}s"

    for up in (False, True):
        got = column(spark, values, render.format_ms(F.col("v"), up), "double")
        assert got == [shown(v, up) for v in values]


def test_duration_texts(spark):
    cases = {
        0: "0s",
        7: "7ns",
        1_500: "1.5µs",
        523_000_000: "523ms",
        1_500_000_000: "1.5s",
        62_000_000_000: "1m2s",
        3_600_000_000_000: "1h0m0s",
        3_723_004_000_000: "1h2m3.004s",
        999_999_999: "999.999999ms",
    }
    assert column(spark, list(cases), render.duration_text(F.col("v")), "bigint") == list(cases.values())


def test_times(spark):
    base = int(dt.datetime(2026, 2, 20, 15, 4, 5, tzinfo=dt.UTC).timestamp()) * 1_000_000
    values = [base, base + 123_999, base + 120_000, base + 1, -1, None]
    assert column(spark, values, render.format_time(F.col("v")), "bigint") == [
        "15:04:05.000",
        "15:04:05.123",
        "15:04:05.120",
        "15:04:05.000",
        "23:59:59.999",
        "-",
    ]
    assert column(spark, values, render.rfc3339_time(F.col("v")), "bigint")[:5] == [
        "2026-02-20T15:04:05Z",
        "2026-02-20T15:04:05.123999Z",
        "2026-02-20T15:04:05.12Z",
        "2026-02-20T15:04:05.000001Z",
        "1969-12-31T23:59:59.999999Z",
    ]
    assert column(spark, values, render.format_time_full(F.col("v")), "bigint")[0] == "15:04:05"
