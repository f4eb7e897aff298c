from __future__ import annotations

import pytest
from helpers import column, statements
from pyspark.sql import functions as F

from stmtflow.functions.filters import Condition, describe_filter, parse_filter
from stmtflow.operators.listing import filter_events, match_counts


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("", []),
        ("users", [Condition("text", "users")]),
        ("d>100ms", [Condition("duration", 100_000_000)]),
        ("d<500us", [Condition("duration", 500_000, True)]),
        ("d>1.5s", [Condition("duration", 1_500_000_000)]),
        ("d>1µs", [Condition("duration", 1_000)]),
        ("D>1s", [Condition("text", "d>1s")]),
        ("Error", [Condition("error")]),
        ("op:select", [Condition("op", "select")]),
        ("op:", [Condition("text", "op:")]),
        ("N+1 nplus1 SLOW", [Condition("n+1"), Condition("n+1"), Condition("slow")]),
        ("op:select d>100ms", [Condition("op", "select"), Condition("duration", 100_000_000)]),
        ("WHERE id", [Condition("text", "where"), Condition("text", "id")]),
    ],
)
def test_parse(line, want):
    assert parse_filter(line) == want


ROWS = [
    {"query": "SELECT id FROM users", "dur_us": 150_000},
    {"query": " select 100%_x FROM posts", "dur_us": 100_000, "error": "Users missing"},
    {"query": "INSERT INTO t", "op": 4, "dur_us": None},
    {"query": "BEGIN", "op": 5, "dur_us": 5},
]


@pytest.mark.parametrize(
    ("line", "search", "web", "want"),
    [
        ("", "", False, [0, 1, 2, 3]),
        ("users", "", False, [0]),
        ("users", "", True, [0, 1]),
        ("execute", "", True, [2]),
        ("d>100ms", "", False, [0]),
        ("d<0.1s", "", False, [3]),
        ("d<100.0001ms", "", False, [1, 3]),
        ("d>0us", "", False, [0, 1, 3]),
        ("error", "", False, [1]),
        ("op:select", "", False, [0, 1]),
        ("op:begin", "", False, [3]),
        ("op:execute", "", False, [2]),
        ("op:merge", "", False, []),
        ("100%_", "", False, [1]),
        ("op:select d>100ms", "", False, [0]),
        ("op:select", "FROM U", False, [0]),
        ("", "from posts ", False, []),
    ],
)
def test_match(spark, line, search, web, want):
    log = statements(spark, ROWS).withColumns({"n_plus_1": F.lit(False), "slow_query": F.lit(False)})
    got = filter_events(log, line, search, web).orderBy("seq").collect()
    assert [r.seq for r in got] == want
    assert match_counts(log, line, search, web).first().asDict() == {"matched": len(want), "total": 4}


def test_flags(spark):
    log = statements(spark, ROWS).withColumns({"n_plus_1": F.col("seq") == 1, "slow_query": F.col("seq") <= 1})
    assert [r.seq for r in filter_events(log, "n+1").collect()] == [1]
    assert [r.seq for r in filter_events(log, "slow error").collect()] == [1]


def test_describe(spark):
    cases = {
        "op:select d>100ms": "op:select d>100ms",
        "error": "error",
        "NPLUS1": "n+1",
        "slow": "slow",
        "users": "text:users",
        " d<1500ms  Op:X d>0.5us": "d<1.5s op:x d>500ns",
        "": "",
        "op:": "text:op:",
    }
    assert column(spark, list(cases), describe_filter(F.col("v"))) == list(cases.values())


def test_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    statements(spark, ROWS).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = filter_events(spark.read.parquet(path), "error d>100ms op:execute")._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters: ")[1]
    for part in ("GreaterThan(dur_us,100000)", "EqualTo(op,4)", "EqualTo(error,)"):
        assert part in pushed
