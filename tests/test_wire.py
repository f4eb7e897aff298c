from __future__ import annotations

import random

import pytest
from helpers import column, messages, statements
from pyspark.sql import functions as F

from stmtflow.operators import export, wire
from stmtflow.plans.enrich import with_template


def test_tags(spark):
    tags = ["INSERT 0 5", "SELECT 3", "BEGIN", "", None]
    assert column(spark, tags, wire.rows_affected(F.col("v"))) == [5, 3, 0, 0, 0]


@pytest.mark.parametrize("chunk_rows", [2, 1 << 20])
def test_pairs(spark, chunk_rows):
    log = messages(
        spark,
        [
            (1, "DONE", {"tag": "X 9"}),
            (1, "REQ", {"query": "lost"}),
            (2, "REQ", {"query": "other"}),
            (1, "REQ", {"query": "a"}),
            (1, "RFQ", {}),
            (1, "DONE", {"tag": "INSERT 0 2"}),
            (1, "DONE", {"tag": "stray 1"}),
            (2, "ERR", {"tag": "no such table"}),
            (1, "REQ", {"query": "open"}),
        ],
    )
    rows = wire.pair_requests(log, chunk_rows).orderBy("msg").collect()
    assert [(r.query, r.dur_us, r.rows_affected, r.error) for r in rows] == [
        ("other", 50, 0, "no such table"),
        ("a", 20, 2, ""),
    ]


@pytest.mark.parametrize("chunk_rows", [2, 1 << 20])
def test_prepared(spark, chunk_rows):
    log = messages(
        spark,
        [
            (1, "EXEC", {}),
            (1, "PARSE", {"stmt": "s", "query": "first"}),
            (1, "BIND", {"stmt": "s", "args": ["1"]}),
            (1, "PARSE", {"stmt": "", "query": "unnamed"}),
            (1, "EXEC", {}),
            (1, "PARSE", {"stmt": "s", "query": "second"}),
            (1, "EXEC", {}),
            (1, "BIND", {"stmt": "", "args": []}),
            (1, "EXEC", {}),
            (1, "BIND", {"stmt": "unknown", "args": ["x"]}),
            (1, "PARSE", {"stmt": "t", "query": "last"}),
            (1, "EXEC", {}),
            (2, "BIND", {"stmt": "s"}),
            (2, "EXEC", {}),
        ],
    )
    rows = wire.resolve_prepared(log, chunk_rows=chunk_rows).orderBy("msg").collect()
    assert [(r.query, r.args) for r in rows] == [
        ("", []),
        ("first", ["1"]),
        ("second", ["1"]),
        ("second", []),
        ("last", ["x"]),
        ("", []),
    ]


def test_a_closed_name_keeps_its_text_in_postgres(spark):
    log = messages(
        spark,
        [
            (1, "PARSE", {"stmt": "q", "query": "kept"}),
            (1, "PARSE", {"stmt": "r", "query": "other"}),
            (1, "CLOSE", {"stmt": "q"}),
            (1, "BIND", {"stmt": "q", "args": ["3"]}),
            (1, "EXEC", {}),
        ],
    )
    assert [(r.query, r.args) for r in wire.resolve_prepared(log).collect()] == [("kept", ["3"])]


def test_prepared_mysql(spark):
    log = messages(
        spark,
        [
            (1, "PARSE", {"stmt": "1", "query": "a"}),
            (1, "EXEC", {"stmt": "1"}),
            (1, "CLOSE", {"stmt": "1"}),
            (1, "EXEC", {"stmt": "1"}),
            (1, "PARSE", {"stmt": "1", "query": "b"}),
            (1, "EXEC", {"stmt": "1"}),
            (1, "EXEC", {"stmt": "2"}),
        ],
    )
    rows = wire.resolve_prepared(log, "mysql").orderBy("msg").collect()
    assert [r.query for r in rows] == ["a", "", "b", ""]


TS, TSTZ = 1114, 1184


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("PARSE", "", [0]), ("DESC", "", None), ("PD", None, [TSTZ]), ("BIND", "", None)], [[TSTZ]]),
        ([("PARSE", "s1", [0]), ("DESC", "s1", None), ("PD", None, [TS]), ("BIND", "s1", None)], [[TS]]),
        (
            [
                ("PARSE", "", [0]),
                ("PARSE", "s1", [0]),
                ("DESC", "s1", None),
                ("PD", None, [TS]),
                ("BIND", "", None),
                ("BIND", "s1", None),
                ("BIND", "nameless", None),
            ],
            [[0], [TS], [0]],
        ),
        (
            [
                ("PARSE", "", [0]),
                ("DESC", "", None),
                ("RFQ", None, None),
                ("PARSE", "", [0]),
                ("DESC", "", None),
                ("PD", None, [TSTZ]),
                ("BIND", "", None),
            ],
            [[TSTZ]],
        ),
        ([("PD", None, [1]), ("PARSE", "a", [0]), ("DESC", "a", None), ("PD", None, [2]), ("BIND", "a", None)], [[2]]),
    ],
)
def test_parameter_types(spark, rows, want):
    log = messages(spark, [(1, k, {"stmt": s, "oids": o}) for k, s, o in rows])
    for chunk_rows in (2, 1 << 20):
        got = wire.resolve_param_types(log, chunk_rows).orderBy("msg").collect()
        assert [r.oids for r in got] == want


def test_descriptions_with_strays(spark):
    """Random questions, answers and cycle ends against a plain queue."""
    rng = random.Random(11)
    rows = []
    for _ in range(400):
        kind = rng.choice(["DESC", "DESC", "PD", "PD", "PD", "RFQ"])
        rows.append((rng.choice([1, 1, 1, 2]), kind, {"stmt": f"s{len(rows)}" if kind == "DESC" else None}))
    queues, want = {}, {}
    for msg, (conn, kind, extra) in enumerate(rows):
        queue = queues.setdefault(conn, [])
        if kind == "DESC":
            queue.append(extra["stmt"])
        elif kind == "RFQ":
            queue.clear()
        elif queue:
            want[msg] = queue.pop(0)
    got = wire.match_descriptions(messages(spark, rows), chunk_rows=16).collect()
    assert {r.msg: r.stmt for r in got} == want


def test_rebuilt_statements(spark):
    log = messages(
        spark,
        [
            (1, "REQ", {"query": "BEGIN"}),
            (1, "DONE", {"tag": "BEGIN"}),
            (1, "PARSE", {"stmt": "p", "query": "INSERT INTO t VALUES ($1)"}),
            (1, "BIND", {"stmt": "p", "args": ["7"]}),
            (1, "EXEC", {}),
            (1, "DONE", {"tag": "INSERT 0 1"}),
            (1, "REQ", {"query": "COMMIT"}),
            (1, "ERR", {"tag": "broken"}),
        ],
    )
    rows = wire.rebuild_statements(log).orderBy("seq").collect()
    assert [(r.op, r.query, r.args, r.rows_affected, r.error, r.tx_id) for r in rows] == [
        (5, "BEGIN", [], 0, "", "1-0"),
        (4, "INSERT INTO t VALUES ($1)", ["7"], 1, "", "1-0"),
        (6, "COMMIT", [], 0, "broken", "1-0"),
    ]


def test_sparse_message_numbers(spark):
    """Message numbers as far apart as times give the same statements as dense ones."""
    rng, rows = random.Random(11), []
    for i in range(300):
        conn = 1 if rng.random() < 0.8 else 2
        name = f"s{rng.randrange(3)}"
        rows.append(rng.choice([
            (conn, "PARSE", {"stmt": name, "query": "BEGIN" if i % 9 == 0 else f"SELECT {i}"}),
            (conn, "BIND", {"stmt": name, "args": [str(i)]}),
            (conn, "EXEC", {}),
            (conn, "REQ", {"query": rng.choice(["BEGIN", "COMMIT", f"UPDATE t SET a = {i}"])}),
            (conn, "DONE", {"tag": f"UPDATE {i}"}),
            (conn, "ERR", {"tag": "no"}),
        ]))
    dense = messages(spark, rows)
    far = dense.withColumn("msg", F.col("msg") * 1_000_000_007 + F.pmod(F.col("msg") * 7919, F.lit(1000)))
    back = lambda c: F.floor(F.col(c) / 1_000_000_007)
    shown = ["seq", "conn_id", "op", "query", "args", "start_us", "dur_us", "rows_affected", "error"]
    want = wire.rebuild_statements(dense).select(*shown, (F.col("tx_id").isNotNull()).alias("in_tx"))
    got = wire.rebuild_statements(far).withColumn("seq", back("seq")).select(*shown, (F.col("tx_id").isNotNull()).alias("in_tx"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert wire.chunk_width(far, "msg") is None


def test_sparse_arrival_numbers_in_exports(spark):
    rows = [{"seq": i * 10**9 + i % 7, "query": f"SELECT {i} FROM t"} for i in range(50)]
    log = with_template(statements(spark, rows))
    body = export.export_markdown(log).filter("section = 1").orderBy("position").collect()
    assert [r.position for r in body] == list(range(1, 51))
    assert all(f"| {i + 1} |" in r.line and f"SELECT {i} FROM" in r.line for i, r in enumerate(body))
