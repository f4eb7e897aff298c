from __future__ import annotations

import random

import pytest
from helpers import statements
from pyspark.sql import functions as F

from stmtflow.operators import transactions as tx


def test_labels(spark):
    texts = ["SELECT 1", "BEGIN", "a", "BEGIN", "b", "COMMIT", "c", "ROLLBACK TO s", "BEGIN", "rollback to s", "d"]
    log = statements(spark, [{"query": q} for q in texts])
    rows = tx.assign_tx(log).orderBy("seq").collect()
    assert [r.tx_id for r in rows] == [None, "1-1", "1-1", "1-3", "1-3", "1-3", None, None, "1-8", "1-8", None]
    assert [r.op for r in rows] == [0, 5, 0, 5, 0, 6, 0, 7, 5, 7, 0]


def test_start_transaction_by_driver(spark):
    log = statements(spark, [{"query": "start transaction"}, {"query": "x"}])
    assert [r.tx_id for r in tx.assign_tx(log).collect()] == [None, None]
    assert [r.tx_id for r in tx.assign_tx(log, "tidb").collect()] == ["1-0", "1-0"]


@pytest.mark.parametrize("chunk_rows", [3, 100, 1 << 20])
def test_random_sessions(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    rows = [
        {"conn_id": rng.choice([1] * 6 + [2, 3]), "query": rng.choice(["BEGIN", "COMMIT", "ROLLBACK", "x", "y", "z"])}
        for _ in range(1500)
    ]
    got = {r.seq: r.tx_id for r in tx.assign_tx(statements(spark, rows), chunk_rows=chunk_rows).collect()}
    open_, want = {}, {}
    for seq, row in enumerate(rows):
        conn, text = row["conn_id"], row["query"]
        if text == "BEGIN":
            open_[conn] = f"{conn}-{seq}"
        want[seq] = open_.get(conn)
        if text in ("COMMIT", "ROLLBACK"):
            open_.pop(conn, None)
    assert got == want


ROWS = [
    {"query": "BEGIN", "start_us": 0, "dur_us": 10},
    {"query": "SELECT 1", "start_us": 100, "dur_us": 50, "conn_id": 2},
    {"query": "SELECT  a", "start_us": 1000, "dur_us": 2000},
    {"query": "PREPARE", "op": 2, "start_us": 2000, "dur_us": None},
    {"query": "odd", "op": 9, "start_us": 2500, "dur_us": 1},
    {"query": "COMMIT", "start_us": 5000, "dur_us": None},
]


def test_summary_listing_and_detail(spark):
    events = tx.assign_tx(statements(spark, ROWS))
    summary = tx.tx_summary(events).first()
    assert (summary.n_queries, summary.n_not_lifecycle, summary.n_events) == (1, 2, 5)
    assert (summary.start_us, summary.wall_us) == (0, 5000)
    order = ["anchor", "kind", "seq"]
    listed = [(r.kind, r.seq) for r in tx.tx_listing(events).orderBy(order).collect()]
    assert listed == [(0, 0), (1, 0), (1, 2), (1, 3), (1, 4), (1, 5), (1, 1)]
    folded = tx.tx_listing(events, events.filter("seq = 0").select("tx_id"))
    assert [(r.kind, r.seq) for r in folded.orderBy(order).collect()] == [(0, 0), (1, 1)]
    lines = [r.line for r in tx.tx_detail(events).orderBy("tx_id", "section", "seq").collect()]
    assert lines == [
        "Type:     Transaction",
        "Queries:  1 query",
        "Duration: 5.0ms",
        "Time:     00:00:00",
        "Tx:       1-0",
        "  Begin    BEGIN 10µs",
        "  Query    SELECT a 2.0ms",
        "  Prepare  PREPARE -",
        "  UnknownO odd 1µs",
        "  Commit   COMMIT -",
    ]
    preview = tx.tx_detail(events, preview=True).filter("section = 5").collect()
    assert [r.line for r in preview] == ["  Query    SELECT a"]


def test_flat_and_event_detail(spark):
    events = tx.assign_tx(statements(spark, ROWS))
    assert [r.seq for r in tx.flat_by_duration(events, 3).collect()] == [2, 1, 0]
    wanted = spark.createDataFrame([(3,), (3,), (77,)], "seq bigint")
    rows = tx.event_detail(events, wanted).collect()
    assert len(rows) == 1
    assert (rows[0].op, rows[0].duration, rows[0].args, rows[0].error) == ("Prepare", "-", None, None)
    assert events.filter(F.col("tx_id").isNull()).count() == 1
