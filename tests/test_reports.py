from __future__ import annotations

import json

import pytest
from helpers import statements
from pyspark.sql import functions as F

from stmtflow.operators import census, ci, export, feed, stats, timeline
from stmtflow.plans.enrich import enrich, with_slow, with_template
from stmtflow.sources.sinks import write_document

# A small warehouse day: two readings of one template around noon, a slow move, a failed correction.
NOON = 1_300_017_599_750_000  # 2011-03-13T11:59:59.750Z
READ, MOVE, FIX = "SELECT kg FROM crates WHERE lot = $1", "UPDATE crates SET bay = $1 WHERE lot = $2", "DELETE FROM crates WHERE kg < 0"
EXPORT = [
    {"query": MOVE, "op": 4, "args": ["n|4", "L1"], "start_us": NOON, "dur_us": 1_250_000},
    {"query": READ, "args": ["L1"], "start_us": NOON + 250_000, "dur_us": 8_000},
    {"query": FIX, "op": 1, "start_us": NOON + 260_000, "dur_us": 999, "error": "lock|wait"},
    {"query": READ, "args": ["L2"], "start_us": NOON + 61_000_000, "dur_us": 24_600},
]


def exported(spark):
    return with_template(statements(spark, EXPORT)).withColumn("tx_id", F.lit(None).cast("string"))


def lines(df):
    return [r.line for r in df.orderBy("section", "position").collect()]


def test_markdown(spark):
    got = lines(export.export_markdown(exported(spark)))
    assert got[2:5] == ["- Captured: 4 queries", "- Exported: 4 queries", "- Period: 11:59:59 — 12:01:00"]
    assert got[10:14] == [
        f"| 1 | 11:59:59.750 | Execute | 1.25s | {MOVE} | ['n|4', 'L1'] |  |",
        f"| 2 | 12:00:00.000 | Query | 8.0ms | {READ} | ['L1'] |  |",
        "| 3 | 12:00:00.010 | Exec | 999µs | DELETE FROM crates WHERE kg < 0 |  | lock\\|wait |",
        f"| 4 | 12:01:00.750 | Query | 24.6ms | {READ} | ['L2'] |  |",
    ]
    assert got[19:] == [
        f"| {MOVE} | 1 | 1.25s | 1.25s | 1.25s | 1.25s |",
        f"| {READ} | 2 | 16.3ms | 8.0ms | 24.6ms | 32.6ms |",
        "| DELETE FROM crates WHERE kg < ? | 1 | 999µs | 999µs | 999µs | 999µs |",
    ]


def test_markdown_filtered_and_empty(spark):
    got = lines(export.export_markdown(exported(spark), "op:select", "KG from"))
    assert "- Exported: 2 queries (filter: op:select, search: KG from)" in got
    assert not any("UPDATE" in line or "DELETE" in line for line in got)
    none = lines(export.export_markdown(exported(spark), "op:rollback"))
    assert "- Exported: 0 queries (filter: op:rollback)" in none
    assert not any("Period" in line or "Analytics" in line for line in none)
    web = lines(export.export_markdown(exported(spark), "lock|w", web=True))
    assert "- Exported: 1 queries (filter: lock\\|w)" in web
    assert any("lock\\|wait" in line for line in web)
    with pytest.raises(ValueError, match="search"):
        export.export_markdown(exported(spark), search="x", web=True)


@pytest.mark.parametrize(("filter_text", "n"), [("op:select", 2), ("", 4), ("op:rollback", 0)])
def test_json_document(spark, tmp_path, filter_text, n):
    path = str(tmp_path / "doc")
    write_document(export.export_json(exported(spark), filter_text), path)
    parts = sorted((tmp_path / "doc").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert (doc["captured"], doc["exported"], doc["filter"]) == (4, n, filter_text)
    assert len(doc["queries"]) == n
    if n:
        wanted = [r for r in EXPORT if n == 4 or r["query"] == READ]
        assert [(q["duration_ms"], q["args"], q["error"], q["tx_id"]) for q in doc["queries"]] == [
            (r["dur_us"] / 1000, r.get("args", []), r.get("error", ""), "") for r in wanted
        ]
        own = next(s for s in doc["analytics"] if s["query"] == READ)
        assert own == {"query": READ, "count": 2, "total_ms": 32.6, "avg_ms": 16.3, "p95_ms": 8.0, "max_ms": 24.6}
        assert doc["period"]["end"] == "12:01:00"
    else:
        assert doc["analytics"] == [] and doc["period"] == {"start": "", "end": ""}


def test_event_json(spark):
    events = enrich(statements(spark, [{"query": "BEGIN"}, {"query": "SELECT 'a\"b'", "args": None, "dur_us": 150_000}]))
    got = [json.loads(r.json) for r in export.event_json(events).orderBy("seq").collect()]
    assert got[0]["tx_id"] == "1-0" and "error" not in got[0] and "slow_query" not in got[0]
    assert got[1]["args"] == [] and got[1]["slow_query"] is True and got[1]["query"] == "SELECT 'a\"b'"
    assert got[1]["start_time"] == "1970-01-01T00:00:00.000001Z"


def flagged(spark, rows):
    full = [{"normalized_query": "", "n_plus_1": False, "slow_query": False} | r for r in rows]
    keys = ("normalized_query", "n_plus_1", "slow_query")
    log = statements(spark, [{k: v for k, v in r.items() if k not in keys} for r in full])
    extra = spark.createDataFrame(
        [(i, *[r[k] for k in keys]) for i, r in enumerate(full)],
        "seq bigint, normalized_query string, n_plus_1 boolean, slow_query boolean",
    )
    return log.join(extra, "seq")


CI = [
    {"query": "SELECT 1", "normalized_query": "SELECT ?"},
    *[{"query": f"q {i}", "normalized_query": "users", "n_plus_1": True} for i in range(3)],
    {"query": "p", "normalized_query": "posts", "slow_query": True, "dur_us": 200_000},
    {"query": "p", "normalized_query": "posts", "slow_query": True, "dur_us": 400_000},
]


def test_problems(spark):
    events = flagged(spark, CI)
    got = [tuple(r) for r in ci.ordered_problems(ci.ci_problems(events)).collect()]
    assert got == [("N+1", "users", 3, None), ("SLOW", "posts", 2, 300_000)]
    assert tuple(ci.ci_summary(events).first()) == (6, 2, True, 1)
    report = ci.ci_report(events).orderBy("section", "kind", F.col("n").desc(), "query").collect()
    assert [r.line for r in report][1:] == [
        "Captured: 6 queries",
        "Problems found:",
        "  [N+1]  users  (detected 3 times)",
        "  [SLOW] posts  (avg 300ms, 2 occurrences)",
        "Exit: 1 (2 problems found)",
    ]


def test_problems_of_both_kinds_raw_text_and_none(spark):
    both = flagged(spark, [{"query": "a", "n_plus_1": True, "slow_query": True, "dur_us": None}])
    assert sorted(tuple(r) for r in ci.ci_problems(both).collect()) == [("N+1", "a", 1, None), ("SLOW", "a", 1, 0)]
    fine = flagged(spark, [{"query": "a"}, {"query": "b"}])
    assert tuple(ci.ci_summary(fine).first()) == (2, 0, False, 0)
    assert [r.line for r in ci.ci_report(fine).orderBy("section").collect()][1:] == [
        "Captured: 2 queries",
        "No problems found.",
    ]
    assert tuple(ci.ci_summary(both.limit(0)).first()) == (0, 0, False, 0)


def test_statistics(spark):
    rows = [{"query": "a 1", "dur_us": d} for d in (9, 3)] + [
        {"query": "b", "dur_us": None},
        {"query": "b", "op": 9, "dur_us": 4},
        {"query": "c", "op": 2, "dur_us": 99},
        {"query": "  ", "dur_us": 99},
    ]
    log = with_template(statements(spark, rows))
    got = {r.normalized_query: tuple(r)[1:] for r in stats.template_stats(log).collect()}
    assert got == {"a ?": (2, 12, 6, 3, 9), "b": (2, 4, 2, 0, 4)}
    top = stats.top_templates(stats.template_stats(log), "p95", 1, ascending=True).collect()
    assert [r.normalized_query for r in top] == ["b"]
    web = {r.normalized_query for r in stats.template_stats_web(log, "d>5s A").collect()}
    assert web == {"a ?"}


def test_slow(spark):
    log = statements(spark, [{"dur_us": d} for d in (99_999, 100_000, None)])
    assert [r.slow_query for r in with_slow(log).orderBy("seq").collect()] == [False, True, False]


def test_status_and_feed(spark):
    events = flagged(
        spark,
        [
            {"query": "x" * 61, "n_plus_1": True, "slow_query": True},
            {"query": "y" * 60, "slow_query": True},
            {"query": "z", "error": "e", "n_plus_1": True},
            {"query": "w"},
        ],
    )
    rows = events.select("seq", feed.event_status().alias("s"), feed.bar_class().alias("b")).orderBy("seq").collect()
    assert [(r.s, r.b) for r in rows] == [("N+1", "nplus1"), ("SLOW", "slow"), ("E", "error"), ("", "normal")]
    got = [r.line for r in feed.alert_feed(events).orderBy("seq").collect()]
    assert got == ["N+1 detected: " + "x" * 57 + "...", "Slow query: " + "y" * 60, "N+1 detected: z"]
    assert feed.alert_feed(events, web=True).orderBy("seq").first().line == "N+1 detected: " + "x" * 61


def test_timeline(spark):
    rows = [
        {"start_us": 1_000_000, "dur_us": 500_000},
        {"start_us": 1_250_000, "dur_us": 0},
        {"start_us": 1_999_999, "dur_us": None},
        {"start_us": 0, "dur_us": 9_000_000, "op": 5},
    ]
    bars = timeline.drawn(statements(spark, rows))
    assert tuple(timeline.timeline_bounds(bars).first()) == (1_000_000, 1_999_999, 3, 999)
    got = [tuple(r)[3:] for r in timeline.timeline_layout(bars, 10).orderBy("seq").collect()]
    assert got == [(0, 6), (2, 3), (10, 10)]
    ticks = timeline.timeline_ticks(bars, 30).orderBy("tick").collect()
    assert [(r.col, r.label) for r in ticks] == [(0, "0µs"), (14, "499.5ms"), (29, "999.0ms")]
    assert timeline.timeline_bounds(timeline.drawn(statements(spark, rows), 1)).first().n == 1
    levels = timeline.timeline_concurrency(bars, 250_000)
    running = {r.bucket: (r.until, r.running) for r in levels.collect()}
    assert running == {4: (5, 1), 5: (6, 2), 6: (7, 1), 7: (8, 1), 8: (None, 0)}
    asked = timeline.running_at(levels, bars.sparkSession.range(2, 10).withColumnRenamed("id", "bucket"))
    assert {r.bucket: r.running for r in asked.collect()} == {2: 0, 3: 0, 4: 1, 5: 2, 6: 1, 7: 1, 8: 0, 9: 0}
    assert {r.cell: (r.peak, r.busy) for r in timeline.timeline_peaks(levels, 3).collect()} == {1: (2, 3), 2: (1, 2)}
    empty = timeline.timeline_ticks(bars.limit(0), 30).collect()
    assert len(empty) == 3


def test_census(spark):
    log = with_template(statements(spark, [{"query": "SELECT count(*), 'it''s' FROM t1 WHERE a = ? AND b = $2 + 10"}] * 2))
    got = {r.kind: r.n for r in census.sql_token_census(log).collect()}
    assert got == {"keyword": 8, "function": 2, "parameter": 4, "number": 2, "string": 2}
    plan = "Hash Join  (cost=1 Sort)\n  -> Index Only Scan on x\nExecution Time: 1 ms"
    plans = spark.createDataFrame([(plan,)], "plan string")
    counted = {(r.kind, r.name): r.n for r in census.plan_node_census(plans).collect()}
    assert counted == {
        ("node", "hash join"): 1,
        ("metrics", ""): 1,
        ("node", "index only scan"): 1,
        ("summary", "execution time"): 1,
    }


def test_one_word_of_each_class(spark):
    """Literal rows, so that a wrong word list shows."""
    log = with_template(statements(spark, [{"query": "SELECT Coalesce(kg, $1), 'x', 7 FROM crates WHERE lot ILIKE ? RETURNING crate"}]))
    got = {r.kind: r.n for r in census.sql_token_census(log).collect()}
    assert got == {"keyword": 5, "function": 1, "parameter": 2, "string": 1, "number": 1}
    plans = spark.createDataFrame([("Gather Merge  (cost=1 rows=2)\n  -> covering INDEX on x\n Query time: 3 ms",)], "plan string")
    counted = {(r.kind, r.name): r.n for r in census.plan_node_census(plans).collect()}
    assert counted == {("node", "gather merge"): 1, ("metrics", ""): 1, ("node", "covering index"): 1, ("summary", "query time"): 1}
