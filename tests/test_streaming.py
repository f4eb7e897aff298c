from __future__ import annotations

import random
import time
from types import SimpleNamespace

import pytest
from helpers import replay_nplus1, statements
from pyspark.sql import functions as F

from stmtflow.config import DetectionConfig
from stmtflow.operators.transactions import assign_tx, tx_summary
from stmtflow.session import work_dir
from stmtflow.sources.log import read_event_feed, read_statement_log, stream_statement_log
from stmtflow.sources.sinks import write_enriched, write_event_feed
from stmtflow.operators import ci
from stmtflow.operators.feed import alert_feed
from stmtflow.plans.enrich import enrich
from stmtflow.streaming import combined, jobs, stateful, tables

Q = "SELECT id FROM users WHERE id = $1"


def files(spark, rows, tmp_path, slices):
    """Rows as files written one after the other, and a stream over them."""
    folder = str(tmp_path / "in")
    size = -(-len(rows) // slices)
    for i in range(0, len(rows), size):
        part = [{"seq": i + j} | r for j, r in enumerate(rows[i : i + size])]
        statements(spark, part).coalesce(1).write.mode("append").parquet(folder)
    return stream_statement_log(spark, folder, files_per_trigger=1)


def result(spark, job, tmp_path, name="job"):
    return jobs.read_back(spark, jobs.run_available(job, str(tmp_path / "out"), name), job)


def traffic(seed: int, n: int = 500):
    """Statements of two texts, some of which take up to half a minute, in order of completion."""
    rng = random.Random(seed)
    t, rows = 1_000_000_000, []
    for i in range(n):
        t += rng.choice([0, 0, 10, 40_000, 300_000]) if i % 150 else 5_000_000
        slow = rng.choice([100_000] * 6 + [2_000_000, 30_000_000])
        rows.append({"query": rng.choice([Q] * 4 + ["SELECT a FROM b"]), "start_us": t, "dur_us": slow})
    return sorted(rows, key=lambda r: r["start_us"] + r["dur_us"])


@pytest.mark.parametrize(("slices", "cooldown"), [(1, 2_000_000), (4, 2_000_000), (6, 100_000), (4, 0)])
def test_nplus1_equals_replay(spark, tmp_path, slices, cooldown):
    rows = traffic(3)
    config = DetectionConfig(4, 500_000, cooldown)
    job = combined.nplus1_job(spark, files(spark, rows, tmp_path, slices), str(tmp_path / "out"), config)
    flags, alerts = replay_nplus1([(r["query"], r["start_us"], i) for i, r in enumerate(rows)], 4, 500_000, cooldown)
    assert {r.seq: r.n_plus_1 for r in job.flags(spark).collect()} == flags
    assert sorted((r.key, r.start_us, r.seq, r.cnt) for r in job.alerts(spark).collect()) == alerts


def test_nplus1_switched_off(spark, tmp_path):
    rows = traffic(4, 40)
    job = combined.nplus1_job(spark, files(spark, rows, tmp_path, 2), str(tmp_path / "out"), DetectionConfig(nplus1_threshold=0))
    assert {r.n_plus_1 for r in job.flags(spark).collect()} == {False} and job.flags(spark).count() == 40
    assert job.alerts(spark).count() == 0


@pytest.mark.parametrize("slices", [1, 4])
def test_feed_and_gate_after_each_batch(spark, tmp_path, slices):
    """Whatever the cut, feed and gate end where the batch operators do; each batch's verdict is that of all so far."""
    rows = [{"seq": i} | r for i, r in enumerate(traffic(6, 160))]
    config = DetectionConfig(4, 500_000, 2_000_000, 150_000)
    feed, gate = (job(spark, str(tmp_path / job.__name__), config) for job in (combined.FeedJob, combined.GateJob))
    size = -(-len(rows) // slices)
    for number, i in enumerate(range(0, len(rows), size)):
        batch = statements(spark, rows[i : i + size])
        feed(batch, number)
        gate(batch, number)
        so_far = enrich(statements(spark, rows[: i + size]), config)
        assert tuple(gate.verdicts.of(spark, number).first()) == tuple(ci.ci_summary(so_far).first())
        if number < 2:
            assert feed.lines(spark, number).count() > 0
    whole = enrich(statements(spark, rows), config)
    assert sorted(map(tuple, gate.problems(spark).collect()), key=str) == sorted(map(tuple, ci.ci_problems(whole).collect()), key=str)
    assert sorted(map(tuple, feed.feed(spark).collect())) == sorted(map(tuple, alert_feed(whole).select("seq", "line").collect()))


def test_a_batch_reads_only_what_it_touches(spark, tmp_path, monkeypatch):
    """The files a batch reads do not grow with the batches before it."""
    read = []
    plain = tables.Stretches.rows

    def counted(self, spark, parts=None):
        found = plain(self, spark, parts)
        read.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(tables.Stretches, "rows", counted)
    job = stateful.NPlus1Job(spark, str(tmp_path / "out"))
    spent = []
    for number in range(8):
        begin = 10**9 + number * job.width * stateful.PART_SLICES
        rows = [{"seq": number * 40 + i, "query": Q, "start_us": begin + i * 100_000} for i in range(40)]
        read.clear()
        job(statements(spark, rows), number)
        spent.append(sum(read))
    assert max(spent[2:]) <= spent[2] + 1
    monkeypatch.undo()
    assert job.flags(spark).count() == 320


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    rows = [{"seq": i} | r for i, r in enumerate(traffic(5, 60))]
    job, stats = stateful.NPlus1Job(spark, str(tmp_path / "a")), jobs.TemplateStatsJob(spark, str(tmp_path / "b"))
    tx = stateful.TxJob(spark, str(tmp_path / "c"))
    first, second = statements(spark, rows[:30]), statements(spark, rows[30:])
    for step in (job, stats, tx):
        for batch, number in ((first, 0), (first, 0), (second, 1), (second, 1)):
            step(batch, number)
    assert job.flags(spark).count() == 60 and stats.stats(spark).agg(F.sum("n")).first()[0] == 60


@pytest.mark.parametrize("slices", [1, 4, 6])
def test_transactions_equal_batch(spark, tmp_path, slices):
    rng = random.Random(9)
    rows = [
        {
            "query": rng.choice(["BEGIN", "COMMIT", "ROLLBACK", "a", "b", "c"]),
            "conn_id": rng.choice([1, 1, 1, 1, 2, 3]),
            "start_us": 1_000_000 + i * 1000,
            "dur_us": rng.choice([5, 50, None]),
        }
        for i in range(400)
    ]
    job = stateful.TxJob(spark, str(tmp_path / "out"))
    jobs.run_batches(files(spark, rows, tmp_path, slices), str(tmp_path / "out"), "tx", job)
    got = job.summary(spark).collect()
    batch = assign_tx(statements(spark, rows))
    want = tx_summary(batch)
    order = sorted(want.columns)
    assert sorted(tuple(r[c] for c in order) for r in got) == sorted(map(tuple, want.select(order).collect()))
    ended = {r.tx_id for r in batch.filter(F.col("op").isin(6, 7) & F.col("tx_id").isNotNull()).collect()}
    assert {r.tx_id for r in got if r.state == "closed"} == ended
    last = {}
    for i, r in enumerate(rows):
        if r["query"] in ("BEGIN", "COMMIT", "ROLLBACK"):
            last[r["conn_id"]] = f"{r['conn_id']}-{i}" if r["query"] == "BEGIN" else None
    assert {r.tx_id for r in got if r.state == "open"} == {v for v in last.values() if v}
    assert any(r.state == "replaced" for r in got)


@pytest.mark.parametrize("slices", [1, 7])
def test_transactions_in_any_order(spark, tmp_path, slices):
    """Events of one connection come in any order, also long after the COMMIT; stretches of 8 numbers."""
    rng = random.Random(slices)
    rows = [
        {
            "seq": i,
            "query": rng.choice(["BEGIN", "COMMIT", "a", "b", "c", "d"]),
            "conn_id": rng.choice([1, 1, 1, 2]),
            "start_us": 1_000_000 + i * 1000,
            "dur_us": rng.choice([5, 50, None]),
        }
        for i in range(120)
    ]
    want = tx_summary(assign_tx(statements(spark, rows)))
    mixed = rows[:]
    rng.shuffle(mixed)
    job = stateful.TxJob(spark, str(tmp_path / "out"), chunk=8)
    size = -(-len(mixed) // slices)
    for number, i in enumerate(range(0, len(mixed), size)):
        job(statements(spark, mixed[i : i + size]), number)
    order = sorted(want.columns)
    got = job.summary(spark)
    assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    last = {}
    for r in rows:
        if r["query"] in ("BEGIN", "COMMIT"):
            last[r["conn_id"]] = f"{r['conn_id']}-{r['seq']}" if r["query"] == "BEGIN" else None
    assert {r.tx_id for r in got.filter("state = 'open'").collect()} == {v for v in last.values() if v}


def test_a_long_transaction_keeps_all_statements(spark, tmp_path):
    rows = [{"query": "BEGIN", "start_us": 0}]
    rows += [{"query": "a", "start_us": t * 10**6} for t in range(10, 150, 10)]
    rows += [{"query": "COMMIT", "start_us": 150 * 10**6, "dur_us": 7}, {"query": "x", "conn_id": 2, "start_us": 400 * 10**6}]
    job = stateful.TxJob(spark, str(tmp_path / "out"))
    jobs.run_batches(files(spark, rows, tmp_path, 6), str(tmp_path / "out"), "tx", job)
    assert [(r.tx_id, r.n_queries, r.n_events, r.wall_us, r.state) for r in job.summary(spark).collect()] == [("1-0", 14, 16, 150_000_007, "closed")]


def test_late_events_are_counted(spark, tmp_path):
    rows = [{"query": "a", "start_us": t * 10**6} for t in (10, 100, 101, 5, 102, 6)]
    stream = jobs.stream_enrich(files(spark, rows, tmp_path, 6))
    got = result(spark, stateful.late_event_report(stream), tmp_path).agg(F.sum("late"), F.sum("seen")).first()
    assert tuple(got) == (2, 6)


@pytest.mark.parametrize(
    ("slices", "width", "slide"), [(1, 1_000_000, 200_000), (7, 1_000_000, 1_000_000), (3, 500_000, 200_000), (3, 200_000, 500_000)]
)
def test_windows_are_sums_of_panes(spark, tmp_path, slices, width, slide):
    rows = [{"query": "a", "start_us": int(t * 10**6)} for t in (10, 10.5, 20, 20.2, 30, 10.7, 40)]
    job = jobs.WindowedRatesJob(spark, str(tmp_path / "out"), width, slide, every=2)
    jobs.run_batches(files(spark, rows, tmp_path, slices), str(tmp_path / "out"), "rates", job)
    want = {}
    for t in (r["start_us"] for r in rows):
        for start in range((t - width) // slide * slide, t + 1, slide):
            if start <= t < start + width:
                want[start] = want.get(start, 0) + 1
    got = {r.window_us: r for r in job.rates(spark).collect()}
    assert {w: r.n for w, r in got.items()} == want
    assert all(r.closed == (w + width <= 39 * 10**6) for w, r in got.items())
    plan = job.counts(statements(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan


def test_live_statistics(spark, tmp_path):
    """Averages and p95 over many small batches and several folds; the p95 is held against the ranks of all rows."""
    rng = random.Random(8)
    rows = [{"query": rng.choice([Q, "SELECT a FROM b"]), "dur_us": int(rng.expovariate(1e-4)), "start_us": i} for i in range(3000)]
    job = jobs.TemplateStatsJob(spark, str(tmp_path / "out"), every=2)
    jobs.run_batches(files(spark, rows, tmp_path, 7), str(tmp_path / "out"), "stats", job)
    for r in job.stats(spark).collect():
        own = sorted(x["dur_us"] for x in rows if x["query"].lower()[:9] == r.normalized_query.lower()[:9])
        assert (r.n, r.total_us, r.avg_us, r.max_us) == (len(own), sum(own), sum(own) // len(own), own[-1])
        low, high = sum(d < r.p95_us for d in own), sum(d <= r.p95_us for d in own)
        assert low <= (0.95 + 0.0105) * len(own) + 1 and high >= (0.95 - 0.0105) * len(own) - 1
    left = [p.name for p in (tmp_path / "out" / "stats").iterdir()]
    assert len(left) <= 2 * 2 + 2


def test_folds_survive_a_batch_that_runs_again(spark, tmp_path):
    sums = tables.Sums(spark, str(tmp_path / "sums"), "k string, n bigint, top bigint", {"n": F.sum, "top": F.max}, every=3)
    total = 0
    for number in range(11):
        part = spark.createDataFrame([("a", number, number), ("b", 1, -number)], "k string, n bigint, top bigint")
        for _ in range(2 if number % 2 else 1):
            sums.put(part, number)
        total += number
        assert {r.k: (r.n, r.top) for r in sums.rows(spark).collect()} == {"a": (total, number), "b": (number + 1, 0)}


def test_fanout_loses_nothing(spark, tmp_path):
    rows = [{"query": "a", "start_us": i, "error": "e" if i % 3 else ""} for i in range(90)]
    stream = files(spark, rows, tmp_path, 3)
    out = str(tmp_path / "out")
    queries = combined.fanout_sinks(spark, stream, out, {"all": F.lit(True), "bad": F.col("error") != ""})
    assert all(q.exception() is None for q in queries.values())
    assert {n: spark.read.parquet(f"{out}/{n}").count() for n in queries} == {"all": 90, "bad": 60}


def test_live_fanout_with_a_slow_subscriber(spark, tmp_path):
    rows = [{"query": "a", "start_us": i} for i in range(30)]
    stream = files(spark, rows, tmp_path, 3)
    out, slowly = str(tmp_path / "out"), F.udf(lambda seq: time.sleep(0.05) is None, "boolean")("seq")
    (tmp_path / "out" / "hub").mkdir(parents=True)
    queries = combined.fanout_sinks(spark, stream, out, {"all": F.lit(True), "slow": slowly}, trigger={"processingTime": "1 second"})
    try:
        for _ in range(60):
            got = {n: spark.read.schema("seq bigint").parquet(f"{out}/{n}").count() if (tmp_path / "out" / n).exists() else 0 for n in ("all", "slow")}
            if got == {"all": 30, "slow": 30}:
                break
            time.sleep(0.5)
        assert got == {"all": 30, "slow": 30} and all(q.isActive for q in queries.values())
    finally:
        for q in queries.values():
            q.stop()


def test_broken_json_lines(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"seq": 1, "query": "a", "args": ["x"]}\n{"seq": 2, "qu\n')
    rows = read_statement_log(spark, str(path), "json").orderBy("seq").collect()
    assert [(r.seq, r._corrupt_record) for r in rows] == [(None, '{"seq": 2, "qu'), (1, None)]
    with pytest.raises(ValueError, match="format"):
        read_statement_log(spark, str(path), "csv")


def test_written_log_and_feed(spark, tmp_path):
    from stmtflow.plans.enrich import enrich

    rows = [{"query": "BEGIN"}, {"query": Q, "args": ["1"], "dur_us": 1234, "op": 9}, {"query": "COMMIT", "error": "x"}]
    events = enrich(statements(spark, rows))
    write_enriched(events.withColumn("day", F.lit("d")), str(tmp_path / "log"), ["day"])
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    write_event_feed(events, str(tmp_path / "feed"))
    got = read_event_feed(spark, str(tmp_path / "feed")).orderBy("id").collect()
    assert [(r.op, r.dur_us, r.args, r.error, r.tx_id) for r in got] == [
        (5, 0, [], "", "1-0"),
        (9, 1234, ["1"], "", "1-0"),
        (6, 0, [], "x", "1-0"),
    ]


def test_work_dir_follows_the_session(spark, tmp_path):
    assert work_dir(spark, "a") != work_dir(spark, "a")
    named = SimpleNamespace(conf={"spark.checkpoint.dir": str(tmp_path)})
    assert work_dir(named, "a").startswith(str(tmp_path))
    for master in ("yarn", "local-cluster[2,1,1024]"):
        cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_dir(cluster, "a")


def test_backlog_is_taken_in_bounded_batches(spark, tmp_path):
    rows = [{"query": "a", "start_us": i} for i in range(40)]
    files(spark, rows, tmp_path, 4)
    stream = stream_statement_log(spark, str(tmp_path / "in"), bytes_per_trigger="1")
    assert result(spark, stream, tmp_path).count() == 40
    assert len(list((tmp_path / "out" / "job-state" / "commits").glob("[0-9]*"))) == 4
