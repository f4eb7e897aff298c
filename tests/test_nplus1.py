from __future__ import annotations

import random

import pytest
from helpers import replay_arrival, replay_nplus1, statements
from pyspark.sql import functions as F

from stmtflow.config import DetectionConfig
from stmtflow.operators.nplus1 import nplus1_alerts, with_nplus1

Q = "SELECT id, name FROM users WHERE id = $1"
P = "SELECT id, title FROM posts WHERE user_id = $1"
S, MS = 1_000_000, 1_000

TRACES = [
    ("below", 5, S, 10 * S, [(Q, i * 100 * MS) for i in range(4)], [], 0),
    ("at", 5, S, 10 * S, [(Q, i * 100 * MS) for i in range(5)], [4], 1),
    ("after", 5, S, 10 * S, [(Q, i * 100 * MS) for i in range(10)], [4, 5, 6, 7, 8, 9], 1),
    ("expiry", 5, S, 10 * S, [(Q, t) for t in (0, 1e5, 2e5, 2e6, 2.1e6, 2.2e6)], [], 0),
    ("cooldown", 5, 2 * S, S, [(Q, i * 100 * MS) for i in range(5)] + [(Q, 1500 * MS)], [4, 5], 2),
    (
        "two",
        3,
        S,
        10 * S,
        [(q, i * 100 * MS) for i, q in enumerate([Q, P, Q, P, Q, P])],
        [4, 5],
        2,
    ),
    ("edge", 2, S, 10 * S, [(Q, 0), (Q, S), (Q, 2 * S + 1)], [1], 1),
    ("no table", 1, S, S, [("SELECT 1", 0), ("", 1), ("UPDATE t SET a = 1", 2)], [], 0),
]


@pytest.mark.parametrize(("name", "threshold", "window", "cooldown", "rows", "flags", "alerts"), TRACES)
def test_traces(spark, name, threshold, window, cooldown, rows, flags, alerts):
    config = DetectionConfig(threshold, window, cooldown)
    log = statements(spark, [{"query": q, "start_us": int(t)} for q, t in rows])
    assert [r.seq for r in with_nplus1(log, config=config).filter("n_plus_1").orderBy("seq").collect()] == flags
    assert nplus1_alerts(log, config=config).count() == alerts


@pytest.mark.parametrize(
    ("threshold", "window", "cooldown"), [(5, 50, 200), (1, 10, 30), (2, 7, 1), (3, 40, 0), (8, 300, 20), (4, 20, 5000)]
)
def test_random_traffic(spark, threshold, window, cooldown):
    """A hot text with many ties and rare ones, against one-by-one replay."""
    rng = random.Random(threshold * 1000 + window)
    rows = []
    t = -500
    for seq in range(2500):
        t += rng.choice([0, 0, 0, 1, 2, 5, 5, 40] if seq % 400 < 300 else [60, 200])
        rows.append((rng.choice([Q] * 8 + [P, "SELECT a FROM b"]), t, seq))
    rng.shuffle(rows)
    config = DetectionConfig(threshold, window, cooldown)
    log = statements(spark, [{"query": q, "start_us": t, "seq": s} for q, t, s in rows])
    flags, alerts = replay_nplus1(rows, threshold, window, cooldown)
    assert {r.seq: r.n_plus_1 for r in with_nplus1(log, config=config).collect()} == flags
    got = sorted((r.key, r.start_us, r.seq, r.cnt) for r in nplus1_alerts(log, config=config).collect())
    assert got == alerts


def test_one_instant(spark):
    """All copies at one instant: everything from the threshold on is flagged, one alert."""
    log = statements(spark, [{"query": Q, "start_us": 5}] * 300)
    assert [r.seq for r in with_nplus1(log).filter("not n_plus_1").orderBy("seq").collect()] == [0, 1, 2, 3]
    assert [(r.seq, r.cnt) for r in nplus1_alerts(log).collect()] == [(4, 5)]


def test_template_key_and_off(spark):
    log = statements(spark, [{"query": f"SELECT a FROM t WHERE id = {i}"} for i in range(6)])
    keyed = log.withColumn("template", F.lit("x"))
    assert with_nplus1(log).filter("n_plus_1").count() == 0
    assert with_nplus1(keyed, F.col("template")).filter("n_plus_1").count() == 2
    off = DetectionConfig(nplus1_threshold=0)
    assert with_nplus1(keyed, F.col("template"), off).filter("n_plus_1").count() == 0
    assert nplus1_alerts(keyed, F.col("template"), off).count() == 0


def test_other_operations_of_the_same_text_stay_unflagged(spark):
    rows = [{"query": Q, "start_us": i // 2, "op": 2 if i % 2 else 0} for i in range(20)]
    flagged = with_nplus1(statements(spark, rows)).filter("n_plus_1").collect()
    assert {r.op for r in flagged} == {0} and len(flagged) == 6


def test_a_hot_text_spreads_over_tasks(spark):
    """No window partition of a hot text holds more than its bucket."""
    plan = with_nplus1(statements(spark, [{"query": Q}]))._jdf.queryExecution().toString()
    assert "_bucket" in plan and "WindowGroupLimit" in plan


def test_bad_settings():
    with pytest.raises(ValueError, match="negative"):
        DetectionConfig(slow_us=-1)
    with pytest.raises(ValueError, match="window"):
        DetectionConfig(nplus1_window_us=0)


@pytest.mark.parametrize("chunk_rows", [50, None])
@pytest.mark.parametrize(("threshold", "window", "cooldown"), [(5, 50, 200), (2, 7, 1), (3, 40, 0), (4, 20, 5000), (1, 30, 15)])
def test_order_of_arrival(spark, threshold, window, cooldown, chunk_rows):
    """Statements that arrive after later ones, some of them very late; a hot text crosses chunks."""
    rng = random.Random(threshold * 100 + window)
    rows, t = [], 0
    for seq in range(1500):
        t += rng.choice([0, 0, 1, 2, 5, 20] if seq % 300 < 200 else [60, 90])
        late = rng.choice([0] * 6 + [3, 10, window, 3 * window, 4 * cooldown])
        rows.append((rng.choice([Q] * 8 + [P]), t - late, seq))
    config = DetectionConfig(threshold, window, cooldown)
    log = statements(spark, [{"query": q, "start_us": t, "seq": s} for q, t, s in rows]).repartition(3)
    flags, alerts = replay_arrival(rows, threshold, window, cooldown)
    marked = with_nplus1(log, config=config, order="arrival", chunk_rows=chunk_rows)
    assert marked.columns == [*log.columns, "n_plus_1"]
    assert {r.seq: r.n_plus_1 for r in marked.collect()} == flags
    got = nplus1_alerts(log, config=config, order="arrival", chunk_rows=chunk_rows)
    assert sorted((r.key, r.start_us, r.seq, r.cnt) for r in got.collect()) == alerts


def test_orders_agree_on_rising_starts(spark):
    rows = [{"query": Q, "start_us": i * 100 * MS} for i in range(12)]
    log = statements(spark, rows)
    assert with_nplus1(log, order="arrival").filter("n_plus_1").count() == with_nplus1(log).filter("n_plus_1").count() == 8
    with pytest.raises(ValueError):
        with_nplus1(log, order="sideways")
