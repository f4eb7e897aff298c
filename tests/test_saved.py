from __future__ import annotations

import random

import pyarrow as pa
import pytest
from helpers import statements
from pyspark.sql import functions as F

from stmtflow.functions.filters import parse_filter
from stmtflow.operators import listing, saved, search

LINES = [
    "", "  ", "error", "SLOW", "n+1 slow", "op:select", "op:SELECT users", "op:nothing", "op:begin", "op:", "users", "s", "se le", "rs whe",
    "d>10ms", "d<10ms", "d>1us d<20ms users", "d>5ms d>9ms", "d<0us", "ORDERS d>99999h", "Ünï", "error op:execute d>1ms id",
]


def log(spark, n=400):
    rng = random.Random(2)
    texts = ["SELECT id FROM users WHERE id = 1", " update Orders set a = 1", "BEGIN", "", "delete from ünï where ÜNÏ", "  SELECT s"]
    rows = [
        {
            "query": rng.choice(texts),
            "op": rng.choice([0, 4, 5]),
            "error": rng.choice(["", "", "no"]),
            "dur_us": rng.choice([None, 0, 1, 5_000, 9_001, 10_000, 10_001, 20_000]),
        }
        for _ in range(n)
    ]
    return statements(spark, rows).withColumns({"n_plus_1": F.col("seq") % 3 == 0, "slow_query": F.col("seq") % 2 == 0})


@pytest.mark.parametrize("block", [5, 20_000])
def test_each_filter_as_if_alone(spark, monkeypatch, block):
    monkeypatch.setattr(saved, "BLOCK", block)
    events = log(spark).persist()
    lines = spark.createDataFrame([(x,) for x in [*LINES, "error", None]], "filter string")
    got = {r.canonical: r for r in saved.saved_filter_matches(events, lines).collect()}
    shown = spark.createDataFrame([(x,) for x in LINES], "filter string").select("filter", listing.describe_filter(F.col("filter")).alias("c"))
    wanted = listing.match_counts
    for r in shown.collect():
        if block == 5 and len(r.filter) % 3:
            continue
        matched, total = wanted(events, r.filter).first()
        assert (got[r.c].matched, got[r.c].total) == (matched, total), r.filter
    assert got["error"].saved == 2 and len(got) == len({r.c for r in shown.collect()})
    events.unpersist()


def test_no_filters_and_no_events(spark):
    none = spark.createDataFrame([], "filter string")
    assert saved.saved_filter_matches(log(spark, 5), none).count() == 0
    some = spark.createDataFrame([("users",), ("",)], "filter string")
    got = saved.saved_filter_matches(log(spark, 5).limit(0), some).collect()
    assert {(r.canonical, r.matched, r.total) for r in got} == {("text:users", 0, 0), ("", 0, 0)}


def test_searches_equal_scans(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cÄ%_") for _ in range(rng.randrange(0, 30))) for _ in range(80)] + [None, "", "aaaaaa", "a" * 5000 + "b"]
    words = {"", "a", "AB", "äc", "aaa", "zzz", "ab c", "%_", "_%a", "a" * 400 + "b", "b" * 7, " "}
    words |= {t[i : i + rng.randrange(1, 9)] for t in texts[:60] for i in (0, 3)}
    events = statements(spark, [{"query": t} for t in texts for _ in range(1 + len(t or "") % 3)])
    index = search.build_index(events)
    asked = spark.createDataFrame([(w,) for w in [*words, *words, None]], "search string")
    held = [t.lower() for t in texts if t is not None for _ in range(1 + len(t) % 3)]
    got = {r.search: (r.texts, r.matched) for r in search.search_index(index, asked).collect()}
    assert got == {w: (len({t for t in held if w.lower() in t}), sum(w.lower() in t for t in held)) for w in words}


@pytest.mark.parametrize(("sent", "bits"), [(1 << 30, 12), (0, 2)])
def test_searches_in_shards(spark, monkeypatch, sent, bits):
    """Shards of few texts, wanted grams by shuffle: as scans would have it. Joins of postings and texts are no broadcasts, whatever
    their size on disk: only the wanted grams and a one-row table are sent to all."""
    monkeypatch.setattr(search, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(search, "SHARD_BITS", bits)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randrange(0, 25))) for _ in range(200)]
    words = {t[i : i + rng.randrange(1, 12)].upper() for t in texts for i in (0, 5)} | {"abca", "zzzz", "a" * 9, "abz"}
    index = search.build_index(statements(spark, [{"query": t} for t in texts]).repartition(3))
    found = search.search_index(index, spark.createDataFrame([(w,) for w in words], "search string"))
    got = {r.search: (r.texts, r.matched) for r in found.collect()}
    assert got == {w: (len({t for t in texts if w.lower() in t}), sum(w.lower() in t for t in texts)) for w in words}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastExchange") == (2 if sent else 1)


def test_events_and_lines_are_read_once(spark, monkeypatch):
    """However many blocks the filters make, the log and the table of lines pass once."""
    monkeypatch.setattr(saved, "BLOCK", 5)
    passed = {name: spark.sparkContext.accumulator(0) for name in ("events", "lines")}

    def counted(df, name):
        def run(batches):
            for batch in batches:
                passed[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    lines = spark.createDataFrame([(x,) for x in LINES], "filter string")
    got = saved.saved_filter_matches(counted(log(spark), "events"), counted(lines, "lines")).collect()
    assert {r.total for r in got} == {400} and sum(r.saved for r in got) == len(LINES)
    assert {name: n.value for name, n in passed.items()} == {"events": 400, "lines": len(LINES)}


@pytest.mark.parametrize(("classes", "held"), [(1, 1 << 20), (10**6, 1 << 20), (10**6, 8)])
def test_kinds_of_classes(monkeypatch, classes, held):
    """Counts by kind and range of durations equal those of each filter on each class, wherever a task stops to count."""
    monkeypatch.setattr(saved, "CLASSES", classes)
    monkeypatch.setattr(saved, "HELD_BYTES", held)
    rng = random.Random(3)
    words, flags = ["users", "use", "e", "rs w", "ünï", "zz"], ["error", "slow", "n+1", "op:select", "op:update", "op:execute", "op:none"]
    lines = ["", "d>3us d<2us", "d<1us", "d>0us"]
    for _ in range(300):
        own = rng.sample(words, rng.randrange(3)) + rng.sample(flags, rng.randrange(3)) + [f"d{rng.choice('<>')}{rng.randrange(12)}us" for _ in range(rng.randrange(3))]
        lines.append(" ".join(w.replace(" ", "") for w in own))
    rows = [
        {
            "text": rng.choice([None, "", "select users where", "update e", "ünï users", "insert rsw"]),
            "keyword": rng.choice([None, "", "select", "update", "insert"]),
            "op": rng.choice([None, 0, 4, 9]),
            "error": rng.random() < 0.3,
            "n+1": rng.random() < 0.3,
            "slow": rng.random() < 0.3,
            "dur_us": rng.choice([None, *range(13), 1 << 62]),
            "n": rng.randrange(1, 5),
        }
        for _ in range(600)
    ]
    schema = pa.schema([("text", "string"), ("keyword", "string"), ("op", "int32"), *[(f, pa.bool_()) for f in saved.FLAGS], ("dur_us", "int64"), ("n", "int64")])
    kinds = saved.Kinds(saved.compiled(lines, lines))
    for lo in range(0, 600, 200):
        kinds.add(pa.RecordBatch.from_pylist(rows[lo : lo + 200], schema))
    kinds.count()

    def holds(cond, r):
        if cond.kind == "duration":
            return r["dur_us"] is not None and (r["dur_us"] * 1000 < cond.value if cond.less else r["dur_us"] * 1000 > cond.value)
        if cond.kind == "op":
            return r["op"] == 4 if cond.value == "execute" else r["keyword"] == cond.value and cond.value in ("select", "update")
        return cond.value in (r["text"] or "") if cond.kind == "text" else r[cond.kind]

    want = [sum(r["n"] for r in rows if all(holds(c, r) for c in parse_filter(line))) for line in lines]
    assert kinds.total.tolist() == want
