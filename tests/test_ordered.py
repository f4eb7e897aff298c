from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stmtflow.plans import ordered
from stmtflow.plans.ordered import CHUNK_ROWS, LAST, MAX, MIN, SUM, chunk_width, following, laid_out, prefix_sum, running, with_chunk, with_ordinal
from stmtflow.plans.quantile import stats_with_quantile


def sample(spark, n=2000, keys=3, seed=1):
    """Rows with one key holding most of them, gaps in the numbering, and nulls."""
    rng = random.Random(seed)
    order = sorted(rng.sample(range(-n, 5 * n), n))
    rows = [
        (o, "hot" if rng.random() < 0.7 else f"k{rng.randrange(keys)}", rng.randint(-5, 5) if rng.random() < 0.4 else None)
        for o in order
    ]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "o bigint, k string, v bigint")


@pytest.mark.parametrize("chunk_rows", [1, 7, 500, 1 << 20])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, chunk_rows, inclusive):
    rows, df = sample(spark)
    kinds = {"a": LAST, "b": SUM, "c": MIN, "d": MAX}
    got = running(df, ["k"], "o", {n: (k, F.col("v")) for n, k in kinds.items()}, inclusive, chunk_rows)
    seen, want = {}, {}
    for o, k, v in rows:
        past = seen.setdefault(k, [])
        if inclusive and v is not None:
            past.append(v)
        want[o] = (past[-1], sum(past), min(past), max(past)) if past else (None, 0, None, None)
        if not inclusive and v is not None:
            past.append(v)
    assert {r.o: (r.a, r.b, r.c, r.d) for r in got.collect()} == want


@pytest.mark.parametrize("chunk_rows", [1, 7, 1 << 20])
def test_following(spark, chunk_rows):
    rows, df = sample(spark)
    got = following(df, ["k"], "o", {"next_o": F.col("o"), "next_v": F.col("v")}, chunk_rows)
    want, later = {}, {}
    for o, k, v in reversed(rows):
        want[o] = later.get(k, (None, None))
        later[k] = (o, v)
    assert {r.o: (r.next_o, r.next_v) for r in got.collect()} == want


def test_ordinal_and_prefix_sum(spark):
    rows, df = sample(spark)
    numbered = with_ordinal(df, ["o"], "n", total="all").collect()
    assert {r.o: r.n for r in numbered} == {o: i + 1 for i, (o, _, _) in enumerate(rows)}
    assert {r["all"] for r in numbered} == {len(rows)}
    sums = prefix_sum(df.fillna(0, ["v"]), "o", "v", "s", following="after").collect()
    places = [o for o, _, _ in rows]
    assert {r.o: r.after for r in sums} == dict(zip(places, [*places[1:], None]))
    total, want = 0, {}
    for o, _, v in rows:
        total += v or 0
        want[o] = total
    assert {r.o: r.s for r in sums} == want


def test_ordinal_keeps_columns_of_its_own_names(spark):
    own = ["_ROW", "_part", "_place", "_start", "_amount"]
    df = spark.range(50).withColumns({c: F.concat(F.lit(c), F.col("id")) for c in own})
    got = with_ordinal(df, [F.col("id").desc()], "n", total="all")
    assert got.columns == ["id", *own, "n", "all"]
    assert sorted(got.collect()) == [(i, *[f"{c}{i}" for c in own], 50 - i, 50) for i in range(50)]


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_quantile(spark, share):
    rng = random.Random(5)
    values = {
        "one": [7],
        "two": [9, 3],
        "ties": [5] * 40 + [6] * 2,
        "wide": [int(2 ** (rng.random() * 45)) for _ in range(3000)],
        "small": [rng.randrange(3000) for _ in range(500)],
        "signed": [rng.randrange(-50, 50) for _ in range(100)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("", 1)], "k string, v bigint")
    got = stats_with_quantile(df, ["k"], "v", share, {"least": F.col("v")}, F.col("k") != "").collect()
    want = {
        k: (len(vs), sum(vs), sorted(vs)[int(float(len(vs) - 1) * share)], max(vs), min(vs)) for k, vs in values.items()
    }
    assert {r.k: (r.n, r.total, r.quantile, r.largest, r.least) for r in got} == want


def test_width_follows_density(spark):
    frame = lambda numbers: spark.createDataFrame([(n,) for n in numbers], "o bigint")
    assert chunk_width(frame(range(0, 3000, 3)), "o", 100) == 300
    assert chunk_width(frame(range(100)), "o") == CHUNK_ROWS == chunk_width(frame([]), "o")
    assert chunk_width(frame(range(0, 10**12, 10**9)), "o") is None


def sparse(spark, n=6000, seed=3):
    """Time-like numbers: gaps of 10^9 with bursts of neighbours, 70% of the rows on one key."""
    rng, at, rows = random.Random(seed), -(10**12), []
    for _ in range(n):
        at += 1 if rng.random() < 0.5 else 10**9 + rng.randrange(1000)
        rows.append((at, "hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", rng.randint(-5, 5)))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "o bigint, k string, v bigint")


def test_sparse_numbers(spark, monkeypatch):
    """Chunks by rank: bounded, few, and the same results, with no width from the caller."""
    rows, df = sparse(spark)
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 500)
    sizes = [r["count"] for r in with_chunk(df, "o").groupBy("_chunk").count().collect()]
    assert max(sizes) == 500 and len(sizes) == 12
    got = running(df, ["k"], "o", {"s": (SUM, F.col("v")), "m": (MAX, F.col("v"))})
    total, most, want = {}, {}, {}
    for o, k, v in rows:
        total[k], most[k] = total.get(k, 0) + v, max(most.get(k, v), v)
        want[o] = (total[k], most[k])
    assert {r.o: (r.s, r.m) for r in got.collect()} == want
    after = {r.o: r.n for r in following(df, ["k"], "o", {"n": F.col("o")}).collect()}
    later, wanted = {}, {}
    for o, k, _ in reversed(rows):
        wanted[o] = later.get(k)
        later[k] = o
    assert after == wanted


def test_layout_parts_are_even(spark):
    """Neither gaps nor bursts pile rows up in a partition; equal leading values are split by the next column."""
    _, df = sparse(spark)
    busy = df.withColumn("second", F.when(F.col("k") == "hot", F.lit(7)).otherwise(F.col("v") + 8)).repartition(8)
    sizes = [r["count"] for r in laid_out(busy, ["second", "o"]).groupBy("_part").count().collect()]
    assert max(sizes) <= 2 * 6000 / len(sizes) or len(sizes) == 1
