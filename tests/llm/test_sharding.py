"""Sharding against a plain heap, and odd input."""

from __future__ import annotations

import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stmtflow.llm import sharding

DOCS = "doc_id bigint, text string"


def assigned(spark, rows, shards, schema=DOCS, **options):
    return [r.asDict() for r in sharding.assign(spark.createDataFrame(rows, schema), shards, **options).collect()]


def check(rows, got, shards):
    """What holds for any schedule: whole groups, gapless slots, sizes and checksums."""
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((d, t or "") for d, t in rows)
    homes = {}
    for r in got:
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 16, zlib.crc32(body), "bytes", None)
        assert homes.setdefault(body, r["shard"]) == r["shard"] and 0 <= r["shard"] < shards
    for shard in {r["shard"] for r in got}:
        inside = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == shard)
        assert [s for s, _ in inside] == list(range(len(inside))) and [d for _, d in inside] == sorted(d for _, d in inside)


def loads(got, shards):
    out = [0] * shards
    for r in got:
        out[r["shard"]] += r["size"]
    return sorted(out)


def test_large_groups_follow_the_heap(spark, monkeypatch):
    """With grains of one byte every group is scheduled by itself, so loads equal a plain heap's."""
    monkeypatch.setattr(sharding, "PIECES", 1 << 40)
    rng = random.Random(1)
    texts = ["x" * rng.randrange(1, 400) + str(i) for i in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(200)]
    got = assigned(spark, rows, 7)
    check(rows, got, 7)
    sizes = {}
    for _, t in rows:
        sizes[t] = sizes.get(t, 0) + len(t) + 16
    heap = [(0, s) for s in range(7)]
    for size in sorted(sizes.values(), reverse=True):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
    assert loads(got, 7) == sorted(load for load, _ in heap)


@pytest.mark.parametrize("pieces", [1, 8, 64])
def test_bundles_keep_shards_even(spark, monkeypatch, pieces):
    monkeypatch.setattr(sharding, "PIECES", pieces)
    rng = random.Random(pieces)
    rows = [(i, "word " * rng.randrange(0, 30) + str(rng.randrange(1500))) for i in range(2000)]
    got = assigned(spark, rows, 5)
    check(rows, got, 5)
    whole = loads(got, 5)
    assert whole[-1] - whole[0] <= 2 * max(1, sum(whole) // (5 * pieces))


def test_a_group_with_a_third_of_all_rows(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(900)]
    got = assigned(spark, rows, 4)
    check(rows, got, 4)
    assert max(loads(got, 4)) < 1.05 * sum(loads(got, 4)) / 4 + 300 * 20


def test_odd_rows(spark):
    rows = [(None, "a"), (3, None), (3, ""), (1, "é漢" * 50_000), (1, "a"), (1, "a"), (2, " ")]
    got = assigned(spark, rows, 3)
    check([(d or -1, t) for d, t in rows], [r | {"doc_id": r["doc_id"] or -1} for r in got], 3)
    assert assigned(spark, [], 3) == []
    one = assigned(spark, rows, 1)
    assert {r["shard"] for r in one} == {0} and sorted(r["slot"] for r in one) == list(range(7))


def test_clashing_columns_and_reruns(spark, tmp_path):
    rows = [(i, f"t{i % 5}", f"s{i}", i, i) for i in range(30)]
    schema = "doc_id bigint, text string, shard string, slot int, `_c0` int"
    first, again = assigned(spark, rows, 4, schema), assigned(spark, rows[::-1], 4, schema)
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert all(isinstance(r["shard"], int) and r["_c0"] == r["doc_id"] for r in first)
    sharding.write_shards(sharding.assign(spark.createDataFrame(rows, schema), 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").agg(F.max("slot") + 1, F.count("slot")).filter("`(max(slot) + 1)` <> `count(slot)`").count() == 0
    assert back.count() == 30
