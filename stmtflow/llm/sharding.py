"""Shards of near equal bytes by longest-processing-time scheduling.

Documents with equal texts form a group and stay together. Groups go, largest first, to the shard with the least bytes so
far, which a heap of (load, shard) names.

The heap is sequential, so what passes through it is bounded whatever the input: groups of more than a grain, which is
all bytes / (shards * PIECES), pass one by one, fewer than shards * PIECES of them. Smaller groups are first bound into
bundles of about a grain: each of BUCKETS buckets, named by the leading digits of a group's hash, is put in order of size,
and a bundle ends where the running size passes a whole grain. Bundles then take part like groups, so at most
2 * shards * PIECES + BUCKETS items are scheduled in one small task. No bundle exceeds two grains, so unless single groups are
larger than a shard's share, the fullest and the emptiest shard differ by at most two grains, 2 / PIECES of a shard.

A group of more than a grain finds its shard by a broadcast of at most shards * PIECES rows, so a group of copies that holds
a third of all rows is never shuffled; all other groups are small, and meet their rows by a shuffle.

Slots number a shard's rows from 0 by id, then text. Rows are stored by range partitions of (shard, id, text), numbered
by partition, and the number of the shard's first row is taken off; no shard is sorted in one task.

A null text has no bytes and stands with the empty ones. Repeated rows are rows of their own, in slots side by side. Null
ids come first. An empty table gives an empty result. Columns of the added names in the input are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.functions.ints import int_div
from stmtflow.llm.common import Scratch
from stmtflow.plans.ordered import laid_out, part_starts

SHARDS = 40
#: Scheduled pieces per shard: the share of a shard by which shards may differ is two of these.
PIECES = 512
#: Hex digits of a group's hash that name its bucket, and the number of buckets.
DIGITS = 3
BUCKETS = 16**DIGITS
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
LAW = "bytes"
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def schedule(sizes: Iterator[int], shards: int) -> Iterator[int]:
    """The shard of each item, taken in order: the least loaded one, of several the first."""
    heap = [(0, shard) for shard in range(shards)]
    for size in sizes:
        load, shard = heap[0]
        yield shard
        heapq.heapreplace(heap, (load + size, shard))


def _scheduled(items: DataFrame, shards: int) -> DataFrame:
    """Items of (bucket, bundle, group, bytes) with their shard; one task for a number of items that parameters bound."""
    schema = items.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", shard int"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            dealt = list(schedule(iter(table.column("bytes").to_pylist()), shards))
            yield from table.append_column("shard", pa.array(dealt, pa.int32())).to_batches()

    longest_first = [F.col("bytes").desc(), F.col("bucket").asc_nulls_first(), "bundle", "group"]
    return items.repartition(1).sortWithinPartitions(*longest_first).mapInArrow(deal, schema)


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to the documents; `keep` names the columns that stay, else all."""
    scratch = Scratch(docs.sparkSession, "shards")
    names = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    sized = scratch(
        docs.select(
            *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)],
            F.col(f"`{key}`").alias("_id"),
            (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("group"),
        ),
        "sized",
    )
    grain = max(1, (sized.agg(F.sum("size")).first()[0] or 0) // (shards * PIECES))
    sums = sized.groupBy("group").agg(F.sum("size").alias("bytes"))
    bucket = F.when(F.col("bytes") <= grain, F.conv(F.substring(F.hex("group"), 1, DIGITS), 16, 10).cast("int"))
    groups = scratch(sums.withColumn("bucket", bucket), "groups")

    in_size_order = Window.partitionBy("bucket").orderBy(F.col("bytes").desc(), "group")
    before = F.coalesce(F.sum("bytes").over(in_size_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bundle = int_div(before, F.lit(grain).cast("bigint"))
    small = scratch(groups.filter("bucket is not null").withColumn("bundle", bundle), "small")
    bundles = small.groupBy("bucket", "bundle").agg(F.sum("bytes").alias("bytes"))
    items = groups.filter("bucket is null").select("bucket", F.lit(None).cast("bigint").alias("bundle"), "group", "bytes").unionByName(
        bundles.select("bucket", "bundle", F.lit(None).cast("binary").alias("group"), "bytes")
    )
    dealt = scratch(_scheduled(items, shards), "dealt")

    # Both maps are bounded by shards * PIECES and BUCKETS.
    of_large = F.broadcast(dealt.filter("bucket is null").select("group", "shard"))
    of_bundle = F.broadcast(dealt.filter("bucket is not null").select("bucket", "bundle", "shard"))
    of_small = small.join(of_bundle, ["bucket", "bundle"]).select("group", "shard")
    located = sized.join(of_large, "group").unionByName(sized.join(of_large, "group", "left_anti").join(of_small, "group"))
    laid = laid_out(located, ["shard", "_id", "group"], "laid", scratch)
    starts = part_starts(laid, F.count(F.lit(1)), "_start")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = laid.groupBy("shard").count().select("shard", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_first"))
    numbered = laid.join(F.broadcast(starts), "_part").join(F.broadcast(firsts), "shard")
    return scratch.finish(
        numbered.select(
            *[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)],
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("_start") + F.col("_place") - F.col("_first")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard, rows in slot order; a large shard is written by several tasks."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
