"""N+1 detection: the same SELECT at least `threshold` times within a sliding time window.

Statements are taken in order of (start_us, seq). A statement is flagged when the one `threshold - 1`
places before it, of the same text, started no more than a window earlier: a plain lag, so no range
frame and no count over the window is needed. Texts are cut into time buckets so that a hot text spreads
over many tasks, and of statements starting in the same microsecond only the first `threshold` count,
which bounds a bucket whatever the traffic.

In order of arrival (order="arrival", by `seq`) the detector keeps the starts of a text in a list and, with each statement,
drops starts older than a window from the head of the list only. So the head is the first start within a window of the
latest start seen so far, which lies where the running maximum of the starts first came within a window of itself: with that
maximum in place of each start, the list is a sliding window over rising times, and the same operators apply. Alerts likewise
follow the running maximum of the flagged starts: only a statement that reaches it can be a cooldown later than the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.config import DEFAULTS, DetectionConfig
from stmtflow.functions.ints import floor_div
from stmtflow.functions.text import is_table_select
from stmtflow.plans.materialize import materialize
from stmtflow.plans.ordered import MAX, running

BUCKET_WINDOWS = 4
CHAIN_COOLDOWNS = 16


def watched(log: DataFrame, key: Column) -> DataFrame:
    """The SELECTs on tables, as (key, start_us, seq)."""
    return log.filter(is_table_select(F.col("op"), F.col("query"))).select(key.alias("key"), "start_us", "seq")


START, ARRIVAL = "start", "arrival"


def _risen(rows: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """(key, start_us, seq, own_us): each start raised to the latest of its key so far by arrival; `own_us` is the start itself."""
    raised = running(rows.withColumnRenamed("start_us", "own_us"), ["key"], "seq", {"start_us": (MAX, F.col("own_us"))}, chunk_rows=chunk_rows)
    return raised.select("key", "start_us", "seq", "own_us")


def flagged_cells(selects: DataFrame, config: DetectionConfig = DEFAULTS) -> DataFrame:
    """Flagged (key, start_us) with the first flagged arrival in it; later arrivals there are flagged too."""
    threshold, window = config.nplus1_threshold, config.nplus1_window_us
    bucket = BUCKET_WINDOWS * window
    # Numbers before texts in every sort, so that few texts are compared.
    ties = Window.partitionBy("start_us", "key").orderBy("seq")
    # The rank limit also runs before the shuffle, so copies of one instant do not pile up.
    thinned = selects.withColumn("_rank", F.row_number().over(ties)).filter(F.col("_rank") <= threshold)
    # The last window of a bucket is also context for the next bucket.
    ahead = F.when(F.pmod("start_us", F.lit(bucket)) >= bucket - window, F.array(F.lit(0), F.lit(1)))
    placed = thinned.select(
        "key", "start_us", "seq", F.explode(F.coalesce(ahead, F.array(F.lit(0)))).alias("_context")
    ).withColumn("_bucket", floor_div(F.col("start_us"), bucket) + F.col("_context"))
    order = Window.partitionBy("_bucket", "key").orderBy("start_us", "seq")
    since = F.col("start_us") - window
    looked = placed.withColumns(
        {
            "_reach": F.lag("start_us", threshold - 1).over(order),
            "_reach_before": F.lag("start_us", threshold).over(order),
            "_before": F.lag("start_us", 1).over(order),
        }
    )
    flagged = F.col("_reach") >= since
    same_cell = F.coalesce(
        (F.col("_before") == F.col("start_us")) & (F.col("_reach_before") >= since), F.lit(False)
    )
    return looked.filter((F.col("_context") == 0) & flagged & ~same_cell).select(
        "key", "start_us", F.col("seq").alias("first_seq")
    )


def with_nplus1(
    log: DataFrame,
    key: Column | None = None,
    config: DetectionConfig = DEFAULTS,
    detect_on: DataFrame | None = None,
    order: str = START,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add `n_plus_1`. The key is the raw text unless given; statements are taken by start, or in order of arrival.

    `detect_on` may name an earlier, cheaper form of the same log to run the detection on.
    """
    if order not in (START, ARRIVAL):
        raise ValueError(f"unknown order: {order}")
    if config.nplus1_threshold == 0:
        return log.withColumn("n_plus_1", F.lit(False))
    key = F.col("query") if key is None else key
    selects = watched(log if detect_on is None else detect_on, key)
    if order == ARRIVAL:
        hits = _flagged_by_arrival(selects, config, chunk_rows).select("seq", F.lit(True).alias("_hit"))
        return log.join(hits, "seq", "left").select(*log.columns, F.coalesce("_hit", F.lit(False)).alias("n_plus_1"))
    cells = flagged_cells(selects, config).withColumnRenamed("start_us", "_cell_us")
    keyed = log.withColumn("_key", F.when(is_table_select(F.col("op"), F.col("query")), key))
    joined = keyed.join(
        cells, (F.col("start_us") == F.col("_cell_us")) & (F.col("_key") == F.col("key")), "left"
    )
    return joined.select(*log.columns, F.coalesce(F.col("seq") >= F.col("first_seq"), F.lit(False)).alias("n_plus_1"))


def _flagged_by_arrival(selects: DataFrame, config: DetectionConfig, chunk_rows: int | None = None) -> DataFrame:
    """(key, start_us, seq, own_us) of the statements flagged in order of arrival, `start_us` being the raised start."""
    # Both sides of the join below come from this table.
    risen = materialize(_risen(selects, chunk_rows), "arrivals")
    return risen.join(flagged_cells(risen.drop("own_us"), config), ["start_us", "key"]).filter("seq >= first_seq").drop("first_seq")


def _alerts_by_arrival(selects: DataFrame, config: DetectionConfig, chunk_rows: int | None) -> DataFrame:
    window, cooldown = config.nplus1_window_us, config.nplus1_cooldown_us
    risen = materialize(_risen(selects, chunk_rows), "arrivals")
    flagged = risen.join(flagged_cells(risen.drop("own_us"), config), ["start_us", "key"]).filter("seq >= first_seq")
    # The running maximum of the flagged starts; an alert is a statement that reaches it.
    peaks = _risen(flagged.select("key", F.col("own_us").alias("start_us"), "seq"), chunk_rows)
    reached = peaks.filter("own_us = start_us")
    if cooldown:
        cells = reached.groupBy("key", "start_us").agg(F.min("seq").alias("first_seq"))
        reached = cooldown_chain(cells, cooldown)
    counts = window_counts(risen.drop("own_us"), window).select("seq", "cnt")
    return reached.select("key", "start_us", "seq").join(counts, "seq").select("key", "start_us", "seq", "cnt")


def nplus1_alerts(
    log: DataFrame,
    key: Column | None = None,
    config: DetectionConfig = DEFAULTS,
    order: str = START,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Alerts (key, start_us, seq, cnt): the first flagged statement, then one per cooldown at most.

    `cnt` is the number of statements of the text in the window up to and including this one. By arrival, a statement that
    starts less than a cooldown after the last alert, or before it, raises none.
    """
    selects = watched(log, F.col("query") if key is None else key)
    if config.nplus1_threshold == 0:
        return selects.limit(0).withColumn("cnt", F.lit(0).cast("bigint"))
    if order == ARRIVAL:
        return _alerts_by_arrival(selects, config, chunk_rows)
    cells = flagged_cells(selects, config)
    if config.nplus1_cooldown_us == 0:
        return window_counts(selects, config.nplus1_window_us).filter(F.col("cnt") >= config.nplus1_threshold)
    if config.nplus1_cooldown_us < config.nplus1_window_us:
        # Alerts are dense: their windows overlap, so all counts are taken at once.
        chain = cooldown_chain(cells, config.nplus1_cooldown_us).select("seq")
        return window_counts(selects, config.nplus1_window_us).join(chain, "seq", "left_semi")
    return _with_counts(cooldown_chain(cells, config.nplus1_cooldown_us), selects, config)


def window_counts(selects: DataFrame, window: int) -> DataFrame:
    """(key, start_us, seq, cnt): statements of the key in the window up to and including each one.

    Statements are folded to instants first. Running sums over instants, and over the places where windows begin,
    give what lies before an instant and before its window; the difference is what the window holds. Instants are
    cut into time buckets with a halo, so the work is linear in the statements and a hot text spreads.
    """
    width = BUCKET_WINDOWS * max(window, 1)
    instants = selects.groupBy("key", "start_us").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.when(F.pmod("start_us", F.lit(width)) >= width - window, F.array(F.lit(0), F.lit(1)))
    placed = instants.select("key", "start_us", "_n", F.explode(F.coalesce(ahead, F.array(F.lit(0)))).alias("_context"))
    events = placed.select("key", "start_us", "_n", "_context", F.col("start_us").alias("_at"), F.lit(1).alias("_kind"))
    begins = instants.select(
        "key", "start_us", F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_context"), (F.col("start_us") - window).alias("_at"), F.lit(0).alias("_kind")
    )
    marked = events.unionByName(begins).withColumn("_bucket", floor_div(F.col("start_us"), width) + F.col("_context"))
    order = Window.partitionBy("_bucket", "key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = marked.withColumn("_upto", F.sum("_n").over(order)).filter(F.col("_context") == 0)
    held = sums.groupBy("_bucket", "key", "start_us").agg(
        (F.max(F.when(F.col("_kind") == 1, F.col("_upto") - F.col("_n"))) - F.max(F.when(F.col("_kind") == 0, F.col("_upto")))).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("start_us", "key").orderBy("seq"))
    ranked = selects.withColumn("_rank", rank)
    return ranked.join(held, ["start_us", "key"]).select("key", "start_us", "seq", (F.col("_before") + F.col("_rank")).alias("cnt"))


def _with_counts(alerts: DataFrame, selects: DataFrame, config: DetectionConfig) -> DataFrame:
    window = config.nplus1_window_us
    wanted = alerts.select(
        "key",
        F.col("start_us").alias("_at"),
        F.col("seq").alias("_seq"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("_back"),
    ).withColumn("_bucket", floor_div(F.col("_at"), window) - F.col("_back"))
    placed = selects.withColumn("_bucket", floor_div(F.col("start_us"), window))
    inside = (F.col("start_us") >= F.col("_at") - window) & (
        (F.col("start_us") < F.col("_at")) | ((F.col("start_us") == F.col("_at")) & (F.col("seq") <= F.col("_seq")))
    )
    return (
        placed.join(wanted, ["_bucket", "key"])
        .filter(inside)
        .groupBy("key", "_at", "_seq")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("key", F.col("_at").alias("start_us"), F.col("_seq").alias("seq"), "cnt")
    )


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(key, chunk, {column: values}) per run of equal (key, chunk) in sorted record batches."""
    held_key, held_chunk, held = None, None, None

    def closed() -> tuple:
        return held_key, held_chunk, {c: np.concatenate(held[c]) for c in columns}

    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys, chunks = batch.column("key"), batch.column("_chunk").to_numpy(zero_copy_only=False)
        values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        changed = chunks[1:] != chunks[:-1]
        changed |= pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key, chunk = keys[lo].as_py(), int(chunks[lo])
            if held is not None and (key != held_key or chunk != held_chunk):
                yield closed()
                held = None
            if held is None:
                held_key, held_chunk, held = key, chunk, {c: [] for c in columns}
            for c in columns:
                held[c].append(values[c][lo:hi])
    if held is not None:
        yield closed()


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Record batches of (key, chunk, arrays...) runs."""
    held: list[list] = [[] for _ in schema]

    def flushed() -> pa.RecordBatch:
        columns = [
            pa.array(c, type=f.type) if f.name == "key" else pa.array(np.concatenate(c), type=f.type)
            for c, f in zip(held, schema)
        ]
        for c in held:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for key, *arrays in rows:
        held[0].extend([key] * len(arrays[0]))
        for c, a in zip(held[1:], arrays):
            c.append(a)
        if len(held[0]) >= size:
            yield flushed()
    if held[0]:
        yield flushed()


def cooldown_chain(cells: DataFrame, cooldown: int) -> DataFrame:
    """The greedy chain: an alert, then the first flagged statement at least a cooldown later, and so on.

    Time is cut into chunks of several cooldowns. (1) Every chunk computes, for each instant the chain
    could be waiting for on entry, when the chain is free again on exit; chains that meet merge. (2) Those
    short tables are followed along each key, giving the true entry of each chunk. (3) Every chunk replays
    its part from that entry. Steps 1 and 3 spread a hot key over its chunks; step 2 streams tables only.
    """
    width = CHAIN_COOLDOWNS * cooldown
    chunked = cells.withColumn("_chunk", floor_div(F.col("start_us"), width))
    steps_schema = pa.schema([("key", pa.string()), ("_chunk", pa.int64()), ("upto", pa.int64()), ("free", pa.int64())])
    entries_schema = pa.schema([("key", pa.string()), ("_chunk", pa.int64()), ("entry", pa.int64())])
    alerts_schema = pa.schema([("key", pa.string()), ("start_us", pa.int64()), ("seq", pa.int64())])

    def tables(batches):
        def rows():
            for key, chunk, part in _groups(batches, ["start_us"]):
                times = part["start_us"]
                begin = chunk * width + cooldown
                starts = times[: int(np.searchsorted(times, begin)) + 1]
                at = starts.copy()
                while True:
                    later = np.searchsorted(times, at + cooldown)
                    going = later < len(times)
                    if not going.any():
                        break
                    at[going] = times[later[going]]
                free = at + cooldown
                keep = np.append(free[1:] != free[:-1], True)
                upto, free = starts[keep], free[keep]
                yield key, np.full(len(upto), chunk), upto, free

        yield from _batches(rows(), steps_schema)

    def follow(batches):
        def rows():
            current, waiting = None, None
            for key, chunk, part in _groups(batches, ["upto", "free"]):
                if key != current or waiting is None:
                    current, waiting = key, np.iinfo(np.int64).min
                i = int(np.searchsorted(part["upto"], waiting))
                if i < len(part["upto"]):
                    yield key, np.array([chunk]), np.array([waiting])
                    waiting = int(part["free"][i])

        yield from _batches(rows(), entries_schema)

    def replay(batches):
        def rows():
            for key, _chunk, part in _groups(batches, ["start_us", "first_seq", "entry"]):
                times, seqs = part["start_us"], part["first_seq"]
                found, i = [], int(np.searchsorted(times, part["entry"][0]))
                while i < len(times):
                    found.append(i)
                    i = int(np.searchsorted(times, times[i] + cooldown))
                if found:
                    yield key, times[found], seqs[found]

        yield from _batches(rows(), alerts_schema)

    steps = (
        chunked.select("key", "_chunk", "start_us")
        .repartition("key", "_chunk")
        .sortWithinPartitions("key", "_chunk", "start_us")
        .mapInArrow(tables, "key string, _chunk bigint, upto bigint, free bigint")
    )
    entries = (
        steps.repartition("key")
        .sortWithinPartitions("key", "_chunk", "upto")
        .mapInArrow(follow, "key string, _chunk bigint, entry bigint")
    )
    return (
        chunked.join(entries, ["_chunk", "key"])
        .select("key", "_chunk", "start_us", "first_seq", "entry")
        .repartition("key", "_chunk")
        .sortWithinPartitions("key", "_chunk", "start_us")
        .mapInArrow(replay, "key string, start_us bigint, seq bigint")
    )
