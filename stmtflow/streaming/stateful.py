"""Jobs that follow texts and connections over time. They lose nothing and need no watermark.

Events come in order of completion, so a slow statement starts long before the ones beside it, and a late one may come
at any time. Order is (start_us, seq) for the N+1 detector and seq, the arrival, within a connection, as in batch. The
rows are kept by stretches of that order; a batch has the stretches it touches evaluated anew with the batch operators, and
reads nothing else. So results do not depend on how files are cut into batches, nor a batch's work on how many came before.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stmtflow.config import DEFAULTS, DetectionConfig
from stmtflow.functions.ints import floor_div
from stmtflow.functions.text import classify_op
from stmtflow.operators.nplus1 import BUCKET_WINDOWS, cooldown_chain, watched, window_counts
from stmtflow.operators.transactions import NONE_OPEN
from stmtflow.plans.ordered import LAST, running
from stmtflow.schema import BEGIN, COMMIT, ROLLBACK, is_lifecycle_op, is_query_op
from stmtflow.streaming.jobs import with_event_time
from stmtflow.streaming.tables import BATCH, Stretches

#: Slices of the detector, and arrival numbers of a connection, in one stretch.
PART_SLICES = 16
#: Slices of one batch that are held as a list.
FEW_SLICES = 10_000
TX_CHUNK = 1 << 16
#: The transaction of rows before the first boundary of their stretch: whichever is open when the stretch begins.
CARRIED = NONE_OPEN + 1


class NPlus1Job:
    """Flags and alerts of a stream, for `run_batches`; `flags` and `alerts` read what is known so far.

    A count never falls when more statements come, and a flag, once set, stays. So each batch only adds the counts that it
    changes, and the largest is the one that holds.
    """

    def __init__(self, spark: SparkSession, folder: str, key: Column | None = None, config: DetectionConfig = DEFAULTS):
        self.key = F.col("query") if key is None else key
        self.config = config
        self.width = BUCKET_WINDOWS * max(config.nplus1_window_us, 1)
        row = "key string, start_us bigint, seq bigint"
        self.events = Stretches(spark, os.path.join(folder, "watched"), row)
        self.results = Stretches(spark, os.path.join(folder, "flags"), f"{row}, cnt bigint, fresh boolean")

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.step(batch, number)

    def step(self, batch: DataFrame, number: int) -> DataFrame:
        """Take a batch in; the statements (key, start_us, seq, cnt) that it shows to be flagged for the first time."""
        spark = batch.sparkSession
        slice_of = floor_div(F.col("start_us"), self.width)
        part_of = floor_div(F.col("slice"), PART_SLICES).alias("part")
        rows = watched(batch, self.key).filter(F.col("start_us").isNotNull()).withColumn("slice", slice_of).persist()
        self.events.put(rows.select("key", "start_us", "seq", part_of), number)
        # A statement also counts for the first window of the next slice, and needs the last window of its own past.
        touched, seen, parts = self._around(rows.select("slice").distinct())
        known = self.events.rows(spark, parts).filter(F.col(BATCH) <= number).withColumn("slice", slice_of)
        counts = window_counts(known.join(seen, "slice", "left_semi").select("key", "start_us", "seq"), self.config.nplus1_window_us)
        own = counts.withColumn("slice", slice_of).join(touched, "slice", "left_semi")
        told = self.results.rows(spark, parts).filter(F.col(BATCH) < number).groupBy("seq").agg(F.max("cnt").alias("_told"))
        changed = own.join(told, "seq", "left").filter("_told is null or cnt > _told")
        least = self.config.nplus1_threshold
        first = F.lit(False) if not least else (F.col("cnt") >= least) & (F.coalesce("_told", F.lit(0)) < least)
        self.results.put(changed.select("key", "start_us", "seq", "cnt", first.alias("fresh"), part_of), number)
        rows.unpersist()
        found = self.results.rows(spark, parts).filter((F.col(BATCH) == number) & F.col("fresh"))
        return found.select("key", "start_us", "seq", "cnt")

    def _around(self, new: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
        """The slices whose counts may change, those to look at, and the stretches these lie in."""
        spark = new.sparkSession
        first = [r.slice for r in new.limit(FEW_SLICES + 1).collect()]
        if len(first) <= FEW_SLICES:
            near = lambda *by: sorted({s + n for s in first for n in by})
            frame = lambda slices: F.broadcast(spark.createDataFrame([(s,) for s in slices], "slice bigint"))
            return frame(near(0, 1)), frame(near(-1, 0, 1)), [s // PART_SLICES for s in near(-1, 0, 1)]
        shifted = lambda *by: new.withColumn("slice", F.explode(F.array(*[F.col("slice") + n for n in by]))).distinct()
        part = floor_div(F.col("slice"), PART_SLICES).alias("part")
        return shifted(0, 1), shifted(-1, 0, 1), [r.part for r in shifted(-1, 0, 1).select(part).distinct().collect()]

    def flags(self, spark: SparkSession) -> DataFrame:
        """Watched statements with `n_plus_1` and their count in the window."""
        merged = self.results.rows(spark).groupBy("seq").agg(
            F.any_value("key").alias("key"), F.any_value("start_us").alias("start_us"), F.max("cnt").alias("cnt")
        )
        least = self.config.nplus1_threshold
        flagged = F.col("cnt") >= least if least else F.lit(False)
        return merged.select("key", "start_us", "seq", flagged.alias("n_plus_1"), "cnt")

    def alerts(self, spark: SparkSession) -> DataFrame:
        """Alerts (key, start_us, seq, cnt): one per key and cooldown at most, all flagged ones without a cooldown.

        A late statement may move every later alert of its text, so the chain is followed when alerts are asked for, over the
        flagged instants only.
        """
        flagged = self.flags(spark).filter("n_plus_1")
        if not self.config.nplus1_cooldown_us:
            return flagged.select("key", "start_us", "seq", "cnt")
        cells = flagged.groupBy("key", "start_us").agg(F.min("seq").alias("first_seq"))
        chain = cooldown_chain(cells, self.config.nplus1_cooldown_us)
        return flagged.join(chain.select("seq"), "seq").select("key", "start_us", "seq", "cnt")


class TxJob:
    """Transactions of a stream, for `run_batches`. No time limit ends a transaction: only its connection does.

    The rows of a connection are kept in stretches of TX_CHUNK arrival numbers. A batch has the stretches of the connections
    it touches summed up anew: a piece per transaction, one for what stands before the first boundary, and the last
    boundary. The summary chains the stretches' last boundaries along each connection and adds the pieces up, so
    an event counts for its transaction also when it comes after the COMMIT, or after later stretches.
    """

    SUMS = (
        "n_queries bigint, n_not_lifecycle bigint, n_events bigint, first_seq bigint, start_us bigint, last_seq bigint,"
        " end_us bigint, closed boolean"
    )

    def __init__(self, spark: SparkSession, folder: str, driver: str = "postgres", chunk: int = TX_CHUNK):
        self.driver, self.chunk = driver, chunk
        row = "conn_id bigint, seq bigint, op int, start_us bigint, end_us bigint"
        self.events = Stretches(spark, os.path.join(folder, "events"), row)
        self.pieces = Stretches(spark, os.path.join(folder, "pieces"), f"conn_id bigint, begin bigint, {self.SUMS}")
        self.edges = Stretches(spark, os.path.join(folder, "edges"), "conn_id bigint, last bigint")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        op = classify_op(F.col("op"), F.col("query"), self.driver)
        end = F.col("start_us") + F.coalesce(F.col("dur_us"), F.lit(0))
        part = floor_div(F.col("seq"), self.chunk).alias("part")
        rows = batch.select("conn_id", "seq", op.alias("op"), "start_us", end.alias("end_us"), part).persist()
        self.events.put(rows, number)
        touched = rows.select("conn_id", "part").distinct()
        parts = [r.part for r in touched.select("part").distinct().collect()]
        known = self.events.rows(spark, parts).filter(F.col(BATCH) <= number).join(touched, ["conn_id", "part"], "left_semi")
        opens, closes = F.col("op") == BEGIN, F.col("op").isin(COMMIT, ROLLBACK)
        boundary = F.when(opens, F.col("seq")).when(closes, F.lit(NONE_OPEN))
        earlier = Window.partitionBy("conn_id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.last(boundary, ignorenulls=True).over(earlier), F.lit(CARRIED))
        labelled = known.withColumns({"begin": F.when(opens, F.col("seq")).otherwise(before), "_boundary": boundary})
        pieces = labelled.filter(F.col("begin") != NONE_OPEN).groupBy("conn_id", "part", "begin").agg(
            F.count_if(is_query_op(F.col("op"))).alias("n_queries"),
            F.count_if(~is_lifecycle_op(F.col("op"))).alias("n_not_lifecycle"),
            F.count(F.lit(1)).alias("n_events"),
            F.min("seq").alias("first_seq"),
            F.min_by("start_us", "seq").alias("start_us"),
            F.max("seq").alias("last_seq"),
            F.max_by("end_us", "seq").alias("end_us"),
            F.bool_or(closes).alias("closed"),
        )
        self.pieces.put(pieces, number)
        last = F.max_by("_boundary", F.when(F.col("_boundary").isNotNull(), F.col("seq")))
        self.edges.put(labelled.groupBy("conn_id", "part").agg(last.alias("last")), number)
        rows.unpersist()

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row per transaction, `state` closed, replaced (by the next Begin of its connection) or open."""
        # The newest evaluation of a stretch has seen all its rows.
        edges = self.edges.rows(spark).groupBy("conn_id", "part").agg(F.max_by("last", BATCH).alias("last"), F.max(BATCH).alias(BATCH))
        entered = running(edges, ["conn_id"], "part", {"_in": (LAST, F.col("last"))}, inclusive=False)
        held = self.pieces.rows(spark).join(entered.select("conn_id", "part", BATCH, "_in"), ["conn_id", "part", BATCH])
        begin = F.when(F.col("begin") == CARRIED, F.col("_in")).otherwise(F.col("begin"))
        merged = (
            held.withColumn("begin", begin)
            .filter(F.col("begin") != NONE_OPEN)
            .groupBy("conn_id", "begin")
            .agg(
                F.sum("n_queries").alias("n_queries"),
                F.sum("n_not_lifecycle").alias("n_not_lifecycle"),
                F.sum("n_events").alias("n_events"),
                F.min_by("start_us", "first_seq").alias("start_us"),
                F.max_by("end_us", "last_seq").alias("_end"),
                F.bool_or("closed").alias("_closed"),
            )
        )
        newest = edges.filter("last is not null").groupBy("conn_id").agg(F.max_by("last", "part").alias("begin"))
        state = F.when(F.col("_closed"), "closed").when(F.col("_open"), "open").otherwise("replaced")
        name = F.concat(F.col("conn_id").cast("string"), F.lit("-"), F.col("begin").cast("string"))
        return merged.join(newest.withColumn("_open", F.lit(True)), ["conn_id", "begin"], "left").select(
            name.alias("tx_id"),
            "n_queries",
            "n_not_lifecycle",
            "n_events",
            "start_us",
            (F.col("_end") - F.col("start_us")).alias("wall_us"),
            state.alias("state"),
        )


def late_event_report(stream: DataFrame, delay: str = "1 second", spread: int = 64) -> DataFrame:
    """Events older than the watermark, counted per template and spread part; sum the parts to read.

    The spread keeps a hot template from meeting in one task.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        late = total = 0
        for frame in frames:
            late += int((frame["start_us"] < mark).sum())
            total += len(frame)
        yield pd.DataFrame({"normalized_query": [keys[0]], "late": [late], "seen": [total]})

    parts = with_event_time(stream, delay).withColumn("part", F.pmod("seq", F.lit(spread)))
    return (
        parts.select("normalized_query", "part", "start_us", "ts")
        .groupBy("normalized_query", "part")
        .applyInPandasWithState(
            step,
            "normalized_query string, late bigint, seen bigint",
            "unused int",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )
