"""Stateless jobs, jobs of mergeable sums, and the runners that drive a job to files."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stmtflow.config import DEFAULTS, DetectionConfig
from stmtflow.functions.ints import floor_div, int_div
from stmtflow.operators.stats import P95, measured
from stmtflow.plans.enrich import with_slow, with_template
from stmtflow.streaming.tables import Sums

Step = Callable[[DataFrame, int], None]
AVAILABLE = {"availableNow": True}


def with_event_time(stream: DataFrame, delay: str) -> DataFrame:
    """Add `ts` from start_us and watermark it."""
    return stream.withColumn("ts", F.timestamp_micros("start_us")).withWatermark("ts", delay)


def start(stream: DataFrame, folder: str, name: str, fmt: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Start a job that appends its rows to `name` below `folder`; by default over what is there now."""
    return (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", os.path.join(folder, f"{name}-state"))
        .trigger(**(trigger or AVAILABLE))
        .start(os.path.join(folder, name))
    )


def run_available(stream: DataFrame, folder: str, name: str, fmt: str = "parquet") -> str:
    """Run a job over everything present, append its rows below `folder`, and return where."""
    start(stream, folder, name, fmt).awaitTermination()
    return os.path.join(folder, name)


def start_batches(stream: DataFrame, folder: str, name: str, step: Step, trigger: dict | None = None) -> StreamingQuery:
    """Start a job that hands each micro-batch and its number to `step`, which writes by that number."""
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", os.path.join(folder, f"{name}-state"))
        .trigger(**(trigger or AVAILABLE))
        .start()
    )


def run_batches(stream: DataFrame, folder: str, name: str, step: Step) -> None:
    """The same over everything present."""
    start_batches(stream, folder, name, step).awaitTermination()


def read_back(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """What a job has written, with the job's schema even when it wrote nothing."""
    return spark.read.schema(like.schema).parquet(out)


def stream_enrich(stream: DataFrame, config: DetectionConfig = DEFAULTS) -> DataFrame:
    """Template and slow flag."""
    return with_slow(with_template(stream), config)


class TemplateStatsJob:
    """Statistics per template, newest events included: each batch adds sums, maxima and a quantile sketch, which merge.

    The p95 comes from a KLL sketch with k = SKETCH_K: its rank is within SKETCH_ERROR of 95 % of a template's events, at 99 %
    confidence, however many batches there were.
    """

    SKETCH_K, SKETCH_ERROR = 800, 0.0035

    def __init__(self, spark: SparkSession, folder: str, every: int = 16):
        self.sums = Sums(
            spark,
            os.path.join(folder, "stats"),
            "normalized_query string, n bigint, total_us bigint, max_us bigint, sketch binary",
            {"n": F.sum, "total_us": F.sum, "max_us": F.max, "sketch": F.kll_merge_agg_bigint},
            every,
        )

    def __call__(self, batch: DataFrame, number: int) -> None:
        events = measured(with_template(batch)).filter(F.col("normalized_query") != "")
        self.sums.put(
            events.groupBy("normalized_query").agg(
                F.count(F.lit(1)).alias("n"),
                F.sum("dur_us").alias("total_us"),
                F.max("dur_us").alias("max_us"),
                F.kll_sketch_agg_bigint("dur_us", self.SKETCH_K).alias("sketch"),
            ),
            number,
        )

    def stats(self, spark: SparkSession) -> DataFrame:
        """The columns of `template_stats`, with the sketched p95."""
        return self.sums.rows(spark).select(
            "normalized_query",
            "n",
            "total_us",
            int_div(F.col("total_us"), F.col("n")).alias("avg_us"),
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(P95)).alias("p95_us"),
            "max_us",
        )


class WindowedRatesJob:
    """Statements, errors and slow statements per template in tumbling or sliding windows of the start, all of them.

    An event is counted once, in its pane, a stretch as long as the greatest common measure of width and slide. Windows
    are sums of panes, put together when they are read.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        width_us: int = 1_000_000,
        slide_us: int | None = None,
        config: DetectionConfig = DEFAULTS,
        delay_us: int = 1_000_000,
        every: int = 16,
    ):
        self.width, self.slide, self.config, self.delay = width_us, slide_us or width_us, config, delay_us
        self.pane = math.gcd(self.width, self.slide)
        self.sums = Sums(
            spark,
            os.path.join(folder, "rates"),
            "pane bigint, normalized_query string, n bigint, errors bigint, slow bigint, latest_us bigint",
            {"n": F.sum, "errors": F.sum, "slow": F.sum, "latest_us": F.max},
            every,
        )

    def counts(self, batch: DataFrame) -> DataFrame:
        """What a batch adds."""
        events = stream_enrich(batch, self.config).filter(F.col("start_us").isNotNull())
        return events.groupBy(floor_div(F.col("start_us"), self.pane).alias("pane"), "normalized_query").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("error") != "").alias("errors"),
            F.count_if("slow_query").alias("slow"),
            F.max("start_us").alias("latest_us"),
        )

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.sums.put(self.counts(batch), number)

    def rates(self, spark: SparkSession) -> DataFrame:
        """(window_us, normalized_query, n, errors, slow, closed); a window is closed when starts are a delay beyond its end.

        A closed window may still grow by what comes later than the delay; nothing is dropped.
        """
        panes = self.sums.rows(spark)
        latest = panes.agg(F.max("latest_us").alias("_latest"))
        start = F.col("pane") * self.pane
        newest = floor_div(start, self.slide)
        oldest = floor_div(start + self.pane - self.width - 1, self.slide) + 1
        covering = panes.filter(newest >= oldest).withColumn("_nth", F.explode(F.sequence(oldest, newest)))
        windows = covering.withColumn("window_us", F.col("_nth") * self.slide)
        summed = windows.groupBy("window_us", "normalized_query").agg(
            F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.sum("slow").alias("slow")
        )
        closed = F.col("window_us") + self.width <= F.col("_latest") - self.delay
        return summed.crossJoin(F.broadcast(latest)).withColumn("closed", closed).drop("_latest")
