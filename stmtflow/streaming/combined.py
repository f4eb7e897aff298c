"""Jobs made of several streams: fan-out, the live alert feed, the CI gate."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stmtflow.config import DEFAULTS, DetectionConfig
from stmtflow.functions.text import normalize_query
from stmtflow.operators import ci
from stmtflow.operators.feed import alert_feed
from stmtflow.sources.log import BYTES_PER_TRIGGER
from stmtflow.streaming.jobs import run_batches, start, stream_enrich
from stmtflow.streaming.stateful import NPlus1Job
from stmtflow.streaming.tables import Parts, Sums


def fanout_sinks(
    spark: SparkSession, stream: DataFrame, folder: str, subscribers: dict[str, Column], trigger: dict | None = None
) -> dict[str, StreamingQuery]:
    """Serve one stream to many subscribers, each with its own condition and progress, losing nothing.

    The stream is enriched once into a hub folder, which every subscriber follows side by side at its own pace, in
    batches of bounded size. Without a trigger the hub runs over what is there and then all subscribers do; the
    queries returned write to folders of their names.
    """
    enriched = stream_enrich(stream)
    hub = start(enriched, folder, "hub", trigger=trigger)
    if trigger is None:
        hub.awaitTermination()
    followed = (
        spark.readStream.schema(enriched.schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(f"{folder}/hub")
    )
    queries = {name: start(followed.filter(wanted), folder, name, trigger=trigger) for name, wanted in subscribers.items()}
    if trigger is None:
        for query in queries.values():
            query.awaitTermination()
        return queries
    return {"hub": hub, **queries}


def nplus1_job(
    spark: SparkSession, stream: DataFrame, folder: str, config: DetectionConfig = DEFAULTS, key: Column | None = None
) -> NPlus1Job:
    """Run the detector over everything present."""
    job = NPlus1Job(spark, folder, key, config)
    run_batches(stream, folder, "nplus1", job)
    return job


class FeedJob:
    """The live alert feed: each micro-batch writes its lines when it has been taken in.

    A statement that turns out to be repeated gets an N+1 line in the batch that shows it, also if an earlier batch had it
    as slow; the N+1 line is then the one that holds.
    """

    def __init__(self, spark: SparkSession, folder: str, config: DetectionConfig = DEFAULTS):
        self.config, self.detector = config, NPlus1Job(spark, folder, config=config)
        self.parts = Parts(spark, os.path.join(folder, "lines"), "seq bigint, repeated boolean, line string")

    def __call__(self, batch: DataFrame, number: int) -> None:
        hits = self.detector.step(batch, number)
        shown = hits.select("seq", F.col("key").alias("query"), F.lit(True).alias("n_plus_1"), F.lit(False).alias("slow_query"))
        repeated = alert_feed(shown).withColumn("repeated", F.lit(True))
        slow = stream_slow_feed(batch, self.config).join(hits.select("seq"), "seq", "left_anti").withColumn("repeated", F.lit(False))
        self.parts.put(repeated.unionByName(slow), number)

    def lines(self, spark: SparkSession, batch: int) -> DataFrame:
        """The lines that one micro-batch wrote."""
        return self.parts.of(spark, batch)

    def feed(self, spark: SparkSession) -> DataFrame:
        """One line per flagged statement, as far as is known."""
        return self.parts.rows(spark).groupBy("seq").agg(F.max_by("line", "repeated").alias("line"))


class GateJob:
    """The CI gate of a stream: problems, totals and exit code after each micro-batch.

    Kept are counts per problem key. A batch adds its own statements, and one to the N+1 count of a template for each
    statement, of this batch or an earlier one, that it shows to be repeated. The stream is not read again.
    """

    def __init__(self, spark: SparkSession, folder: str, config: DetectionConfig = DEFAULTS, every: int = 16):
        self.config, self.detector = config, NPlus1Job(spark, folder, config=config)
        counts = ("events", "nplus1", "slow", "slow_us")
        schema = "query string, " + ", ".join(f"{c} bigint" for c in counts)
        self.sums = Sums(spark, os.path.join(folder, "gate"), schema, dict.fromkeys(counts, F.sum), every)
        self.verdicts = Parts(spark, os.path.join(folder, "verdicts"), "total bigint, problems bigint, has_problems boolean, exit_code int")

    def __call__(self, batch: DataFrame, number: int) -> None:
        hits = self.detector.step(batch, number)
        own = ci.folded(stream_enrich(batch, self.config).withColumn("n_plus_1", F.lit(False)))
        key = F.coalesce(F.nullif(normalize_query(F.col("key")), F.lit("")), F.col("key"))
        none = F.lit(None).cast("bigint")
        repeated = hits.groupBy(key.alias("query")).agg(F.count(F.lit(1)).alias("nplus1"))
        added = repeated.select("query", F.lit(0).cast("bigint").alias("events"), "nplus1", F.lit(0).cast("bigint").alias("slow"), none.alias("slow_us"))
        self.sums.put(own.unionByName(added), number)
        self.verdicts.put(self.summary(batch.sparkSession), number)

    def problems(self, spark: SparkSession) -> DataFrame:
        return ci.problems_of(self.sums.rows(spark))

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: statements, problems, verdict and exit code so far."""
        return ci.verdict_of(self.sums.rows(spark))

    def report(self, spark: SparkSession) -> DataFrame:
        """The lines of the gate's report so far."""
        return ci.report_of(self.sums.rows(spark))


def stream_slow_feed(stream: DataFrame, config: DetectionConfig = DEFAULTS) -> DataFrame:
    """Live lines of slow statements, whatever their N+1 flag turns out to be; stateless."""
    return alert_feed(stream_enrich(stream, config).withColumn("n_plus_1", F.lit(False)))


def stream_alert_feed(spark: SparkSession, stream: DataFrame, folder: str, config: DetectionConfig = DEFAULTS) -> FeedJob:
    """Run the alert feed over everything present."""
    job = FeedJob(spark, folder, config)
    run_batches(stream, folder, "feed", job)
    return job


def stream_ci_gate(spark: SparkSession, stream: DataFrame, folder: str, config: DetectionConfig = DEFAULTS) -> GateJob:
    """Run the gate over everything present."""
    job = GateJob(spark, folder, config)
    run_batches(stream, folder, "gate", job)
    return job
