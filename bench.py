"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.catalog import QUERIES
from checks.fixture import statement_log
from stmtflow.operators import nplus1, stats, transactions
from stmtflow.plans.enrich import with_template
from stmtflow.plans.materialize import materialize
from stmtflow.session import local_session

HEADLINE = [
    "flagship",
    "template_stats_raw",
    "nplus1_flags",
    "nplus1_alerts",
    "nplus1_alerts_template",
    "assign_tx",
    "tx_summary",
    "tx_listing",
    "tx_detail",
    "filter_combined",
    "ci_report",
    "export_markdown_all",
    "export_json",
    "event_json",
    "timeline_concurrency",
    "bind_args",
    "sql_token_census",
    "pair_requests",
    "resolve_prepared",
    "rebuild_statements",
    "decode_params",
    "nplus1_flags_arrival",
    "saved_filter_matches",
    "search_index",
    "stream_nplus1",
    "stream_alert_feed",
    "stream_ci_gate",
    "stream_template_stats",
    "stream_windowed_rates",
]


INPUTS = ("match_counts", "pair_requests", "decode_params", "stream_log", "stream_nplus1")


def timed(spark, name: str, sf_dir: str) -> float:
    begin = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - begin, 3)


def skewed_log(spark, sf_dir: str) -> DataFrame:
    """Ten times the log, half of it on one connection and a third of it one text, stored before the clock starts."""
    log = statement_log(spark, sf_dir)
    span = log.agg(F.max("seq")).first()[0] + 1
    hot = "SELECT id FROM users WHERE id = $1"
    copies = log.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    made = copies.withColumns(
        {
            "seq": F.col("seq") * 10 + F.col("_copy"),
            "start_us": F.col("start_us") * 10 + F.col("_copy"),
            "conn_id": F.when(F.pmod(F.xxhash64("seq", "_copy"), F.lit(2)) == 0, 1).otherwise(F.col("conn_id")).cast("bigint"),
            "query": F.when(F.pmod(F.xxhash64("_copy", "seq"), F.lit(3)) == 0, hot).otherwise(F.col("query")),
        }
    ).drop("_copy")
    return materialize(made, f"skewed-{span}")


SKEWED = {
    "templates": with_template,
    "template_stats": lambda log: stats.template_stats(with_template(log)),
    "nplus1_flags": nplus1.with_nplus1,
    "nplus1_flags_arrival": lambda log: nplus1.with_nplus1(log, order="arrival"),
    "nplus1_alerts": nplus1.nplus1_alerts,
    "assign_tx": transactions.assign_tx,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Derived inputs are stored by first runs of their own, which also start the JVM; their times are given apart.
    inputs = {name: timed(spark, name, sf_dir) for name in INPUTS}
    cold = {name: timed(spark, name, sf_dir) for name in HEADLINE}
    warm = {name: timed(spark, name, sf_dir) for name in HEADLINE}
    log, skewed = skewed_log(spark, sf_dir), {}
    for name, run in SKEWED.items():
        begin = time.time()
        run(log).write.format("noop").mode("overwrite").save()
        skewed[name] = round(time.time() - begin, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    result = {
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "first_run": cold,
        "inputs": inputs,
        "ten_times_skewed": skewed,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
