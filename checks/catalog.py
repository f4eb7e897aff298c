"""One query per operator over the derived log. Every query reads the whole of its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixture
from stmtflow.config import DetectionConfig
from stmtflow.functions import binding, decode, render, text
from stmtflow.operators import census, ci, export, feed, listing, nplus1, saved, search, stats, timeline, transactions, wire
from stmtflow.plans.enrich import enrich, with_slow, with_template
from stmtflow.schema import op_name
from stmtflow.session import work_dir
from stmtflow.sources.log import read_event_feed, read_statement_log, stream_statement_log
from stmtflow.sources.sinks import write_event_feed
from stmtflow.streaming import jobs, combined, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHART = 80
FILTER = "op:select d>100ms"


def query(fn: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


def log(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.statement_log(spark, sf)


def templated(spark: SparkSession, sf: str) -> DataFrame:
    return with_template(log(spark, sf))


def scalar(spark: SparkSession, sf: str) -> DataFrame:
    """Template and slow flag."""
    return with_slow(templated(spark, sf))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Template and both flags."""
    return nplus1.with_nplus1(scalar(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Transaction labels only."""
    return transactions.assign_tx(log(spark, sf))


def joined(array: str | Column) -> Column:
    return F.array_join(array, "|")


def flat_log(df: DataFrame) -> DataFrame:
    return df.select(
        "seq", "conn_id", "op", "query", joined("args").alias("args"), "start_us", "dur_us", "rows_affected", "error"
    )


def replay(spark: SparkSession, sf: str, completed: bool = False) -> DataFrame:
    """The log as a stream, one slice after the other, by arrival or by completion."""
    folder = fixture.replay_folder(spark, sf, completed=completed)
    return stream_statement_log(spark, f"{folder}/log", files_per_trigger=3)


# Sources and sinks


@query
def read_statement_log_parquet(spark, sf):
    path = work_dir(spark, "log")
    log(spark, sf).write.parquet(path)
    return flat_log(read_statement_log(spark, path))


@query
def read_statement_log_json(spark, sf):
    path = work_dir(spark, "log")
    log(spark, sf).write.json(path)
    return flat_log(read_statement_log(spark, path, "json"))


@query
def read_feed(spark, sf):
    path = work_dir(spark, "feed")
    write_event_feed(enrich(log(spark, sf)), path)
    return read_event_feed(spark, path).select(
        F.col("id").cast("bigint").alias("seq"),
        "op",
        "query",
        joined("args").alias("args"),
        "start_us",
        "dur_us",
        "rows_affected",
        "error",
        F.coalesce("tx_id", F.lit("")).alias("tx_id"),
        "n_plus_1",
        "slow_query",
        "normalized_query",
    )


@query
def stream_log(spark, sf):
    stream = replay(spark, sf)
    out = jobs.run_available(stream, work_dir(spark, "stream"), "log")
    return flat_log(jobs.read_back(spark, out, stream))


@query
def event_json(spark, sf):
    return export.event_json(enrich(log(spark, sf)))


@query
def sanitize_utf8(spark, sf):
    raw = F.concat(
        F.col("query").cast("binary"), F.unhex(F.lit("FF")), F.col("error").cast("binary"), F.unhex(F.lit("E2827A"))
    )
    return log(spark, sf).select("seq", text.sanitize_utf8(raw).alias("query"))


@query
def sanitize_event(spark, sf):
    broken = lambda c, end: F.concat(c.cast("binary"), F.unhex(F.lit(end)))
    raw = templated(spark, sf).select(
        "seq",
        broken(F.col("query"), "FF").alias("query"),
        F.transform("args", lambda a: broken(a, "C3")).alias("args"),
        broken(F.col("error"), "E282").alias("error"),
        broken(F.col("normalized_query"), "F09F98").alias("normalized_query"),
    )
    return text.sanitize_event(raw).withColumn("args", joined("args"))


@query
def export_json(spark, sf):
    return export.export_json(transactions.assign_tx(templated(spark, sf)), FILTER, "users")


@query
def export_markdown(spark, sf):
    return export.export_markdown(templated(spark, sf), FILTER, "users")


@query
def export_markdown_all(spark, sf):
    return export.export_markdown(templated(spark, sf))


@query
def export_markdown_web(spark, sf):
    return export.export_markdown(templated(spark, sf), "key|s d>1ms", web=True).unionByName(
        export.export_markdown(templated(spark, sf), "execute", web=True).withColumn("section", F.col("section") + 10)
    )


@query
def fanout_sinks(spark, sf):
    subscribers = {
        "all": F.lit(True),
        "errors": F.col("error") != "",
        "slow": F.col("slow_query"),
        "selects": text.is_select(F.col("op"), F.col("query")),
    }
    folder = work_dir(spark, "fanout")
    combined.fanout_sinks(spark, replay(spark, sf), folder, subscribers)
    counts = [
        spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs")).select(
            F.lit(name).alias("subscriber"), "n", "seqs"
        )
        for name in subscribers
    ]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole


# Events rebuilt from messages


@query
def pair_requests(spark, sf):
    return wire.pair_requests(fixture.wire_log(spark, sf)).select(
        "msg", "conn_id", "kind", "answer_msg", "rows_affected", "error"
    )


@query
def statement_duration(spark, sf):
    return wire.pair_requests(fixture.wire_log(spark, sf)).select("msg", "start_us", "dur_us")


@query
def resolve_prepared(spark, sf):
    return wire.resolve_prepared(fixture.wire_log(spark, sf)).select(
        "msg", "conn_id", "stmt", "query", joined("args").alias("args")
    )


@query
def resolve_prepared_mysql(spark, sf):
    rows = fixture.wire_log(spark, sf)
    # MySQL names the statement in the execution, and here a cycle's end closes statement s1.
    name = F.concat(F.lit("s"), (F.col("seq") % 3).cast("string"))
    closing = (F.col("kind") == "RFQ") & (F.col("seq") % 3 == 1)
    mysql = rows.withColumns({"stmt": name, "kind": F.when(closing, F.lit("CLOSE")).otherwise(F.col("kind"))})
    return wire.resolve_prepared(mysql, "mysql").select("msg", "conn_id", "stmt", "query")


@query
def match_descriptions(spark, sf):
    return wire.match_descriptions(fixture.wire_log(spark, sf)).select(
        "msg", "conn_id", "stmt", joined(F.col("oids").cast("array<string>")).alias("oids")
    )


@query
def resolve_param_types(spark, sf):
    return wire.resolve_param_types(fixture.wire_log(spark, sf)).select(
        "msg", "conn_id", "stmt", joined(F.col("oids").cast("array<string>")).alias("oids")
    )


@query
def decode_params(spark, sf):
    return decode.decode_params(fixture.parameters(spark, sf)).select("seq", "what", "value")


@query
def binary_format_flags(spark, sf):
    count = F.col("seq") % 4
    one = F.lit(1).cast("smallint")
    codes = F.when(count == 0, F.array().cast("array<smallint>")).otherwise(
        F.transform(F.sequence(F.lit(1), count.cast("int")), lambda i: (i + F.col("conn_id")) % 2 * one)
    )
    flags = decode.binary_format_flags(F.col("args"), codes.cast("array<smallint>"))
    return log(spark, sf).select("seq", joined(flags.cast("array<string>")).alias("flags"))


@query
def assign_tx(spark, sf):
    return labelled(spark, sf).select("seq", "conn_id", "op", "tx_id")


@query
def classify_op(spark, sf):
    untyped = log(spark, sf).withColumn("op", F.lit(0))
    return wire.classify_requests(untyped, "mysql")


@query
def rows_affected(spark, sf):
    tagged = fixture.wire_log(spark, sf).filter(F.col("tag").isNotNull())
    return tagged.select("msg", wire.rows_affected(F.col("tag")).alias("rows_affected"))


def _rebuilt(messages: DataFrame, driver: str = "postgres") -> DataFrame:
    return wire.rebuild_statements(messages, driver).select(
        "seq",
        "conn_id",
        "op",
        "query",
        joined("args").alias("args"),
        "start_us",
        "dur_us",
        "rows_affected",
        "error",
        "tx_id",
    )


@query
def rebuild_statements(spark, sf):
    return _rebuilt(fixture.wire_log(spark, sf))


@query
def rebuild_statements_bytes(spark, sf):
    return _rebuilt(fixture.wire_log_bytes(spark, sf))


@query
def rebuild_statements_mysql(spark, sf):
    return _rebuilt(fixture.wire_log_mysql(spark, sf), "mysql")


# Enrichment


@query
def normalize_query(spark, sf):
    return templated(spark, sf).select("seq", "normalized_query")


@query
def normalize_documents(spark, sf):
    docs = fixture.read_table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(text.normalize_query(F.col("text"))).alias("template"))


@query
def is_select(spark, sf):
    return log(spark, sf).select("seq", text.is_select(F.col("op"), F.col("query")).alias("is_select"))


@query
def is_metadata_query(spark, sf):
    return log(spark, sf).select("seq", text.is_metadata_query(F.col("op"), F.col("query")).alias("is_metadata"))


@query
def nplus1_flags(spark, sf):
    return nplus1.with_nplus1(log(spark, sf)).select("seq", "n_plus_1")


@query
def nplus1_flags_template(spark, sf):
    return nplus1.with_nplus1(templated(spark, sf), F.col("normalized_query")).select("seq", "n_plus_1")


@query
def nplus1_alerts(spark, sf):
    return nplus1.nplus1_alerts(log(spark, sf))


@query
def nplus1_alerts_template(spark, sf):
    return nplus1.nplus1_alerts(templated(spark, sf), F.col("normalized_query"))


@query
def nplus1_flags_arrival(spark, sf):
    return nplus1.with_nplus1(fixture.completed_log(spark, sf), order="arrival").select("seq", "n_plus_1")


@query
def nplus1_alerts_arrival(spark, sf):
    return nplus1.nplus1_alerts(fixture.completed_log(spark, sf), order="arrival")


@query
def slow_flags(spark, sf):
    return with_slow(log(spark, sf)).select("seq", "slow_query")


@query
def event_status(spark, sf):
    return flagged(spark, sf).select("seq", feed.event_status().alias("status"), feed.bar_class().alias("bar"))


@query
def event_status_counts(spark, sf):
    return flagged(spark, sf).groupBy(feed.event_status().alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def typed_args(spark, sf):
    stamped = F.replace(F.col("query"), F.lit("$1"), F.lit("$1 :: timestamptz"))
    args = F.transform("args", lambda a: F.when(a.rlike("^[0-9]+$"), F.concat(a, F.lit("000000"))).otherwise(a))
    typed = binding.typed_args(stamped, args)
    shown = F.transform(
        typed, lambda t: F.coalesce(F.concat(F.lit("ts:"), F.unix_micros(t["ts"]).cast("string")), t["text"])
    )
    return log(spark, sf).select("seq", joined(shown).alias("args"))


@query
def bind_args(spark, sf):
    return log(spark, sf).select("seq", binding.bind_args(F.col("query"), F.col("args")).alias("bound"))


@query
def bind_args_marks(spark, sf):
    marks = F.regexp_replace("query", r"\$[0-9]+", "?")
    return log(spark, sf).select("seq", binding.bind_args(marks, F.col("args")).alias("bound"))


@query
def bind_args_web(spark, sf):
    return log(spark, sf).select("seq", binding.bind_args_web(F.col("query"), F.col("args")).alias("bound"))


@query
def op_names(spark, sf):
    return log(spark, sf).select("seq", op_name(F.col("op") + F.col("op") % 3 * 4).alias("op_name"))


@query
def alert_feed(spark, sf):
    return feed.alert_feed(flagged(spark, sf))


@query
def alert_feed_web(spark, sf):
    return feed.alert_feed(flagged(spark, sf), web=True)


# Filters


def filtered(name: str, condition: str, base: Callable, **options) -> None:
    QUERIES[name] = lambda spark, sf: listing.filter_events(base(spark, sf), condition, **options).select(
        "seq", "query", "dur_us"
    )


filtered("filter_duration", "d>12.5ms d<0.1s", log)
filtered("filter_error", "Error", log)
filtered("filter_nplus1", "NPlus1", flagged)
filtered("filter_slow", "slow", scalar)
filtered("filter_op_protocol", "op:execute", log)
filtered("filter_op_keyword", "op:UPDATE", log)
filtered("filter_text", "POSTS", log)
filtered("filter_text_web", "key", log, web=True)
filtered("filter_combined", FILTER, log)
filtered("search_text", "op:select", log, search="FROM users WHERE")


@query
def filter_unknown_op(spark, sf):
    return listing.op_pattern_counts(log(spark, sf), ("select", "UPDATE", "execute", "begin", "merge", "op:query"))


@query
def filter_large_duration(spark, sf):
    lines = log(spark, sf).select(
        F.concat(F.lit("d>"), F.col("start_us").cast("string"), F.repeat(F.lit("0"), (F.col("seq") % 3 * 4).cast("int")), F.lit("us users")).alias("filter")
    )
    return listing.describe_filters(lines)


@query
def describe_filter(spark, sf):
    return listing.describe_filters(fixture.saved_filters(spark, sf))


@query
def saved_filter_matches(spark, sf):
    lines = fixture.watch_lists(spark, sf).unionByName(fixture.saved_filters(spark, sf))
    return saved.saved_filter_matches(flagged(spark, sf), lines)


@query
def search_index(spark, sf):
    return search.search_index(search.build_index(log(spark, sf)), fixture.searches(spark, sf))


@query
def match_counts(spark, sf):
    return listing.match_counts(log(spark, sf), FILTER, "users")


# Aggregations


@query
def template_stats(spark, sf):
    return stats.template_stats(templated(spark, sf))


@query
def template_stats_raw(spark, sf):
    raw = log(spark, sf).withColumn("normalized_query", F.col("query"))
    return stats.template_stats(raw)


@query
def template_stats_export(spark, sf):
    kept = export.exported_events(templated(spark, sf), "d>20ms")
    return rounded(stats.template_stats_export(kept))


@query
def template_stats_web(spark, sf):
    return rounded(stats.template_stats_web(templated(spark, sf), "error d>1ms users"))


def rounded(df: DataFrame) -> DataFrame:
    doubles = {name: F.round(name, 6) for name, kind in df.dtypes if kind == "double"}
    return df.withColumns(doubles)


@query
def template_p95(spark, sf):
    return stats.template_p95(templated(spark, sf))


@query
def template_p95_approx(spark, sf):
    return stats.template_p95_check(templated(spark, sf))


def _top(mode: str, ascending: bool = False) -> Query:
    return lambda spark, sf: stats.top_templates(
        stats.template_stats(log(spark, sf).withColumn("normalized_query", F.col("query"))), mode, 20, ascending
    )


for _mode in stats.SORT_MODES:
    QUERIES[f"top_templates_by_{_mode}"] = _top(_mode)
    QUERIES[f"top_templates_by_{_mode}_ascending"] = _top(_mode, ascending=True)


@query
def ci_problems(spark, sf):
    return ci.ci_problems(flagged(spark, sf))


@query
def ci_summary(spark, sf):
    return ci.ci_summary(flagged(spark, sf))


@query
def ci_report(spark, sf):
    return ci.ci_report(flagged(spark, sf))


@query
def export_summary(spark, sf):
    return export.export_summary(log(spark, sf), "op:insert", "orders")


# Transactions and listings


@query
def tx_summary(spark, sf):
    return transactions.tx_summary(labelled(spark, sf))


@query
def tx_listing(spark, sf):
    return transactions.tx_listing(labelled(spark, sf))


@query
def tx_listing_collapsed(spark, sf):
    events = labelled(spark, sf)
    failed = events.filter((F.col("error") != "") & F.col("tx_id").isNotNull()).select("tx_id")
    return transactions.tx_listing(events, failed)


@query
def flat_by_duration(spark, sf):
    return transactions.flat_by_duration(log(spark, sf), 100).select("seq", "dur_us")


@query
def tx_detail(spark, sf):
    return transactions.tx_detail(labelled(spark, sf), 40)


@query
def tx_preview(spark, sf):
    return transactions.tx_detail(labelled(spark, sf), 40, preview=True)


@query
def event_detail(spark, sf):
    failed = log(spark, sf).filter(F.col("error") != "").select("seq")
    return transactions.event_detail(labelled(spark, sf), failed)


# Timeline


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.drawn(log(spark, sf))


@query
def timeline_bounds(spark, sf):
    return timeline.timeline_bounds(bars(spark, sf))


@query
def timeline_layout(spark, sf):
    return rounded(timeline.timeline_layout(bars(spark, sf), CHART))


@query
def timeline_layout_web(spark, sf):
    return rounded(timeline.timeline_layout_web(bars(spark, sf), 1000, 360))


@query
def timeline_ticks(spark, sf):
    return rounded(timeline.timeline_ticks(bars(spark, sf), CHART))


@query
def timeline_ticks_web(spark, sf):
    return rounded(timeline.timeline_ticks(bars(spark, sf), 1000, web=True))


@query
def timeline_last_n(spark, sf):
    return timeline.timeline_bounds(timeline.drawn(log(spark, sf), 500))


@query
def timeline_concurrency(spark, sf):
    return timeline.timeline_concurrency(bars(spark, sf), 10_000)


@query
def timeline_running_at(spark, sf):
    """What runs in every seventh bucket, changed or not."""
    drawn = bars(spark, sf)
    asked = timeline.timeline_bounds(drawn).select(
        F.explode(F.sequence(F.floor(F.col("min_us") / 10_000), F.floor(F.col("max_us") / 10_000) + 7, F.lit(7).cast("bigint"))).alias("bucket")
    )
    return timeline.running_at(timeline.timeline_concurrency(drawn, 10_000), asked)


@query
def timeline_peaks(spark, sf):
    return timeline.timeline_peaks(timeline.timeline_concurrency(bars(spark, sf), 10_000), 100)


# Text functions


@query
def format_duration(spark, sf):
    scaled = F.col("dur_us") * F.when(F.col("seq") % 3 == 0, F.lit(37)).otherwise(F.lit(1))
    return log(spark, sf).select(
        "seq",
        render.format_duration(scaled).alias("duration"),
        render.format_ms(scaled / F.lit(1000.0)).alias("duration_ms"),
    )


@query
def duration_text(spark, sf):
    ns = F.col("dur_us") * F.when(F.col("seq") % 2 == 0, F.lit(1_000)).otherwise(F.lit(25_000_000))
    return log(spark, sf).select("seq", render.duration_text(ns).alias("duration"))


@query
def format_time(spark, sf):
    return log(spark, sf).select(
        "seq",
        render.format_time(F.col("start_us")).alias("time"),
        render.format_time_full(F.col("start_us")).alias("time_full"),
    )


@query
def squash_truncate(spark, sf):
    docs = fixture.read_table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        text.squash_truncate(F.col("text"), 60).alias("short"),
        F.md5(text.squash(F.col("text"))).alias("squashed"),
    )


@query
def truncate_dots(spark, sf):
    return log(spark, sf).select("seq", text.truncate_dots(F.col("query"), 30).alias("short"))


@query
def escape_pipes(spark, sf):
    return log(spark, sf).select("seq", text.escape_pipes(F.col("error")).alias("error"))


@query
def format_args(spark, sf):
    return log(spark, sf).select("seq", binding.format_args(F.col("args")).alias("args"))


@query
def rfc3339_time(spark, sf):
    cut = F.col("start_us") - F.when(F.col("seq") % 3 == 0, F.pmod("start_us", F.lit(1_000_000))).when(
        F.col("seq") % 3 == 1, F.pmod("start_us", F.lit(1_000))
    ).otherwise(F.lit(0))
    return log(spark, sf).select("seq", render.rfc3339_time(cut).alias("time"))


# Streams


def streamed(spark: SparkSession, job: DataFrame, name: str) -> DataFrame:
    out = jobs.run_available(job, work_dir(spark, name), name)
    return jobs.read_back(spark, out, job)


@query
def stream_enrich(spark, sf):
    return streamed(spark, jobs.stream_enrich(replay(spark, sf)), "enrich").select(
        "seq", "normalized_query", "slow_query"
    )


@query
def stream_nplus1(spark, sf):
    return combined.nplus1_job(spark, replay(spark, sf, True), work_dir(spark, "nplus1")).flags(spark)


@query
def stream_nplus1_off(spark, sf):
    off = DetectionConfig(nplus1_threshold=0)
    return combined.nplus1_job(spark, replay(spark, sf), work_dir(spark, "nplus1"), off).flags(spark)


@query
def stream_nplus1_alerts(spark, sf):
    return combined.nplus1_job(spark, replay(spark, sf, True), work_dir(spark, "alerts")).alerts(spark)


@query
def stream_alert_feed(spark, sf):
    return combined.stream_alert_feed(spark, replay(spark, sf, True), work_dir(spark, "feed")).feed(spark)


@query
def stream_template_stats(spark, sf):
    folder = work_dir(spark, "stats")
    job = jobs.TemplateStatsJob(spark, folder)
    jobs.run_batches(replay(spark, sf, True), folder, "stats", job)
    found = job.stats(spark)
    # The sketched p95 is held against the ranks of all events; three times the stated error leaves chance no part.
    near = stats.rank_check(found, templated(spark, sf), 3 * job.SKETCH_ERROR).select("normalized_query", F.col("within").alias("p95_near"))
    return found.drop("p95_us").join(near, "normalized_query")


def _rates(spark: SparkSession, sf: str, slide: int | None = None) -> DataFrame:
    folder = work_dir(spark, "rates")
    job = jobs.WindowedRatesJob(spark, folder, slide_us=slide)
    jobs.run_batches(replay(spark, sf, True), folder, "rates", job)
    return job.rates(spark)


@query
def stream_windowed_rates(spark, sf):
    return _rates(spark, sf)


@query
def stream_sliding_rates(spark, sf):
    return _rates(spark, sf, 200_000)


@query
def stream_tx_summary(spark, sf):
    folder = work_dir(spark, "tx")
    job = stateful.TxJob(spark, folder)
    jobs.run_batches(replay(spark, sf, True), folder, "tx", job)
    return job.summary(spark)


@query
def stream_ci_gate(spark, sf):
    return combined.stream_ci_gate(spark, replay(spark, sf, True), work_dir(spark, "gate")).problems(spark)


@query
def stream_ci_verdict(spark, sf):
    """The verdict that the last micro-batch wrote."""
    verdicts = combined.stream_ci_gate(spark, replay(spark, sf, True), work_dir(spark, "gate")).verdicts.rows(spark)
    newest = verdicts.orderBy(F.col("batch").desc()).limit(1)
    return newest.select("total", "problems", "has_problems", "exit_code")


@query
def stream_ci_report(spark, sf):
    return combined.stream_ci_gate(spark, replay(spark, sf, True), work_dir(spark, "gate")).report(spark)


@query
def late_event_report(spark, sf):
    # Failed statements are reported 200 seconds late.
    shift = F.when(F.col("error") != "", F.lit(200_000_000)).otherwise(F.lit(0))
    stream = jobs.stream_enrich(replay(spark, sf)).withColumn("start_us", F.col("start_us") - shift)
    late = streamed(spark, stateful.late_event_report(stream), "late")
    return late.groupBy("normalized_query").agg(F.sum("late").alias("late"), F.sum("seen").alias("seen"))


# Text libraries


@query
def sql_token_census(spark, sf):
    return census.sql_token_census(templated(spark, sf))


@query
def plan_node_census(spark, sf):
    return census.plan_node_census(fixture.stored_plans(spark, sf))


# The flagship


@query
def flagship(spark, sf):
    return stats.top_templates(stats.template_stats(templated(spark, sf)), "total", 20)
