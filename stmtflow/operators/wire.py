"""Statement events rebuilt from a log of framed protocol messages.

Kinds: REQ (simple query), PARSE, BIND, EXEC, CLOSE from the client; DONE, ERR from the server; DESC and
PD (a statement description asked for and answered); RFQ, the end of a query cycle. `msg` is the arrival
number. All state is per connection, so every step is a running value over a connection, taken in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.decode import decode_params, is_binary_format
from stmtflow.functions.text import classify_op
from stmtflow.operators.transactions import assign_tx
from stmtflow.plans.materialize import materialize
from stmtflow.plans.ordered import LAST, MIN, SUM, chunk_width, following, running

REQUESTS = ("REQ", "EXEC")
ANSWERS = ("DONE", "ERR")
QUERY_OP, EXECUTE_OP = 0, 4
NO_TEXT = -(1 << 62)


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def rows_affected(tag: Column) -> Column:
    """The last word of a command tag as a number, else 0."""
    return F.coalesce(F.element_at(F.split(tag, " "), -1).try_cast("bigint"), F.lit(0).cast("bigint"))


def with_bound_values(wire: DataFrame, driver: str = "postgres", chunk_rows: int | None = None) -> DataFrame:
    """Set `args` from the bytes of bound values, where the log has them (column `payloads`).

    PostgreSQL: BIND carries payloads and format codes; binary ones are read by the types in force for the statement,
    others are text, and a null value is an empty text. MySQL: EXEC carries payloads and `types`; null is NULL.
    """
    if "payloads" not in wire.columns:
        return wire
    carriers = wire.filter(_is("BIND" if driver == "postgres" else "EXEC") & F.col("payloads").isNotNull())
    if driver == "postgres":
        in_force = resolve_param_types(wire.drop("payloads"), chunk_rows).select("msg", F.col("oids").alias("_types"))
        typed = carriers.select("msg", "payloads", "formats").join(in_force, "msg", "left")
        proto = F.when(is_binary_format(F.col("formats"), F.col("pos")), "pg").otherwise("text")
    else:
        typed = carriers.select("msg", "payloads", F.col("types").alias("_types"), F.lit(None).cast("array<smallint>").alias("formats"))
        proto = F.lit("mysql")
    values = typed.select("msg", "formats", "_types", F.posexplode("payloads").alias("pos", "payload"))
    kind = F.coalesce(F.get("_types", F.col("pos")), F.lit(0))
    decoded = decode_params(values.select("msg", "pos", "payload", proto.alias("proto"), kind.alias("type_id")))
    empty = F.lit("" if driver == "postgres" else "NULL")
    shown = F.when(F.col("payload").isNull(), empty).otherwise(F.col("value"))
    lists = decoded.groupBy("msg").agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("value")))).alias("_found"))
    bound = lists.select("msg", F.col("_found.value").alias("_bound"))
    return wire.join(bound, "msg", "left").withColumn("args", F.coalesce("_bound", "args")).drop("_bound")


def pair_requests(wire: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Requests with their answer: a request is answered when the next request or answer is an answer.

    A request that another one follows first is overwritten and lost; an answer without a request is
    ignored. Rows come from `affected`, the count of a MySQL OK, where the log has it, else from the tag; a result
    set has neither and counts 0.
    """
    kept = wire.filter(_is(*REQUESTS, *ANSWERS))
    after = following(
        kept,
        ["conn_id"],
        "msg",
        {
            "answer": F.col("kind"),
            "answer_us": F.col("us"),
            "answer_tag": F.col("tag"),
            "answer_msg": F.col("msg"),
            "answer_rows": F.col("affected") if "affected" in wire.columns else F.lit(None).cast("bigint"),
        },
        chunk_rows,
    )
    paired = after.filter(_is(*REQUESTS) & F.col("answer").isin(*ANSWERS))
    failed = F.col("answer") == "ERR"
    return paired.select(
        "msg",
        "conn_id",
        "kind",
        "stmt",
        "query",
        F.col("us").alias("start_us"),
        (F.col("answer_us") - F.col("us")).alias("dur_us"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.coalesce("answer_rows", rows_affected(F.col("answer_tag")))).alias("rows_affected"),
        F.when(failed, F.col("answer_tag")).otherwise(F.lit("")).alias("error"),
        "answer_msg",
    )


def _as_of(rows: DataFrame, order: str, names: dict[str, Column], chunk_rows: int | None) -> DataFrame:
    return running(rows, ["conn_id"], order, {n: (LAST, c) for n, c in names.items()}, chunk_rows=chunk_rows)


def resolve_prepared(wire: DataFrame, driver: str = "postgres", chunk_rows: int | None = None) -> DataFrame:
    """Per EXEC: the statement text and arguments in force.

    PostgreSQL: the last BIND names a statement; its text is what was last parsed under that name, or the
    last text parsed under any name when the name is empty or unknown. MySQL: EXEC names the statement
    itself, CLOSE removes it, and an unknown one has empty text.
    """
    # Only message numbers are carried along a connection; texts and arguments are fetched by them at the end.
    number = lambda *kinds: F.when(_is(*kinds), F.col("msg"))
    parsed = wire.filter(_is("PARSE")).select(F.col("msg").alias("_parse"), F.col("query").alias("_text"))
    if driver == "postgres":
        # PostgreSQL keeps the text of a closed name: only a new PARSE replaces it.
        kept = wire.filter(_is("PARSE", "BIND", "EXEC")).select("msg", "conn_id", "kind", "stmt")
        located = _as_of(kept, "msg", {"_bind": number("BIND"), "_any": number("PARSE")}, chunk_rows)
        bound = wire.filter(_is("BIND")).select(F.col("msg").alias("_bind"), F.col("stmt").alias("_bound"), "args")
        runs = located.filter(_is("EXEC")).drop("stmt").join(bound, "_bind", "left").withColumnRenamed("_bound", "stmt")
    else:
        kept = wire.filter(_is("PARSE", "EXEC", "CLOSE")).select("msg", "conn_id", "kind", "stmt", "args")
        located, runs = kept, kept.filter(_is("EXEC")).withColumn("_any", F.lit(None).cast("bigint"))
    names = ["msg", "conn_id", "kind", F.coalesce("stmt", F.lit("")).alias("_name")]
    given = located.filter(_is("PARSE", "CLOSE")).select(*names).unionByName(runs.select(*names))
    known = number("PARSE") if driver == "postgres" else F.when(_is("CLOSE"), F.lit(NO_TEXT)).otherwise(number("PARSE"))
    found = running(given, ["conn_id", "_name"], "msg", {"_known": (LAST, known)}, chunk_rows=chunk_rows)
    by_name = F.col("_known") if driver != "postgres" else F.when(F.col("_name") != "", F.col("_known"))
    chosen = found.filter(_is("EXEC")).select("msg", "_name", by_name.alias("_by_name")).join(runs, "msg")
    return (
        chosen.withColumn("_parse", F.coalesce("_by_name", "_any"))
        .join(parsed, "_parse", "left")
        .select(
            "msg",
            "conn_id",
            F.col("_name").alias("stmt"),
            F.coalesce("_text", F.lit("")).alias("query"),
            F.coalesce("args", F.array().cast("array<string>")).alias("args"),
        )
    )


def match_descriptions(wire: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per PD that answers a DESC: the statement it describes.

    Within a query cycle the answers come in the order of the questions. Open questions are questions
    minus answers; an answer that takes this to a new low of its cycle finds none and is ignored.
    """
    asks, answers = _is("DESC").cast("int"), _is("PD").cast("int")
    counted = running(
        wire.filter(_is("DESC", "PD", "RFQ")).select("msg", "conn_id", "kind", "stmt", "oids"),
        ["conn_id"],
        "msg",
        {"_asked": (SUM, asks), "_answered": (SUM, answers), "_cycle": (SUM, _is("RFQ").cast("int"))},
        chunk_rows=chunk_rows,
    ).filter(_is("DESC", "PD"))
    asked_before, answered_before = F.col("_asked") - asks, F.col("_answered") - answers
    levels = running(
        counted,
        ["conn_id", "_cycle"],
        "msg",
        {
            "_asked_at": (MIN, asked_before),
            "_answered_at": (MIN, answered_before),
            "_low": (MIN, asked_before - answered_before),
        },
        chunk_rows=chunk_rows,
    ).withColumns(
        {"_open": F.col("_asked") - F.col("_answered"), "_open_at": F.col("_asked_at") - F.col("_answered_at")}
    )
    # Both sides of the join below come from this table.
    table = materialize(levels, "descriptions")
    strays = F.col("_open_at") - F.least(F.col("_low"), F.col("_open"))
    number = F.col("_answered") - F.col("_answered_at") - strays
    given = table.filter(_is("PD") & (F.col("_open") >= F.col("_low"))).select(
        "conn_id", "_cycle", "msg", "oids", number.alias("_n")
    )
    wanted = table.filter(_is("DESC")).select(
        "conn_id",
        "_cycle",
        (F.col("_asked") - F.col("_asked_at")).alias("_n"),
        F.coalesce("stmt", F.lit("")).alias("stmt"),
    )
    return given.join(wanted, ["conn_id", "_cycle", "_n"]).select("msg", "conn_id", "stmt", "oids")


def resolve_param_types(wire: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per BIND: the parameter types in force for its statement.

    PARSE sets the types of its name and of the fallback; a description sets one of the two. A name
    without types of its own uses the fallback. Both lookups run in one pass, over the scopes `name` and
    `fallback`.
    """
    own = wire.filter(_is("PARSE", "BIND")).select(
        "msg", "conn_id", "kind", F.coalesce("stmt", F.lit("")).alias("stmt"), "oids"
    )
    described = match_descriptions(wire, chunk_rows).select("msg", "conn_id", F.lit("PD").alias("kind"), "stmt", "oids")
    named = F.col("stmt") != ""
    general = _is("PARSE", "BIND") | ~named
    scopes = F.array_compact(F.array(F.when(general, F.lit("fallback")), F.when(named, F.lit("name"))))
    rows = own.unionByName(described).withColumn("_scope", F.explode(scopes)).withColumn(
        "_scope_stmt", F.when(F.col("_scope") == "name", F.col("stmt")).otherwise(F.lit(""))
    )
    none = F.array().cast("array<int>")
    types = F.when(_is("PARSE", "PD"), F.struct(F.coalesce("oids", none).alias("oids")))
    found = running(rows, ["conn_id", "_scope", "_scope_stmt"], "msg", {"_types": (LAST, types)}, chunk_rows=chunk_rows)

    def of(scope: str) -> Column:
        return F.max_by("_types", F.when((F.col("_scope") == scope) & F.col("_types").isNotNull(), F.lit(1)))

    return (
        found.filter(_is("BIND"))
        .groupBy("msg", "conn_id", "stmt")
        .agg(of("name").alias("_name"), of("fallback").alias("_fallback"))
        .select(
            "msg", "conn_id", "stmt", F.coalesce(F.col("_name.oids"), F.col("_fallback.oids"), none).alias("oids")
        )
    )


def rebuild_statements(wire: DataFrame, driver: str = "postgres", chunk_rows: int | None = None) -> DataFrame:
    """The statement log of a message log: pairs, prepared text, operation and transaction labels.

    `seq` is the arrival number of the request. Labels follow every request, answered or not. Bound values are
    decoded if the log has their bytes.
    """
    if "payloads" in wire.columns:
        wire = materialize(with_bound_values(wire, driver, chunk_rows), "bound-values")
    # Measured once; steps over sparse numbers cut their own rows by rank.
    chunk_rows = chunk_rows or chunk_width(wire, "msg")
    prepared = resolve_prepared(wire, driver, chunk_rows).select(
        "msg", F.col("query").alias("_text"), F.col("args").alias("_args")
    )
    requests = (
        wire.filter(_is(*REQUESTS))
        .join(prepared, "msg", "left")
        .select(
            F.col("msg").alias("seq"),
            "conn_id",
            F.when(_is("EXEC"), F.lit(EXECUTE_OP)).otherwise(F.lit(QUERY_OP)).alias("op"),
            F.coalesce("_text", "query", F.lit("")).alias("query"),
            F.coalesce("_args", F.array().cast("array<string>")).alias("args"),
        )
    )
    labelled = assign_tx(materialize(requests, "requests"), driver, chunk_rows)
    answered = pair_requests(wire, chunk_rows).select(
        F.col("msg").alias("seq"), "start_us", "dur_us", "rows_affected", "error", "answer_msg"
    )
    return labelled.join(answered, "seq")


def classify_requests(log: DataFrame, driver: str = "postgres") -> DataFrame:
    """Operations after reading the text."""
    return log.select("seq", classify_op(F.col("op"), F.col("query"), driver).alias("op"))
