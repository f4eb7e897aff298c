"""Inputs derived from the given tables: the statement log, the wire-message log, parameters, plans."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtflow.functions.ints import int_div
from stmtflow.plans.ordered import with_ordinal
from stmtflow.session import work_dir

LOG_SQL = """
SELECT event_id AS seq, user_id % 20 AS conn_id,
  CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 5
       WHEN event_type = 'signup' AND event_id % 4 = 1 THEN 6
       WHEN event_type = 'signup' THEN 7
       WHEN event_type IN ('view', 'error') THEN 0
       WHEN event_type = 'purchase' AND event_id % 10 = 0 THEN 2
       WHEN event_type = 'purchase' AND event_id % 10 = 1 THEN 3
       WHEN event_type = 'purchase' AND event_id % 10 = 2 THEN 1
       ELSE 4 END AS op,
  CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'BEGIN'
       WHEN event_type = 'signup' AND event_id % 4 = 1 THEN 'COMMIT'
       WHEN event_type = 'signup' THEN 'ROLLBACK'
       WHEN event_type = 'view' AND event_id % 9 = 0 THEN concat('SELECT  ', CAST(user_id AS {STR}), ' ')
       WHEN event_type = 'view' THEN concat('SELECT id, name FROM users WHERE id = ', CAST(user_id % 3 AS {STR}))
       WHEN event_type = 'click' THEN 'SELECT title FROM posts WHERE user_id = $1'
       WHEN event_type = 'purchase' THEN 'INSERT INTO orders (user_id, amount) VALUES ($1, $2)'
       ELSE concat('UPDATE users SET name = ', chr(39), 'u', chr(39), chr(39), CAST(user_id AS {STR}), chr(39),
                   ' WHERE id = ', CAST(user_id AS {STR})) END AS query,
  CASE WHEN event_type = 'click' THEN {ARR1}
       WHEN event_type = 'purchase' THEN {ARR2}
       ELSE {ARR0} END AS args,
  {EPOCH_US} {DIV} 3600 AS start_us,
  CAST(round(value * 1000) AS BIGINT) AS dur_us,
  CASE WHEN event_type IN ('purchase', 'error') THEN event_id % 5 ELSE 0 END AS rows_affected,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'duplicate key | users' ELSE '' END AS error
FROM {EVENTS}
"""

SPARK = {
    "STR": "STRING",
    "DIV": "div",
    "EPOCH_US": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts)",
    "ARR0": "CAST(array() AS ARRAY<STRING>)",
    "ARR1": "array(CAST(user_id AS STRING))",
    "ARR2": "array(CAST(user_id AS STRING), concat('O', chr(39), 'Brien'))",
    "EVENTS": "{events}",
}
DUCKDB = {
    "STR": "VARCHAR",
    "DIV": "//",
    "EPOCH_US": "epoch_us(ts)",
    "ARR0": "CAST([] AS VARCHAR[])",
    "ARR1": "[CAST(user_id AS VARCHAR)]",
    "ARR2": "[CAST(user_id AS VARCHAR), concat('O', chr(39), 'Brien')]",
    "EVENTS": "events",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a captured statement, time compressed 3,600 times."""
    return spark.sql(LOG_SQL.format(**SPARK), events=read_table(spark, sf_dir, "events"))


def statement_log_duckdb() -> str:
    """The same log as DuckDB SQL."""
    return LOG_SQL.format(**DUCKDB)


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable) -> DataFrame:
    """A derived input as a table, written once per session, as a capture would have left it."""
    place = (spark.sparkContext.applicationId, sf_dir, name)
    if place not in _STORED:
        path = work_dir(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _STORED[place] = path
    return spark.read.parquet(_STORED[place])


def wire_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages behind the statement log, numbered by arrival."""
    return _stored(spark, sf_dir, "wire", _wire_messages)


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded parameter values: (seq, what, proto, type_id, payload)."""
    return _stored(spark, sf_dir, "parameters", _parameters)


def _wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages ordered by (us, seq, rank)."""
    log = statement_log(spark, sf_dir)
    execute, seq = F.col("op") == 4, F.col("seq")
    parsed = execute & (seq % 7 != 0)
    name = F.when((F.col("conn_id") + seq) % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit("s"), ((F.col("conn_id") + seq) % 3).cast("string"))
    )
    end = F.col("start_us") + F.col("dur_us")
    none = F.lit(None)
    no_args, no_oids = none.cast("array<string>"), none.cast("array<int>")
    failed = F.col("error") != ""
    tag = F.when(failed, F.col("error")).otherwise(
        F.concat(F.lit("DO 0 "), F.col("rows_affected").cast("string"))
    )
    zero_oids = F.transform("args", lambda _: F.lit(0))
    real_oids = F.transform("args", lambda _, i: F.when(i == 0, F.lit(20)).otherwise(F.lit(25)))

    def message(when: Column, rank, us, kind, stmt=none, query=none, args=no_args, oids=no_oids, text=none) -> Column:
        record = F.struct(
            F.lit(rank).alias("rank"),
            us.cast("bigint").alias("us"),
            kind.alias("kind"),
            stmt.cast("string").alias("stmt"),
            query.cast("string").alias("query"),
            args.alias("args"),
            oids.alias("oids"),
            text.cast("string").alias("tag"),
        )
        return F.when(when, record)

    start = F.col("start_us")
    always = F.lit(True)
    messages = F.array_compact(
        F.array(
            message(parsed, 0, start - 2, F.lit("PARSE"), name, F.col("query"), oids=zero_oids),
            message(parsed, 1, start - 2, F.lit("DESC"), name),
            message(execute, 2, start - 1, F.lit("BIND"), name, args=F.col("args")),
            message(parsed & (seq % 11 != 0), 3, start - 1, F.lit("PD"), oids=real_oids),
            message(execute, 4, start, F.lit("EXEC")),
            message(~execute, 4, start, F.lit("REQ"), query=F.col("query")),
            message(always, 5, end, F.when(failed, F.lit("ERR")).otherwise(F.lit("DONE")), text=tag),
            message(execute, 6, end, F.lit("RFQ")),
        )
    )
    rows = log.select("seq", "conn_id", F.explode(messages).alias("m")).select("seq", "conn_id", "m.*")
    numbered = with_ordinal(rows, ["us", "seq", "rank"], "msg")
    return numbered.select("msg", "conn_id", "us", "kind", "stmt", "query", "args", "oids", "tag", "seq")


def wire_log_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages with bound values as bytes: a first argument that is a number is a binary int8."""
    whole = lambda a, i: (i == 0) & a.rlike(r"\A-?[0-9]{1,18}\z")
    big = lambda a: F.unhex(F.lpad(F.hex(a.try_cast("bigint")), 16, "0"))
    payloads = F.transform("args", lambda a, i: F.when(whole(a, i), big(a)).otherwise(a.cast("binary")))
    formats = F.transform("args", lambda a, i: F.when(whole(a, i), 1).otherwise(0).cast("smallint"))
    # One code would hold for all values.
    formats = F.when(F.size("args") == 1, F.concat(formats, F.array(F.lit(0).cast("smallint")))).otherwise(formats)
    return wire_log(spark, sf_dir).withColumns({"payloads": payloads, "formats": formats}).withColumn("args", F.lit(None).cast("array<string>"))


def wire_log_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MySQL messages: EXEC names its statement and carries an int and a text, every third statement is closed."""
    execs = F.col("kind") == "EXEC"
    swapped = F.unhex(F.regexp_replace(F.reverse(F.lpad(F.hex("seq"), 8, "0")), "(.)(.)", "$2$1"))
    payloads = F.array(swapped, F.concat(F.lit("v"), F.col("seq").cast("string")).cast("binary"), F.lit(None).cast("binary"))
    answered = (F.col("kind") == "DONE") & (F.col("seq") % 5 != 0)
    return wire_log(spark, sf_dir).filter("kind in ('REQ', 'PARSE', 'EXEC', 'DONE', 'ERR', 'RFQ')").withColumns(
        {
            "stmt": F.concat(F.lit("s"), (F.col("seq") % 3).cast("string")),
            "kind": F.when((F.col("kind") == "RFQ") & (F.col("seq") % 3 == 1), "CLOSE").otherwise(F.col("kind")),
            "payloads": F.when(execs, payloads),
            "types": F.when(execs, F.array(F.lit(3), F.lit(253), F.lit(3))),
            "tag": F.when(F.col("kind") == "ERR", F.col("tag")),
            "affected": F.when(answered, F.col("seq") % 50),
        }
    )


WIRE_DUCKDB = """
wire_rows AS (
  SELECT *, CASE WHEN (conn_id + seq) % 4 = 0 THEN '' ELSE concat('s', CAST((conn_id + seq) % 3 AS VARCHAR)) END AS nm
  FROM log
),
wire_all AS (
  SELECT seq, conn_id, 0 AS rank, start_us - 2 AS us, 'PARSE' AS kind, nm AS stmt, query,
         NULL::VARCHAR[] AS args, list_transform(args, lambda a: 0) AS oids, NULL AS tag
    FROM wire_rows WHERE op = 4 AND seq % 7 <> 0
  UNION ALL SELECT seq, conn_id, 1, start_us - 2, 'DESC', nm, NULL, NULL, NULL, NULL
    FROM wire_rows WHERE op = 4 AND seq % 7 <> 0
  UNION ALL SELECT seq, conn_id, 2, start_us - 1, 'BIND', nm, NULL, args, NULL, NULL FROM wire_rows WHERE op = 4
  UNION ALL SELECT seq, conn_id, 3, start_us - 1, 'PD', NULL, NULL, NULL,
         list_transform(args, lambda a, i: CASE WHEN i = 1 THEN 20 ELSE 25 END), NULL
    FROM wire_rows WHERE op = 4 AND seq % 7 <> 0 AND seq % 11 <> 0
  UNION ALL SELECT seq, conn_id, 4, start_us, CASE WHEN op = 4 THEN 'EXEC' ELSE 'REQ' END, NULL,
         CASE WHEN op = 4 THEN NULL ELSE query END, NULL, NULL, NULL FROM wire_rows
  UNION ALL SELECT seq, conn_id, 5, start_us + dur_us, CASE WHEN error <> '' THEN 'ERR' ELSE 'DONE' END, NULL, NULL,
         NULL, NULL, CASE WHEN error <> '' THEN error ELSE concat('DO 0 ', CAST(rows_affected AS VARCHAR)) END
    FROM wire_rows
  UNION ALL SELECT seq, conn_id, 6, start_us + dur_us, 'RFQ', NULL, NULL, NULL, NULL, NULL FROM wire_rows WHERE op = 4
),
wire AS (SELECT *, row_number() OVER (ORDER BY us, seq, rank) AS msg FROM wire_all)
"""


def saved_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter line per event."""
    limit = F.floor("value").cast("string")
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit(" OP:Select  d>"), limit, F.lit("ms "), "event_type", F.lit("  d<1.5s n+1")).alias("filter")
    )


def watch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another filter line per event: operations, words that statements hold or do not, durations and flags."""
    pick = lambda by, *choices: F.element_at(F.array(*map(F.lit, choices)), (F.floor(F.col("value") * by) % len(choices) + 1).cast("int"))
    limit = (F.floor("value") % 50).cast("string")
    return read_table(spark, sf_dir, "events").select(
        F.concat(
            pick(1, "op:select ", "op:UPDATE ", "", "op:execute ", "op:merge "),
            pick(10, "users ", "POSTS ", "", "e ", "event_type ", "from users ", "u"),
            pick(100, "d>", "d<"),
            limit,
            pick(7, "ms", ".5ms slow", "ms ERROR", "0us", "ms n+1"),
        ).alias("filter")
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search per statement: a piece of its text of up to eight characters, some turned around, some in capitals."""
    piece = F.substring(F.col("query"), (F.col("seq") % 23 + 1).cast("int"), (F.col("seq") % 9).cast("int"))
    shown = F.when(F.col("seq") % 5 == 1, F.reverse(piece)).when(F.col("seq") % 5 == 2, F.upper(piece)).otherwise(piece)
    return statement_log(spark, sf_dir).select(shown.alias("search"))


def stored_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An EXPLAIN text per event."""
    nl = F.lit("\n")
    top = (
        F.when(F.col("event_type") == "view", F.lit("Index Only Scan using users_pkey on users"))
        .when(F.col("event_type") == "click", F.lit("Hash Join  (cost=1.00..2.00 rows=5 width=4)"))
        .when(F.col("event_type") == "purchase", F.lit("ModifyTable on orders"))
        .otherwise(F.lit("Aggregate  (actual time=0.1..0.2 rows=1 loops=1)"))
    )
    text = F.concat(
        top,
        nl,
        F.lit("  ->  Seq Scan on posts  (cost=0.00.."),
        F.col("value").cast("decimal(10,2)").cast("string"),
        F.lit(" rows=1 width=8)"),
        nl,
        F.lit("        ->  Incremental Sort then Hash"),
        nl,
        F.lit("Planning Time: 0.1 ms"),
        nl,
        F.lit("Execution Time: 0.2 ms"),
    )
    return read_table(spark, sf_dir, "events").select(text.alias("plan"))


PLANS_DUCKDB = """
plans AS (
  SELECT concat(CASE WHEN event_type = 'view' THEN 'Index Only Scan using users_pkey on users'
       WHEN event_type = 'click' THEN 'Hash Join  (cost=1.00..2.00 rows=5 width=4)'
       WHEN event_type = 'purchase' THEN 'ModifyTable on orders'
       ELSE 'Aggregate  (actual time=0.1..0.2 rows=1 loops=1)' END, chr(10),
     '  ->  Seq Scan on posts  (cost=0.00..', CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR), ' rows=1 width=8)', chr(10),
     '        ->  Incremental Sort then Hash', chr(10), 'Planning Time: 0.1 ms', chr(10), 'Execution Time: 0.2 ms') AS plan
  FROM events
)
"""

FLOAT_KINDS = {"mysql_double": 5, "mysql_float": 4}


@F.pandas_udf(T.BinaryType())
def _float_bytes(value: pd.Series, kind: pd.Series) -> pd.Series:
    import struct

    return pd.Series([struct.pack("<f" if k == 4 else "<d", v) for v, k in zip(value, kind)])


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known values in the encodings of both protocols."""
    values = statement_log(spark, sf_dir).select(
        "seq", "conn_id", "query", "start_us", (F.col("dur_us") / F.lit(1000.0)).alias("value")
    )

    def big(value: Column, size: int) -> Column:
        return F.unhex(F.substring(F.lpad(F.hex(value.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size))

    def little(value: Column, size: int) -> Column:
        swapped = F.regexp_replace(F.reverse(F.hex(big(value, size))), "(.)(.)", "$2$1")
        return F.unhex(swapped)

    seq, conn = F.col("seq"), F.col("conn_id")
    made = [
        ("pg_int8", "pg", 20, big(-seq, 8)),
        ("pg_int4", "pg", 23, big(seq - 500, 4)),
        ("pg_int2", "pg", 21, big(-conn, 2)),
        ("pg_int1", "pg", 16, big(conn - 10, 1)),
        ("pg_time", "pg", 1114, big(F.col("start_us") * 3600 - 946_684_800_000_000, 8)),
        ("pg_uuid", "pg", 2950, F.unhex(F.md5("query"))),
        ("pg_text", "pg", 25, F.concat(F.lit("text of statement "), F.col("query")).cast("binary")),
        ("mysql_tiny", "mysql", 1, little(-conn, 1)),
        ("mysql_short", "mysql", 2, little(seq % 1000 - 500, 2)),
        ("mysql_long", "mysql", 3, little(-seq, 4)),
        ("mysql_longlong", "mysql", 8, little(F.col("start_us"), 8)),
        ("mysql_text", "mysql", 253, F.col("query").cast("binary")),
        ("mysql_null", "mysql", 6, F.lit(None).cast("binary")),
        ("mysql_short_data", "mysql", 8, little(seq, 4)),
        ("tidb_long", "tidb", 3, little(seq, 4)),
        ("tidb_text", "tidb", 253, F.col("query").cast("binary")),
        ("mysql_no_type", "mysql", None, F.col("query").cast("binary")),
        ("no_protocol", None, 23, F.col("query").cast("binary")),
    ]
    plain = F.array(
        *[
            F.struct(F.lit(w).alias("what"), F.lit(p).cast("string").alias("proto"), F.lit(t).cast("int").alias("type_id"), b.alias("payload"))
            for w, p, t, b in made
        ]
    )
    whole = values.select("seq", F.inline(plain))
    floats = values.select(
        "seq",
        F.inline(
            F.array(
                *[F.struct(F.lit(w).alias("what"), F.lit("mysql").alias("proto"), F.lit(k).alias("type_id"))
                  for w, k in FLOAT_KINDS.items()]
            )
        ),
        "value",
    ).select("seq", "what", "proto", "type_id", _float_bytes("value", "type_id").alias("payload"))
    return whole.unionByName(floats)


_REPLAYS: dict[tuple[str, str, str], str] = {}


def completed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement log numbered by completion, one statement of 37 taking 20 seconds longer."""
    slow = F.when(F.col("seq") % 37 == 0, F.lit(20_000_000)).otherwise(F.lit(0))
    ended = F.col("start_us") + F.coalesce(F.col("dur_us"), F.lit(0)) + slow
    log = statement_log(spark, sf_dir)
    numbered = with_ordinal(log.withColumns({"_began": F.col("seq"), "_ended": ended}).drop("seq"), ["_ended", "_began"], "seq")
    return numbered.select(*log.columns)


def replay_folder(spark: SparkSession, sf_dir: str, slices: int = 4, parts: int = 3, completed: bool = False) -> str:
    """The whole log as files for a stream to pick up, slice after slice, each in several files.

    Slices follow the arrival or, when `completed`, the completion, with one statement of 37 taking 20 seconds
    longer: many start long before what came earlier.
    """
    name = f"{slices}-{parts}-{completed}"
    known = _REPLAYS.get((spark.sparkContext.applicationId, sf_dir, name))
    if known:
        return known
    folder = work_dir(spark, "replay")
    slow = F.when(F.col("seq") % 37 == 0, F.lit(20_000_000)).otherwise(F.lit(0))
    at = F.col("start_us") + F.coalesce(F.col("dur_us"), F.lit(0)) + slow if completed else F.col("seq")
    log = statement_log(spark, sf_dir).withColumn("_at", at)
    low, high = log.agg(F.min("_at"), F.max("_at")).first()
    step = (high - low) // slices + 1
    for i in range(slices):
        part = log.filter((F.col("_at") >= low + i * step) & (F.col("_at") < low + (i + 1) * step)).drop("_at")
        part.repartition(parts, "seq").write.mode("append").parquet(os.path.join(folder, "log"))
    _REPLAYS[(spark.sparkContext.applicationId, sf_dir, name)] = folder
    return folder
