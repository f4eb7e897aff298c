"""Reading statement logs, whole or as a stream, always with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtflow.schema import OP_CODES, STATEMENT

CORRUPT = "_corrupt_record"
BYTES_PER_TRIGGER = 1 << 30

# The JSON object of the event feed.
FEED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("args", T.ArrayType(T.StringType())),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("rows_affected", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("tx_id", T.StringType()),
        T.StructField("n_plus_1", T.BooleanType()),
        T.StructField("slow_query", T.BooleanType()),
        T.StructField("normalized_query", T.StringType()),
    ]
)


def _schema(fmt: str) -> T.StructType:
    if fmt == "parquet":
        return STATEMENT
    if fmt == "json":
        return T.StructType([*STATEMENT.fields, T.StructField(CORRUPT, T.StringType())])
    raise ValueError(f"unknown statement log format: {fmt}")


def read_statement_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A statement log at rest. Broken JSON lines keep their text in `_corrupt_record`."""
    return spark.read.schema(_schema(fmt)).format(fmt).load(path)


def stream_statement_log(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | str = BYTES_PER_TRIGGER,
) -> DataFrame:
    """A growing folder of log files as an unbounded stream.

    A micro-batch takes `files_per_trigger` files, or else about `bytes_per_trigger`. This bounds what one
    key can bring to a task of a keyed job, also when a backlog is worked off.
    """
    reader = spark.readStream.schema(_schema(fmt)).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(path)


def op_code(name: Column) -> Column:
    """Operation code of a feed name, UnknownOp(n) included."""
    code = F.regexp_extract(name, r"\AUnknownOp\((-?[0-9]+)\)\z", 1).try_cast("int")
    for known, value in OP_CODES.items():
        code = F.when(F.lower(name) == known, F.lit(value)).otherwise(code)
    return code


def read_event_feed(spark: SparkSession, path: str) -> DataFrame:
    """Events written one JSON object per line, with absent fields as empty or false."""
    feed = spark.read.schema(FEED).json(path)
    empty = F.lit("")
    return feed.select(
        "id",
        op_code(F.col("op")).alias("op"),
        "query",
        F.coalesce("args", F.array().cast("array<string>")).alias("args"),
        F.unix_micros("start_time").alias("start_us"),
        F.round(F.col("duration_ms") * 1000).cast("bigint").alias("dur_us"),
        "rows_affected",
        F.coalesce("error", empty).alias("error"),
        "tx_id",
        F.coalesce("n_plus_1", F.lit(False)).alias("n_plus_1"),
        F.coalesce("slow_query", F.lit(False)).alias("slow_query"),
        F.coalesce("normalized_query", empty).alias("normalized_query"),
    )
