"""Schemas and operation codes of the statement log and the wire-message log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operation codes and their names.
OP_NAMES = {
    0: "Query",
    1: "Exec",
    2: "Prepare",
    3: "Bind",
    4: "Execute",
    5: "Begin",
    6: "Commit",
    7: "Rollback",
}
OP_CODES = {name.lower(): code for code, name in OP_NAMES.items()}
BEGIN, COMMIT, ROLLBACK = 5, 6, 7
QUERY_OPS = (0, 1, 4)
LIFECYCLE_OPS = (2, 3, 5, 6, 7)

# One captured statement. `seq` is the unique global arrival number; `conn_id` the connection.
STATEMENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("conn_id", T.LongType()),
        T.StructField("op", T.IntegerType()),
        T.StructField("query", T.StringType()),
        T.StructField("args", T.ArrayType(T.StringType())),
        T.StructField("start_us", T.LongType()),
        T.StructField("dur_us", T.LongType()),
        T.StructField("rows_affected", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

# One framed protocol message. `msg` is the unique global arrival number of the capture.
WIRE = T.StructType(
    [
        T.StructField("msg", T.LongType()),
        T.StructField("conn_id", T.LongType()),
        T.StructField("us", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("stmt", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("args", T.ArrayType(T.StringType())),
        T.StructField("oids", T.ArrayType(T.IntegerType())),
        T.StructField("tag", T.StringType()),
    ]
)


# What a capture may add to it: bytes, format codes and types of bound values, and the row count of a MySQL OK.
WIRE_VALUES = T.StructType(
    [
        T.StructField("payloads", T.ArrayType(T.BinaryType())),
        T.StructField("formats", T.ArrayType(T.ShortType())),
        T.StructField("types", T.ArrayType(T.IntegerType())),
        T.StructField("affected", T.LongType()),
    ]
)


def op_name(op: Column) -> Column:
    """Name of an operation code; unknown codes keep their number."""
    named = F.lit(None).cast("string")
    for code, name in OP_NAMES.items():
        named = F.when(op == code, F.lit(name)).otherwise(named)
    return F.coalesce(named, F.concat(F.lit("UnknownOp("), op.cast("string"), F.lit(")")))


def is_query_op(op: Column) -> Column:
    """Operations that run a statement."""
    return op.isin(*QUERY_OPS)


def is_lifecycle_op(op: Column) -> Column:
    """Operations left out of statistics; unknown codes are not among them."""
    return op.isin(*LIFECYCLE_OPS)
