"""Counts over statement texts and stored plans, from the token classes the viewers colour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.text import STRING_LITERAL

# Words coloured as keywords and as functions.
KEYWORDS = (
    "SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "IN", "IS", "NULL", "AS", "ON", "JOIN", "LEFT",
    "RIGHT", "INNER", "OUTER", "CROSS", "FULL", "NATURAL", "USING", "INSERT", "INTO", "VALUES",
    "UPDATE", "SET", "DELETE", "CREATE", "ALTER", "DROP", "TABLE", "INDEX", "IF", "EXISTS", "ORDER",
    "BY", "GROUP", "HAVING", "LIMIT", "OFFSET", "UNION", "ALL", "DISTINCT", "BETWEEN", "LIKE",
    "ILIKE", "CASE", "WHEN", "THEN", "ELSE", "END", "ASC", "DESC", "WITH", "RECURSIVE", "RETURNING",
    "BEGIN", "COMMIT", "ROLLBACK", "EXPLAIN", "ANALYZE", "PRIMARY", "KEY", "FOREIGN", "REFERENCES",
    "CONSTRAINT", "DEFAULT", "CHECK", "UNIQUE", "CASCADE", "ADD", "COLUMN", "RENAME", "TO", "TRUE",
    "FALSE", "EXCEPT", "INTERSECT", "FETCH", "FIRST", "NEXT", "ROWS", "ONLY", "FOR", "SHARE", "NO",
    "WAIT", "SKIP", "LOCKED", "OVER", "PARTITION", "WINDOW",
)
FUNCTIONS = (
    "COUNT", "SUM", "AVG", "MIN", "MAX", "COALESCE", "NULLIF", "CAST", "NOW", "CURRENT_TIMESTAMP",
    "CURRENT_DATE", "CURRENT_TIME", "EXTRACT", "DATE_TRUNC", "LENGTH", "LOWER", "UPPER", "TRIM",
    "SUBSTRING", "CONCAT", "REPLACE", "ARRAY_AGG", "STRING_AGG", "JSON_AGG", "ROW_NUMBER", "RANK",
    "DENSE_RANK", "LEAD", "LAG", "FIRST_VALUE", "LAST_VALUE", "GREATEST", "LEAST", "ABS", "CEIL",
    "FLOOR", "ROUND", "RANDOM",
)
# Plan node names, longer names before the names they begin with or contain.
PLAN_NODES = (
    "Seq Scan", "Index Scan", "Index Only Scan", "Bitmap Heap Scan", "Bitmap Index Scan",
    "Incremental Sort", "Sort", "Hash Join", "Merge Join", "Nested Loop", "Hash", "WindowAgg",
    "Aggregate", "Group", "Limit", "Unique", "Gather Merge", "Gather", "Materialize", "Append",
    "Result", "Subquery Scan", "CTE Scan", "Function Scan", "Values Scan", "LockRows", "SetOp",
    "ModifyTable", "Table scan", "Index lookup", "Covering index", "Full scan", "ref", "range",
    "ALL", "index", "const",
)
# The lines that sum a plan up, and the words that open a group of measured values.
SUMMARY_LINES = ("Planning Time", "Execution Time", "Query time")
MEASURES = ("cost", "actual time", "loops", "width", "never executed")
PLAN_NODE = r"(?i)\b(" + "|".join(PLAN_NODES) + r")\b"
PLAN_SUMMARY = r"(?i)\A\s*(" + "|".join(SUMMARY_LINES) + "):"
PLAN_METRICS = r"\((?:" + "|".join(MEASURES) + r")[^)]*\)"
# One token of a text without string literals: parameter, number after an edge, or word.
TOKEN = r"\$[0-9]+|\?|(?:(?<=\A|[\s,=(><+\-])[0-9][0-9.]*)|[A-Za-z_][A-Za-z0-9_]*"


def sql_token_census(events: DataFrame, per: str = "normalized_query", query: str = "query") -> DataFrame:
    """Keywords, functions, strings, numbers and parameters counted per template.

    Texts are first counted, so that each distinct statement is taken apart once.
    """
    texts = events.groupBy(per, query).agg(F.count(F.lit(1)).alias("_copies"))
    strings = F.regexp_count(F.col(query), F.lit(STRING_LITERAL))
    bare = F.regexp_replace(F.col(query), STRING_LITERAL, "''")
    tokens = F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0))
    found = texts.select(per, "_copies", F.explode(tokens).alias("token"))
    first, word = F.substring("token", 1, 1), F.upper("token")
    kind = (
        F.when(first.isin("$", "?"), F.lit("parameter"))
        .when(first.rlike("[0-9]"), F.lit("number"))
        .when(word.isin(*KEYWORDS), F.lit("keyword"))
        .when(word.isin(*FUNCTIONS), F.lit("function"))
    )
    counted = found.select(per, kind.alias("kind"), F.col("_copies").alias("_n")).filter(F.col("kind").isNotNull())
    literals = texts.select(per, F.lit("string").alias("kind"), (F.col("_copies") * strings).alias("_n"))
    return (
        counted.unionByName(literals.filter(F.col("_n") > 0)).groupBy(per, "kind").agg(F.sum("_n").alias("n"))
    )


def plan_node_census(plans: DataFrame, column: str = "plan") -> DataFrame:
    """Plan nodes, lines with metrics and summary lines counted over stored plan texts."""
    lines = plans.select(F.explode(F.split(F.col(column), "\n")).alias("line"))
    summary = F.regexp_extract("line", PLAN_SUMMARY, 1)
    bare = F.regexp_replace("line", PLAN_METRICS, "")
    nodes = F.transform(
        F.regexp_extract_all(bare, F.lit(PLAN_NODE), F.lit(1)),
        lambda node: F.struct(F.lit("node").alias("kind"), F.lower(node).alias("name")),
    )
    metrics = F.when(
        F.col("line").rlike(PLAN_METRICS), F.array(F.struct(F.lit("metrics").alias("kind"), F.lit("").alias("name")))
    ).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))
    parts = F.when(
        summary != "", F.array(F.struct(F.lit("summary").alias("kind"), F.lower(summary).alias("name")))
    ).otherwise(F.concat(nodes, metrics))
    return lines.select(F.inline(parts)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))
