"""Small helpers of several operators."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.plans.materialize import materialize
from stmtflow.session import work_dir

SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column | str) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column | str) -> Column:
    """Number of runs of characters other than white space (space, U+0009 to U+000D); null counts 0."""
    cut = F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), SPACES)
    return (F.size(cut) - F.when(cut[0] == "", 1).otherwise(0) - F.when((F.size(cut) > 1) & (F.element_at(cut, -1) == ""), 1).otherwise(0)).cast("bigint")


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents whose labels no model may see."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % 5 == 0


def pieces(amount: int, each: int, least: int = 1) -> int:
    """Number of pieces of about `each` that make up `amount`."""
    return max(least, math.ceil(amount / each))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids (8 bytes each) that may be sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of rows with a stored table of ids; wide rows stay where they are while the ids are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


class Scratch:
    """Intermediate tables of one operator, in a folder of its own below the shared one.

    Called with a frame it writes it and gives back the table read from there. `finish` keeps one last table, written
    elsewhere, and removes the folder; `drop` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose = spark, purpose
        self.folder, self.number = work_dir(spark, f"{purpose}-scratch"), 0
        self.places: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame, name: str = "table") -> DataFrame:
        self.number += 1
        path = os.path.join(self.folder, f"{self.number:03d}-{name}")
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.places.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self.places:
            if any(table is t for t in tables):
                remove(self.spark, path)

    def finish(self, df: DataFrame) -> DataFrame:
        kept = materialize(df, self.purpose)
        self.clear()
        return kept

    def clear(self) -> None:
        """Remove all of it, when nothing reads it any more."""
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this program's own, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
