"""Result tables of streaming jobs, as folders of Parquet files that Spark writes and reads.

A batch that runs again after a failure writes its own part anew, so every event counts once. What jobs keep can be merged
in any order (sums, maxima, sketches, newest of a place), so nothing written is ever changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtflow.session import child_names, exists, remove

BATCH, PART = "batch", "part"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


class Parts:
    """Rows kept by the micro-batch that brought them."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.path, self.schema = path, schema
        # Something to read before the first batch has come.
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{BATCH}=-1")

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.select(*_names(self.schema)).write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch}")

    def of(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/{BATCH}={batch}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All parts, with the number of their batch."""
        return spark.read.schema(f"{self.schema}, {BATCH} bigint").parquet(self.path)


class Stretches:
    """Rows by a coarse stretch of their own (`part`), such as a minute, then by batch.

    A job reads only the stretches that a batch touches: what it reads depends on them, not on all that has come before.
    """

    #: Stretches that are read by name; for more, all are looked at and filtered.
    MOST_NAMED = 4096

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.path, self.schema = path, schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{PART}=0/{BATCH}=-1")

    def put(self, rows: DataFrame, batch: int) -> None:
        """Add rows, which also have a column `part`."""
        # One file a stretch, or several of like size where it is large.
        placed = rows.select(*_names(self.schema), PART, F.lit(batch).cast("bigint").alias(BATCH)).hint("rebalance", PART)
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(PART, BATCH).parquet(self.path)

    def rows(self, spark: SparkSession, parts: Iterable[int] | None = None) -> DataFrame:
        """The rows of some stretches, or of all, with `part` and `batch`."""
        reader = spark.read.schema(f"{self.schema}, {PART} bigint, {BATCH} bigint").option("basePath", self.path)
        if parts is None:
            return reader.parquet(self.path)
        parts = sorted(set(parts))
        if len(parts) > self.MOST_NAMED:
            return reader.parquet(self.path).join(spark.createDataFrame([(p,) for p in parts], f"{PART} bigint"), PART, "left_semi")
        known = [p for p in (f"{self.path}/{PART}={n}" for n in parts) if exists(spark, p)]
        return reader.parquet(*known) if known else reader.parquet(f"{self.path}/{PART}=0/{BATCH}=-1")


class Sums:
    """Partial aggregates by key, added batch by batch and folded into one table every few batches.

    `merges` names how each column that is no key is merged. Parts that a fold has taken in are removed with the next
    fold, so about 2 * `every` parts are there at any time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merges: dict[str, Callable[[str], Column]], every: int = 16):
        self.path, self.schema, self.merges, self.every = path, schema, merges, every
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/base=-1")

    def _merged(self, rows: DataFrame) -> DataFrame:
        names = _names(self.schema)
        keys = [n for n in names if n not in self.merges]
        return rows.groupBy(*keys).agg(*[merge(n).alias(n) for n, merge in self.merges.items()]).select(*names)

    def _whole(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of the parts of a kind that were written to the end."""
        found = [int(n.split("=")[1]) for n in child_names(spark, self.path) if n.startswith(f"{kind}=")]
        return sorted(n for n in found if exists(spark, f"{self.path}/{kind}={n}/_SUCCESS"))

    def _read(self, spark: SparkSession, before: int | None = None) -> tuple[DataFrame, int]:
        """The newest fold (before a batch, when given) with all later parts, and the fold's number."""
        base = max(n for n in self._whole(spark, "base") if before is None or n < before)
        later = [n for n in self._whole(spark, BATCH) if n > base and (before is None or n <= before)]
        paths = [f"{self.path}/base={base}", *[f"{self.path}/{BATCH}={n}" for n in later]]
        return spark.read.schema(self.schema).parquet(*paths), base

    def put(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        self._merged(rows.select(*_names(self.schema))).write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch}")
        if batch % self.every == self.every - 1:
            held, base = self._read(spark, batch)
            self._merged(held).write.mode("overwrite").parquet(f"{self.path}/base={batch}")
            # The last fold and its successors stay, in case this batch has to run again.
            for kind in ("base", BATCH):
                for n in self._whole(spark, kind):
                    if n < base or (kind == BATCH and n == base):
                        remove(spark, f"{self.path}/{kind}={n}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """Merged over all batches so far."""
        return self._merged(self._read(spark)[0])
