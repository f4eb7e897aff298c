"""Vectors of whole numbers, shared by the operators that fit something to all vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole components are below this, so that a float holds them exactly.
MOST = 1 << 53


def whole(vector: Column | str, scale: int) -> Column:
    """floor(scale * component) of each component as a double; too large a component ends the query with a message."""

    def number(c: Column) -> Column:
        scaled = c.cast("double") * scale
        return F.when(F.abs(scaled) < float(MOST), F.floor(scaled)).otherwise(F.raise_error(F.lit("a vector component is too large")))

    return F.transform(vector, number).cast("array<bigint>")


def sound(vector: Column | str) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The length that most sound vectors have, of several the largest; 0 if there is none."""
    lengths = vectors.filter(sound(f"`{column}`")).groupBy(F.size(f"`{column}`").alias("length")).count()
    most = lengths.orderBy(F.col("count").desc(), F.col("length").desc()).first()
    return most.length if most else 0


def whole_rows(vectors: DataFrame, column: str, scale: int, dim: int, keep: list[str]) -> DataFrame:
    """(_c0, _c1, ..., x): the kept columns and the whole vector of the rows that take part."""
    fits = vectors.filter(sound(f"`{column}`") & (F.size(f"`{column}`") == dim))
    return fits.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], whole(f"`{column}`", scale).alias("x"))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of `dim` whole numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)
