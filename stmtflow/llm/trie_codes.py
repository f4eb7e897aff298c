"""Vector codes by product quantisation, assigned along a lexicographic trie of the distinct parts.

Components become whole numbers floor(scale * c), and vectors are cut into equal consecutive parts. Each part position has a
codebook, which starts as that part of the vectors with the smallest ids. Rounds assign every part to its nearest entry and
replace entries by the floored mean of their parts. All numbers are whole, so results do not depend on how rows are dealt.

Trie: the distinct parts of a position, in lexicographic order, are the leaves of a trie whose levels are the dimensions. Its
depth-first traversal reads the parts in order. A node's vector of accumulated squared distances to all entries is its
parent's plus one dimension, and is worked out once for all parts below; a leaf takes its smallest entry (the first, if
several are) and adds its part, times the number of vectors that hold it, to that entry's sum. RUN leaves are
taken at a time: runs follow one another depth first, the nodes of a run are worked out one dimension after the other.

Spark counts the distinct parts, first within tasks, so a part that a third of all vectors share is one row; deals them by
ranges of (position, part), so that common prefixes stay together; and stores them once for all rounds. A round is one pass
over that table; a task gives at most one sum for each entry and dimension. Codebooks, entries * dimensions numbers, are all that
the driver holds. At the end the rows themselves are coded, each batch along the trie of its own distinct parts.

Vectors that are null or hold null or non-finite components are dropped, and those whose length is not that of most. A length
that the parts do not divide is filled up with zeros, which change no distance. Equal ids among the first are taken by vector,
null ids last. Fewer vectors than entries: as many entries as vectors. Repeated rows count and are coded row by row. An empty
table gives an empty result. Columns of the added names in the input are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtflow.llm.common import Scratch
from stmtflow.llm.vectors import common_length, rows_of, whole_rows

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
RUN = 8192
ADDED = ("code", "error")


def walk(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of parts in lexicographic order, along their trie."""
    codes, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for lo in range(0, len(parts), RUN):
        run = parts[lo : lo + RUN]
        changes = np.zeros(len(run), bool)
        changes[:1] = True
        node, sums = np.zeros(len(run), np.int64), np.zeros((1, len(book)), np.int64)
        for t in range(run.shape[1]):
            # A new node begins where this dimension changes or a node above does.
            changes[1:] |= run[1:, t] != run[:-1, t]
            first = np.flatnonzero(changes)
            sums = sums[node[first]] + (run[first, t][:, None] - book[:, t]) ** 2
            node = np.cumsum(changes) - 1
        best = sums.argmin(axis=1)
        codes[lo : lo + RUN], errors[lo : lo + RUN] = best[node], sums[np.arange(len(best)), best][node]
    return codes, errors


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for parts in any order."""
    order = np.lexsort(parts.T[::-1])
    codes, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    codes[order], errors[order] = walk(parts[order], book)
    return codes, errors


@dataclass(frozen=True)
class Codebooks:
    """`books[position]` holds that position's entries."""

    books: list[list[list[int]]]

    @property
    def sha256(self) -> str:
        """Digest of all entries' components in decimal, by position, entry and place, joined by commas."""
        numbers = [str(v) for book in self.books for entry in book for v in entry]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The vector that a code stands for."""
        return [v for i, book in enumerate(self.books) for v in book[int(code[2 * i : 2 * i + 2], 16)]]


def _first_books(rows: DataFrame, parts: int, width: int, entries: int) -> list[list[list[int]]]:
    """Codebooks of the vectors with the smallest ids."""
    first = [r.x for r in rows.orderBy(F.col("_id").asc_nulls_last(), "x").select("x").limit(entries).collect()]
    return [[x[p * width : (p + 1) * width] for x in first] for p in range(parts)]


def _sums(leaves: DataFrame, books: list[list[list[int]]], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(number, component sums) of the parts that each entry is nearest to, of one traversal."""
    tables = [np.array(b, np.int64).reshape(-1, width) for b in books]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(t), np.int64) for t in tables]
        totals = [np.zeros((len(t), width), np.int64) for t in tables]
        for batch in batches:
            position = batch.column("position").to_numpy(zero_copy_only=False)
            part, weight = rows_of(batch.column("part"), width), batch.column("weight").to_numpy(zero_copy_only=False)
            for p in np.unique(position):
                own = position == p
                codes, _ = walk(part[own], tables[p])
                np.add.at(counts[p], codes, weight[own])
                np.add.at(totals[p], codes, part[own] * weight[own][:, None])
        keys = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
        columns = [
            pa.array([p for p, _ in keys], pa.int32()),
            pa.array([int(e) for _, e in keys], pa.int32()),
            pa.array([int(counts[p][e]) for p, e in keys], pa.int64()),
            pa.array([totals[p][e].tolist() for p, e in keys], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["position", "entry", "n", "sums"])

    found = leaves.mapInArrow(step, "position int, entry int, n bigint, sums array<bigint>")
    whole = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = found.groupBy("position", "entry").agg(F.sum("n").alias("n"), *whole).collect()
    return {(r.position, r.entry): (r.n, [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def encode(
    vectors: DataFrame,
    column: str = "embedding",
    key: str = "vec_id",
    keep: list[str] | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """Rows with `code`, two hex digits a part, and `error`, the squared distance to what it stands for; and the codebooks.

    `keep` names the columns that stay, else all but those of the added names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a part's code has two hex digits: 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    names = [c for c in (vectors.columns if keep is None else keep) if c not in ADDED]
    dim = common_length(vectors, column)
    width = -(-dim // parts)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), parts * width - dim)) if parts * width > dim else F.col("x")
    rows = whole_rows(vectors, column, scale, dim, [*names, key]).withColumnRenamed(f"_c{len(names)}", "_id").withColumn("x", padded)
    if not dim:
        empty = rows.limit(0).drop("x", "_id").withColumns({"code": F.lit(""), "error": F.lit(0).cast("bigint")})
        return scratch.finish(empty.toDF(*names, *ADDED)), Codebooks([])
    rows = scratch(rows, "rows")
    cut = F.array(*[F.slice("x", p * width + 1, width) for p in range(parts)])
    counted = rows.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight"))
    leaves = scratch(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "leaves")
    books = _first_books(rows, parts, width, entries)
    for _ in range(rounds):
        found = _sums(leaves, books, width)
        books = [
            [[s // found[p, e][0] for s in found[p, e][1]] if (p, e) in found else entry for e, entry in enumerate(book)]
            for p, book in enumerate(books)
        ]
    tables = [np.array(b, np.int64).reshape(-1, width) for b in books]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column("x"), parts * width)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, table in enumerate(tables):
                own, distance = nearest(x[:, p * width : (p + 1) * width], table)
                codes[:, p], error = own, error + distance
            digits = codes.tobytes().hex()
            texts = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            own = [batch.column(f"_c{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array(error)], [*[f"_c{i}" for i in range(len(names))], *ADDED])

    schema = rows.drop("x", "_id").schema.add("code", T.StringType()).add("error", T.LongType())
    return scratch.finish(rows.drop("_id").mapInArrow(code, schema).toDF(*names, *ADDED)), Codebooks(books)


#: Labels that may be sent to every task; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add `label_error`, the error summed over equal labels; nulls are one label."""
    sums = coded.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col(f"`{label}`").eqNullSafe(F.col("_label"))).drop("_label")
