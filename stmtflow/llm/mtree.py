r"""Exact top-k inner-product search with an M-tree of paged metric nodes.

Metric. Vectors x get one more component, sqrt(M - |x|^2), with M the largest squared norm; queries get 0 there. Then
d(q, x)^2 = |q|^2 + M - 2 q.x, so the nearest are those with the largest inner products, in a metric space.

Index. Of equal vectors only the k + 1 with the smallest ids can be in an answer; Spark's rank limit drops the others
before they are shuffled. Pivots, a bounded sample (PIVOTS at most), are the routing objects of the root. Every
vector goes to its nearest pivot; crowded pivots are divided by a hash of the rows. Each part is a subtree, built in one
task from at most about PAGE * LEAF vectors: it is halved by two distant objects until pages of LEAF entries are left. A page
stores its routing object, covering radius and distance to its parent; its entries store theirs. Up to UNIT subtrees of
neighbouring pivots are a unit. Vectors are stored in the narrowest whole numbers that hold them.

Search. A query first looks into its home, the unit of its nearest pivot, which gives a floor for its k-th score. Then it is
routed to the other units that have a pivot whose covering ball may hold as good a score. In a unit it takes its FIRST_PAGES
best pages first, which lifts its k-th score, then the others whose balls can still reach that, nearest first. A page's
distance to the query is computed only if the stored distance to the parent does not already rule it out
(|d(q, p) - d(r, p)| - radius); entries are ruled out by theirs for all queries that look into the page. Bounds are
floored with SLACK, scores are whole numbers, so results are exact; ties go to smaller ids.

Queries are dealt in blocks of about BLOCK, neighbours together; units and blocks meet by key, and pages are sent only to blocks
that look into them. A task holds one unit and one block, and works through ROWS queries and CHUNK pages at a time, so memory is
bounded whatever the tables; the work grows with queries times vectors.

Vectors that are null or hold null or non-finite components, and null ids, take no part. Vectors of different lengths
are filled up with zeros. Repeated ids are candidates row by row, but not for a query with the same id. Fewer
candidates than k: all are returned. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.llm.common import Scratch, pieces
from stmtflow.llm.tokens import ranges

K = 20
PIVOTS = 4096
LEAF, PAGE, FIRST_PAGES = 32, 32, 2
#: Subtrees of a unit (fewer while there are less than WIDE units), and queries of a block.
UNIT, WIDE, BLOCK = 32, 64, 32_768
#: Queries and pages looked at together, distances to pivots computed together, and routed rows handed on together.
ROWS, CHUNK, CELLS, PIECE = 1024, 16, 1 << 20, 1 << 16
SLACK = 1e-6
#: Stands for a score not known yet.
NONE = -(2**63 - 1)

LEAVES = "unit bigint, pivot bigint, radius double, up double, routing binary, ids binary, down binary, vectors binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of whole numbers as the rows of a float matrix, filled up with zeros."""
    rows = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(rows):
        return np.zeros((0, dim))
    values, sizes = rows.flatten().to_numpy(zero_copy_only=False).astype(float), rows.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(len(rows), dim)
    out = np.zeros((len(rows), dim))
    out[np.repeat(np.arange(len(rows)), sizes), ranges(np.zeros(len(rows), np.int64), sizes)] = values
    return out


def stored_type(most: int) -> np.dtype:
    """The narrowest whole numbers that hold components of up to `most`."""
    return next((np.dtype(t) for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.dtype(np.int64))


def exact_type(most: int, dim: int) -> np.dtype:
    """Numbers in which inner products of components of up to `most` are exact."""
    bound = most * most * dim
    return np.dtype(np.float32 if bound < 2**24 else np.float64 if bound < 2**52 else np.int64)


def packed(x: np.ndarray, kind: np.dtype) -> pa.Array:
    """The rows of a matrix as bytes."""
    size, data = x.shape[1] * kind.itemsize, np.ascontiguousarray(x, kind)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def lifted(x: np.ndarray, biggest: float) -> np.ndarray:
    """Add the component that makes all norms equal."""
    return np.column_stack([x, np.sqrt(np.maximum(biggest - (x * x).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def whole_vectors(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v): floor(64 * x) of the rows that take part."""
    scaled = F.transform(column, lambda x: F.floor(x.cast("double") * 64))
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(column).isNotNull() & F.col(key).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(key).cast("bigint").alias("vec_id"), scaled.cast("array<bigint>").alias("v")
    )


def split_pages(x: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Halve rows by two distant objects until at most `most` are together."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        own = x[rows]
        first = int(np.argmax(distances(own[:1], own)[0]))
        from_first = distances(own[first : first + 1], own)[0]
        second = int(np.argmax(from_first))
        closer = from_first - distances(own[second : second + 1], own)[0]
        order = np.argsort(closer, kind="stable")
        half = int((closer < 0).sum())
        half = min(max(half, len(rows) // 4), len(rows) - len(rows) // 4)
        open_ += [rows[order[:half]], rows[order[half:]]]
    return done


def build(rows: pa.Table, pivots: np.ndarray, kind: np.dtype, biggest: float) -> pa.Table:
    """The leaf pages of one subtree."""
    ids, x = rows.column("vec_id").to_numpy(), unpacked(rows.column("x"), kind, pivots.shape[1] - 1)
    order = np.lexsort((ids,))
    ids, x = ids[order], x[order]
    unit, at = rows.column("unit")[0].as_py(), rows.column("pivot")[0].as_py()
    high = lifted(x.astype(float), biggest)
    out = {c.split()[0]: [] for c in LEAVES.split(", ")}
    for page in split_pages(high):
        own = high[page]
        middle = int(np.argmin(distances(own, own).max(axis=1)))
        down = distances(own[middle : middle + 1], own)[0]
        up = float(np.linalg.norm(own[middle] - pivots[at]))
        values = (unit, at, float(down.max()), up, own[middle].tobytes(), ids[page].tobytes(), down.tobytes(), x[page].tobytes())
        for column, value in zip(out.values(), values):
            column.append(value)
    return pa.table(out)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to the pivots) of a bounded number of rows at a time."""
    step = max(1, CELLS // len(pivots))
    for lo in range(0, len(x), step):
        yield lo, distances(x[lo : lo + step], pivots)


class Pages:
    """The leaf pages of a unit as arrays; entries of a page are neighbours."""

    def __init__(self, leaves: pa.Table, pivots: np.ndarray, kind: np.dtype, exact: np.dtype):
        wide = pivots.shape[1]
        self.routing = unpacked(leaves.column("routing"), np.dtype(float), wide)
        self.parents, self.parent = np.unique(leaves.column("pivot").to_numpy(), return_inverse=True)
        self.radius, self.up = leaves.column("radius").to_numpy(), leaves.column("up").to_numpy()
        whole = lambda c, t: np.frombuffer(b"".join(leaves.column(c).to_pylist()), t)
        self.ids, self.down = whole("ids", np.int64), whole("down", float)
        self.x = whole("vectors", kind).reshape(-1, wide - 1).astype(exact)
        self.size = np.array([len(i) // 8 for i in leaves.column("ids").to_pylist()])
        self.start = np.cumsum(self.size) - self.size
        self.page = np.repeat(np.arange(len(self.size)), self.size)


class Best:
    """The best k (score, id) of some queries so far; scores fall, ids of equal scores rise."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.who = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        rows, at = np.unique(row, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        scores, who = np.concatenate([self.score[rows].reshape(-1), score]), np.concatenate([self.who[rows].reshape(-1), ids])
        order = np.lexsort((who, -scores, place))
        begin = np.concatenate([[0], np.cumsum(np.bincount(place))[:-1]])
        kept = order[begin[:, None] + np.arange(self.k)]
        self.score[rows], self.who[rows] = scores[kept], who[kept]


def look(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, pages: Pages, pivots: np.ndarray, biggest: float, k: int) -> Best:
    """The best k entries of a unit for each of a few queries that reach its floor."""
    n, m = len(ids), len(pages.size)
    high = np.column_stack([q.astype(float), np.zeros(n)])
    square = (high * high).sum(axis=1)
    slack = SLACK * (1 + math.sqrt(float(square.max()) + biggest))
    best = Best(n, k)

    def needed() -> tuple[np.ndarray, np.ndarray]:
        """The least score that still counts, and the largest distance that gives it, for each query."""
        need = np.maximum(floor, best.score[:, -1])
        return need, np.where(need == NONE, np.inf, np.sqrt(np.maximum(square + biggest - 2 * need.astype(float), 0)) + slack)

    need, limit = needed()
    # Stored distances to the parent rule pages out before anything is computed for them.
    to_parent = distances(high, pivots[pages.parents])[:, pages.parent]
    left = np.abs(to_parent - pages.up) - pages.radius <= limit[:, None]
    at = np.flatnonzero(left.any(axis=0))
    far = np.zeros((n, m))
    far[:, at] = distances(high, pages.routing[at])
    nearest = np.where(left, np.maximum(far - pages.radius, 0), np.inf)

    # Each query's best pages set its bound.
    for _ in range(min(FIRST_PAGES, m)):
        page = nearest.argmin(axis=1)
        go = np.flatnonzero(nearest[np.arange(n), page] <= limit)
        go = go[left[go, page[go]]]
        page = page[go]
        entry = pages.start[page][:, None] + np.arange(int(pages.size[page].max(initial=0)))
        real = np.arange(entry.shape[1]) < pages.size[page][:, None]
        entry = np.where(real, entry, 0)
        score = np.einsum("qd,qed->qe", q[go], pages.x[entry])
        row, col = np.nonzero(real & (score >= need[go][:, None]) & (pages.ids[entry] != ids[go][:, None]))
        best.add(go[row], pages.ids[entry[row, col]], score[row, col].astype(np.int64))
        left[go, page], nearest[go, page] = False, np.inf
        need, limit = needed()

    # Then the pages that still matter, the generally nearest first.
    order = np.argsort(nearest.min(axis=0), kind="stable")
    for lo in range(0, m, CHUNK):
        some = order[lo : lo + CHUNK]
        open_ = nearest[:, some] <= np.where(np.isfinite(limit), limit, np.finfo(float).max)[:, None]
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            continue
        # Entries that the distances to their page's routing object rule out for every query are left.
        inner = np.where(open_, far[:, some] - limit[:, None], np.inf).min(axis=0)
        outer = np.where(open_, far[:, some] + limit[:, None], -np.inf).max(axis=0)
        entry, which = ranges(pages.start[some], pages.size[some]), np.repeat(np.arange(len(some)), pages.size[some])
        use = (pages.down[entry] >= inner[which]) & (pages.down[entry] <= outer[which])
        entry, which = entry[use], which[use]
        score = (q if len(rows) == n else q[rows]) @ pages.x[entry].T
        row, col = np.nonzero(score >= need[rows].astype(score.dtype)[:, None])
        sound = open_[rows[row], which[col]] & (pages.ids[entry[col]] != ids[rows[row]])
        row, col = row[sound], col[sound]
        if len(row):
            best.add(rows[row], pages.ids[entry[col]], score[row, col].astype(np.int64))
            need, limit = needed()
    return best


def search(queries: pa.Table, leaves: pa.Table, pivots: np.ndarray, kind: np.dtype, exact: np.dtype, biggest: float, k: int) -> pa.Table:
    """The best k of a unit's entries for each query that reach its floor."""
    found = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})]
    if not queries.num_rows or not leaves.num_rows:
        return found[0]
    pages = Pages(leaves, pivots, kind, exact)
    ids, floor = queries.column("vec_id").to_numpy(), queries.column("floor").to_numpy()
    q = unpacked(queries.column("x"), kind, pivots.shape[1] - 1)
    for lo in range(0, len(ids), ROWS):
        own = ids[lo : lo + ROWS]
        best = look(own, q[lo : lo + ROWS].astype(exact), floor[lo : lo + ROWS], pages, pivots, biggest, k)
        known = best.score != NONE
        found.append(pa.table({"query_id": np.repeat(own, known.sum(axis=1)), "vec_id": best.who[known], "score": best.score[known]}))
    return pa.concat_tables(found).combine_chunks()


def top_k(vectors: DataFrame, is_query, k: int = K, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    rows = scratch(whole_vectors(vectors, column, key), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    high, low = F.max(F.array_max("v")), F.min(F.array_min("v"))
    n, dim, biggest, high, low = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm), high, low).first()
    if not n or not dim:
        pairs = rows.filter(is_query).select(F.col("vec_id").alias("query_id")).join(rows.select("vec_id"), F.col("query_id") != F.col("vec_id"))
        if n:
            return scratch.finish(ranked(pairs.withColumn("score", F.lit(0).cast("bigint")), k))
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    most = max(high, -low, 1)
    kind, exact = stored_type(most), exact_type(most, dim)
    copies = Window.partitionBy("hash", "v").orderBy("vec_id")
    kept = rows.withColumn("hash", F.xxhash64("v")).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1)
    kept = scratch(kept.select("vec_id", "v"), "vectors")
    count = kept.count()
    wanted = min(PIVOTS, pieces(count, LEAF * PAGE))
    chosen = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").toArrow().column("v")
    pivots = lifted(np.unique(matrix(chosen, dim), axis=0), biggest)
    # Neighbours have neighbouring numbers.
    pivots = pivots[np.concatenate(split_pages(pivots))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, far in nearest_pivots(lifted(matrix(batch.column(1), dim), biggest), pivots):
                own, at = batch.slice(lo, len(far)), far.argmin(axis=1)
                columns = [own.column(0), packed(matrix(own.column(1), dim), kind), pa.array(at), pa.array(far[np.arange(len(at)), at])]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "pivot", "far"])

    assigned = scratch(kept.mapInArrow(assign, "vec_id bigint, x binary, pivot bigint, far double"), "assigned")
    # One row per pivot: at most PIVOTS.
    sizes = {r[0]: (r[1], r[2]) for r in assigned.groupBy("pivot").agg(F.count(F.lit(1)), F.max("far")).collect()}
    parts = np.array([pieces(sizes.get(p, (0, 0))[0], LEAF * PAGE) for p in range(len(pivots))])
    radii = np.array([sizes.get(p, (0, -np.inf))[1] for p in range(len(pivots))])
    start = np.cumsum(parts) - parts
    subs = int(parts.sum())
    each = min(UNIT, max(1, subs // WIDE))
    units = pieces(subs, each)
    # Pivots first[u] to last[u] have subtrees in unit u.
    first = np.searchsorted(start, np.arange(units) * each, side="right") - 1
    last = np.searchsorted(start, np.minimum((np.arange(units) + 1) * each, subs) - 1, side="right") - 1
    counts = spark.createDataFrame([(i, int(s), int(p)) for i, (s, p) in enumerate(zip(start, parts))], "pivot bigint, start bigint, parts int")
    sub = F.col("start") + F.pmod(F.xxhash64("vec_id", "x"), F.col("parts"))
    placed = assigned.join(F.broadcast(counts), "pivot").withColumn("sub", sub).withColumn("unit", F.floor(F.col("sub") / each))
    leaves = placed.select("sub", "unit", "pivot", "vec_id", "x").groupBy("sub").applyInArrow(lambda t: build(t, pivots, kind, biggest), LEAVES)
    leaves = scratch(leaves, "leaf-pages")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), dim)
            for lo, far in nearest_pivots(np.column_stack([q, np.zeros(len(q))]), pivots):
                own = batch.slice(lo, len(far))
                home = start[np.where(np.isfinite(radii), far, np.inf).argmin(axis=1)] // each
                yield pa.RecordBatch.from_arrays([own.column(0), packed(q[lo : lo + len(far)], kind), pa.array(home)], names=["vec_id", "x", "home"])

    queries = scratch(rows.filter(is_query).select("vec_id", "v").mapInArrow(at_home, "vec_id bigint, x binary, home bigint"), "queries")
    # One row per unit. Blocks follow the homes; a crowded home has several.
    asked = sorted((r[0], r[1]) for r in queries.groupBy("home").count().collect())
    before = np.cumsum([c for _, c in asked]) - [c for _, c in asked]
    homes = spark.createDataFrame([(h, int(b), c) for (h, c), b in zip(asked, before)], "home bigint, before bigint, size bigint")
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("vec_id", "x"), F.col("size"))) / BLOCK)
    dealt = queries.join(F.broadcast(homes), "home").select("vec_id", "x", "home", block.alias("block"))

    def route(only_pairs: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = unpacked(batch.column(1), kind, dim).astype(float)
                floors, homes, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("floor", "home", "block"))
                for lo, far in nearest_pivots(np.column_stack([q, np.zeros(len(q))]), pivots):
                    own = slice(lo, lo + len(far))
                    square, floor = (q[own] * q[own]).sum(axis=1), floors[own]
                    limit = np.sqrt(np.maximum(square + biggest - 2 * floor.astype(float), 0)) + SLACK * (1 + np.sqrt(square + biggest))
                    reached = (np.maximum(far - radii, 0) <= np.where(floor == NONE, np.finfo(float).max, limit)[:, None]).cumsum(axis=1)
                    use = reached[:, last] > np.where(first > 0, reached[:, first - 1], 0)
                    use[np.arange(len(far)), homes[own]] = False
                    row, unit = np.nonzero(use)
                    if only_pairs:
                        pair = np.unique(blocks[own][row] * units + unit)
                        yield pa.RecordBatch.from_arrays([pa.array(pair % units), pa.array(pair // units)], names=["unit", "block"])
                        continue
                    for piece in range(0, len(row), PIECE):
                        at = pa.array(row[piece : piece + PIECE] + lo)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(unit[piece : piece + PIECE]), *(batch.column(c).take(at) for c in ("block", "vec_id", "x", "floor"))],
                            names=["unit", "block", "vec_id", "x", "floor"],
                        )

        return run

    def looked(routed: DataFrame, pairs: DataFrame) -> DataFrame:
        sent = leaves.join(F.broadcast(pairs), "unit").groupBy("unit", "block")
        return routed.groupBy("unit", "block").cogroup(sent).applyInArrow(lambda a, b: search(a, b, pivots, kind, exact, biggest, k), FOUND)

    none = F.lit(NONE).cast("bigint")
    own = dealt.select(F.col("home").alias("unit"), "block", "vec_id", "x", none.alias("floor"))
    pairs = own.groupBy(F.col("unit").alias("unit"), F.col("block").alias("block")).agg(F.lit(1)).select("unit", "block")
    near = scratch(ranked(looked(own, pairs), k), "near")
    floors = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    known = dealt.join(floors, "vec_id", "left").select("vec_id", "x", "home", "block", F.coalesce("floor", none).alias("floor"))
    pairs = known.mapInArrow(route(True), "unit bigint, block bigint").distinct()
    more = looked(known.mapInArrow(route(False), "unit bigint, block bigint, vec_id bigint, x binary, floor bigint"), pairs)
    return scratch.finish(ranked(near.select("query_id", "vec_id", "score").unionByName(more), k))


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
