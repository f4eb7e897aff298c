r"""Near-duplicates by an LSH forest over MinHash signatures, links confirmed on whole sets.

A document's set holds its distinct runs of WIDTH words as 64-bit hashes. Documents with equal sets are one class,
found by a 128-bit key and stood for by its smallest id. Each class has TREES * DEPTH minimum hashes; each tree orders
the classes by its DEPTH values. In every order, candidates are neighbours that share a prefix of at least LEAST values:

- each class with the next REACH ones;
- each class with the first of its region, for the regions of every depth from LEAST on, so a dense region is
  refined by going deeper while its members stay joined to a centre; centres differ from tree to tree.

Orders are cut by range partitioning, which follows the values down to full depth and so divides dense regions; the
rows at the borders of the ranges are paired in a step of their own. A pair's number of candidates is linear in the
classes, whatever the size of a region.

Candidates are confirmed on the whole sets, taken anew from the texts, by 100 * common >= PERCENT * union. First only each
class's best candidates are; then, with the components these give, the candidates between components, until none is
left. Pairs inside a component need no confirmation: they change nothing. Then classes that proved nearly similar
to a member of another component (by at most 2 * (100 - PERCENT) per cent, as a common link would have it) are compared
with all of that component, in blocks; this finds most links that neighbours and centres of a large region miss.

At last an exact join finds every link between components that is still missing, whatever the forest met. Shingles have
one order for all classes, rarest first. Linked classes share a shingle among the first (100 - PERCENT) per cent of the
larger one and the first part of the smaller one that a link to no smaller class must reach; classes of different
components that do are confirmed on whole sets. The order only decides how many pairs that are: frequencies come from
ORDER_TEXTS classes, and any order gives the same links. A passage shared by classes that are not linked stays out of
the smaller one's part, and members of one component are never paired.

Null and empty texts have empty sets and are linked with nothing; texts of fewer than WIDTH words have one shingle, all
of their words. Null ids are classes of their own. Rows with equal ids and texts are in one class; each is returned.
Texts are read whole; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtflow.llm.common import Scratch, by_ids, pieces
from stmtflow.llm.components import components
from stmtflow.llm.tokens import SPACE, mixed, ranges, runs_of, small_batches, words_of

WIDTH = 4
PERCENT = 80
TREES, DEPTH, LEAST, REACH = 16, 7, 3, 2
RANGE_ROWS = 250_000
#: Per cent below PERCENT that count as nearly similar: what is linked to one class is at most 2 * (100 - PERCENT) apart.
NEAR = 20
BLOCK_TEXTS = 512
#: Classes whose shingles are counted for the order of the exact join, and frequent shingles that are sent to every task.
ORDER_TEXTS, ORDER_SHINGLES = 50_000, 1_000_000
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, size=(2, TREES * DEPTH), dtype=np.int64).astype(np.uint64)
FACTORS, SHIFTS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1]

SIGNED = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, forest array<bigint>"


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    words = words_of(texts, SPACE)
    hashes, first = words.hashes(), words.first()
    runs = runs_of(hashes, width)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            sets.append(runs_of(hashes[a:b], b - a))
        else:
            sets.append(hashes[:0])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate([*sets, hashes[:0]]), at


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum hashes of the sets that are not empty, a row each."""
    heads = at[:-1][np.diff(at) > 0]
    out = np.empty((len(heads), TREES * DEPTH), np.uint32)
    for k in range(TREES * DEPTH):
        h = sets * FACTORS[k]
        h += SHIFTS[k]
        h >>= np.uint64(32)
        out[:, k] = np.minimum.reduceat(h, heads) if len(heads) else 0
    return out


def forest_keys(signs: np.ndarray) -> np.ndarray:
    """For each tree: a hash of the first LEAST values, then the others two by two, as int64 that keep their order."""
    values = signs.reshape(len(signs), TREES, DEPTH).astype(np.uint64)
    region = np.zeros((len(signs), TREES), np.uint64) + np.arange(TREES, dtype=np.uint64)
    for d in range(LEAST):
        region = mixed(region * np.uint64(0xD6E8FEB86659FD93) + values[:, :, d])
    pair = lambda a, b: (values[:, :, a] << np.uint64(31)) ^ (values[:, :, b] >> np.uint64(1))
    keys = np.stack([region.view(np.int64), pair(3, 4).view(np.int64), pair(5, 6).view(np.int64)], axis=2)
    return keys.reshape(len(signs), TREES * 3)


def signed(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """SIGNED rows; keys and forest are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 20):
            sets, at = shingle_sets(batch.column(1), width)
            sizes = np.diff(at)
            some = sizes > 0
            heads = at[:-1][some]
            k1, k2, forest = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [None] * len(sizes)
            if len(heads):
                k1[some] = np.add.reduceat(mixed(sets), heads).view(np.int64)
                k2[some] = np.add.reduceat(mixed(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), heads).view(np.int64)
                for i, row in zip(np.flatnonzero(some).tolist(), forest_keys(signatures(sets, at))):
                    forest[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(k1, mask=~some), pa.array(k2, mask=~some), pa.array(forest, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "k1", "k2", "forest"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(run, SIGNED)


PAIR = "a bigint, b bigint, depth int, edge boolean, tree_region bigint, o1 bigint, o2 bigint, side int"


def common_depth(region: np.ndarray, o1: np.ndarray, o2: np.ndarray) -> np.ndarray:
    """Values shared by each row and the next; 0 if not even the region is."""
    out = np.zeros(max(len(region) - 1, 0), np.int64)
    same = region[1:] == region[:-1]
    out[same] = LEAST
    for part, (first, second) in ((o1, (4, 5)), (o2, (6, 7))):
        same = same & ((part[1:] >> 31) == (part[:-1] >> 31))
        out[same] = first
        same = same & (part[1:] == part[:-1])
        out[same] = second
    return out


def neighbours(ids: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a, b, depth) of rows in order, of which each shares `depth` values with the next."""
    found, n = [], len(ids)
    low = depth
    for step in range(1, REACH + 1):
        if step > 1:
            low = np.minimum(low[:-1], depth[step - 1 :])
        at = np.flatnonzero(low >= LEAST)
        found.append((ids[at], ids[at + step], low[at]))
    for level in sorted({LEAST, 4, 5, DEPTH}):
        new = np.concatenate([[True], depth < level])
        head = np.flatnonzero(new)
        own = head[np.cumsum(new) - 1]
        at = np.flatnonzero(own != np.arange(n))
        found.append((ids[own[at]], ids[at], np.full(len(at), level)))
    a, b, d = (np.concatenate(x) for x in zip(*found))
    return np.minimum(a, b), np.maximum(a, b), d


def walk_orders(trees: DataFrame, scratch: Scratch, range_rows: int | None = None) -> DataFrame:
    """(a, b, depth, trees): candidate pairs of all orders; trees is how often a pair was met."""
    ordered = trees.repartitionByRange(pieces(trees.count(), range_rows or RANGE_ROWS, 8), "region", "o1", "o2", "doc_id").sortWithinPartitions("region", "o1", "o2", "doc_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        region, o1, o2, ids = (rows.column(c).to_numpy() for c in ("region", "o1", "o2", "doc_id"))
        a, b, d = neighbours(ids, common_depth(region, o1, o2))
        other = a != b
        a, b, d = a[other], b[other], d[other]
        edge = np.unique(np.concatenate([np.arange(min(REACH, len(ids))), np.arange(max(0, len(ids) - REACH), len(ids))]))
        # The first row of the region that a range ends in stands for it at the border, too.
        edge = np.unique(np.concatenate([edge, [np.flatnonzero(region == region[-1])[0]]]))
        n, m = len(a), len(edge)
        none = np.zeros(n, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a, ids[edge]])),
                pa.array(np.concatenate([b, ids[edge]])),
                pa.array(np.concatenate([d, none[:0], np.zeros(m, np.int64)]).astype(np.int32)),
                pa.array(np.arange(n + m) >= n),
                pa.array(np.concatenate([none, region[edge]])),
                pa.array(np.concatenate([none, o1[edge]])),
                pa.array(np.concatenate([none, o2[edge]])),
                pa.array(np.zeros(n + m, np.int32)),
            ],
            names=[c.split()[0] for c in PAIR.split(", ")],
        )

    walked = scratch(ordered.mapInArrow(walk, PAIR), "forest-pairs")
    # A few rows per range: neighbours across borders.
    border = Window.partitionBy("tree_region").orderBy("o1", "o2", "a")
    edges = walked.filter("edge").select("a", "tree_region", "o1", "o2").distinct()
    across = [
        edges.select("a", F.lead("a", k).over(border).alias("b")).filter("b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(LEAST).alias("depth"))
        for k in range(1, 2 * REACH + 2)
    ]
    pairs = walked.filter("not edge").select("a", "b", "depth")
    for more in across:
        pairs = pairs.union(more)
    return pairs.groupBy("a", "b").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("trees"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b, link) of the pairs whose whole sets are similar enough (link) or nearly so."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 2 << 20):
            x, x_at = shingle_sets(batch.column(2), width)
            y, y_at = shingle_sets(batch.column(3), width)
            near, link = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                n, m = len(p), len(q)
                if 100 * min(n, m) >= (percent - NEAR) * max(n, m):
                    whole = np.sort(np.concatenate([p, q]))
                    common = int((whole[1:] == whole[:-1]).sum())
                    near[i] = 100 * common >= (percent - NEAR) * (n + m - common)
                    link[i] = 100 * common >= percent * (n + m - common)
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(link[near])], names=["a", "b", "link"])

    return both.mapInArrow(check, "a bigint, b bigint, link boolean")


def block_links(left: pa.Table, right: pa.Table, width: int, percent: int) -> pa.Table:
    """All links between two blocks of whole texts, counted through the blocks' sorted shingles."""
    x, x_at = shingle_sets(left.column("text").combine_chunks(), width)
    y, y_at = shingle_sets(right.column("text").combine_chunks(), width)
    order = np.argsort(y, kind="stable")
    sizes = np.diff(y_at)
    known, owner = y[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    a, b = [], []
    ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
    for i in range(len(ids)):
        own = x[x_at[i] : x_at[i + 1]]
        low, high = np.searchsorted(known, own), np.searchsorted(known, own, side="right")
        common = np.bincount(owner[ranges(low, high - low)], minlength=len(sizes))
        hit = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (others != ids[i]))
        a.append(np.full(len(hit), ids[i]))
        b.append(others[hit])
    none = [np.zeros(0, np.int64)]
    return pa.table({"a": np.concatenate(none + a), "b": np.concatenate(none + b)})


def settle(near: DataFrame, found: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links of classes that are nearly similar to a member of another component, to any member of it.

    If x is linked to some y, it is nearly similar to whatever y is linked to. Such classes are few; each is
    compared with the whole of the component, block by block. None if there are none.
    """
    label = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    told = near.join(label("a"), "a", "left").join(label("b"), "b", "left")
    told = told.select("a", "b", F.coalesce("c_a", "a").alias("c_a"), F.coalesce("c_b", "b").alias("c_b")).filter("c_a <> c_b")
    told = scratch(told, "near-candidates")
    open_ = told.select(F.col("a").alias("id"), F.col("c_b").alias("c")).union(told.select(F.col("b").alias("id"), F.col("c_a").alias("c"))).distinct()
    open_ = scratch(open_, "open-classes")
    if not open_.limit(1).count():
        return None
    named = open_.select("c").distinct()
    grown = found.select(F.col("node").alias("id"), F.col("component").alias("c")).join(named, "c", "left_semi")
    alone = named.select(F.col("c").alias("id"), "c").join(found.select(F.col("component").alias("c")).distinct(), "c", "left_anti")
    members = scratch(grown.select("id", "c").union(alone.select("id", "c")), "members")
    sizes = members.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(open_.groupBy("c").agg(F.count(F.lit(1)).alias("m")), "c")
    cuts = scratch(sizes.select("c", F.expr(f"cast(ceil(n / {BLOCK_TEXTS}) as bigint)").alias("right"), F.expr(f"cast(ceil(m / {BLOCK_TEXTS}) as bigint)").alias("left")), "blocks")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    to_all = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    left = open_.join(cuts, "c").withColumn("x", place("left")).withColumn("y", to_all("right")).select("c", "x", "y", "id").join(texts, "id")
    right = members.join(cuts, "c").withColumn("y", place("right")).withColumn("x", to_all("left")).select("c", "x", "y", "id").join(texts, "id")
    key = ["c", "x", "y"]
    left, right = scratch(left, "open-texts"), scratch(right, "member-texts")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: block_links(a, b, width, percent), "a bigint, b bigint")


def frequencies(texts: DataFrame, width: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in ascending order and in how many of the texts (id, text) each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 4 << 20):
            known, n = np.unique(shingle_sets(batch.column(1), width)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "n"])

    counts = texts.select("id", "text").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = scratch(counts, "frequencies")
    least, room = 2, ORDER_SHINGLES
    for n, kinds in sorted(((r.n, r.kinds) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("kinds")).collect()), reverse=True):
        room -= kinds
        if room < 0:
            least = n + 1
            break
    most = counts.filter(F.col("n") >= least).toArrow()
    known, n = most.column("g").to_numpy().view(np.uint64), most.column("n").to_numpy()
    order = np.argsort(known)
    return known[order], n[order]


def prefix_sizes(n: int, percent: int) -> tuple[int, int]:
    """Of n shingles in the common order, how many to look at for partners of at most n shingles, and of at least n."""
    return n + 1 - -(-percent * n // 100), n + 1 - -(-2 * percent * n // (100 + percent))


def prefixes(texts: DataFrame, known: np.ndarray, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(g, id, c, n, at, short) of texts (id, c, text): the first shingles of each; short if also for larger partners."""
    order = texts.sparkSession.sparkContext.broadcast((known, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = order.value
        for batch in small_batches(batches, 2, 1 << 20):
            sets, at = shingle_sets(batch.column(2), width)
            often = np.zeros(len(sets), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, sets), len(known) - 1)
                often = np.where(known[place] == sets, counts[place], 0)
            firsts, sizes, shorts = [sets[:0]], np.diff(at), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                far, near = prefix_sizes(b - a, percent) if b > a else (0, 0)
                firsts.append(sets[a:b][np.argsort(often[a:b], kind="stable")[:far]])
                shorts.append(near)
            far = np.array([len(f) for f in firsts[1:]], np.int64)
            row = np.repeat(np.arange(len(far)), far)
            place = ranges(np.zeros(len(far), np.int64), far)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(firsts).view(np.int64)),
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array(sizes[row].astype(np.int64)),
                    pa.array(place),
                    pa.array(place < np.array(shorts, np.int64)[row]),
                ],
                names=["g", "id", "c", "n", "at", "short"],
            )

    return texts.select("id", "c", "text").mapInArrow(run, "g bigint, id bigint, c bigint, n bigint, at bigint, short boolean")


def apart(texts: DataFrame, known: np.ndarray, counts: np.ndarray, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of different components that may be linked; all pairs that are linked are among them.

    Components are paired per shingle before their members are, so a large component costs nothing by itself.
    """
    firsts = scratch(prefixes(texts, known, counts, width, percent), "prefixes")
    met = firsts.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("short").alias("short")).filter("low <> high and short")
    live = scratch(firsts.join(met.select("g"), "g", "left_semi"), "met-prefixes")
    scratch.drop(firsts)
    groups = live.groupBy("g", "c").agg(F.max("short").alias("short"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("at").alias("head"))
    groups = scratch(groups, "met-components")
    small = groups.filter("short").select("g", F.col("c").alias("c_y"), F.col("least").alias("least_y"), F.col("most").alias("most_y"))
    both = groups.select("g", F.col("c").alias("c_x"), "least", "most", "head").join(small, "g")
    both = both.filter(f"c_x <> c_y and least_y <= most and 100 * most_y >= {percent} * least").select("g", "c_x", "c_y", "least", "most", "head")
    both = scratch(both, "component-pairs")
    y = live.filter("short").select("g", F.col("c").alias("c_y"), F.col("id").alias("y"), F.col("n").alias("m"), F.col("at").alias("at_y"))
    x = live.select("g", F.col("c").alias("c_x"), F.col("id").alias("x"), "n", "at")
    # What is before the first shingle in common is not shared. Members of y are first held against bounds of all of x.
    may = f"m <= most and 100 * m >= {percent} * least and {100 + percent} * least(most - head, m - at_y) >= {percent} * (least + m)"
    some = both.join(y, ["g", "c_y"]).filter(may).select("g", "c_x", "c_y", "y", "m", "at_y")
    pairs = scratch(some, "component-members").join(x, ["g", "c_x"])
    fits = f"m <= n and 100 * m >= {percent} * n and {100 + percent} * least(n - at, m - at_y) >= {percent} * (n + m)"
    return pairs.filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def best_of(pairs: DataFrame) -> DataFrame:
    """For each class the candidate met most often and deepest, as distinct pairs."""
    rank = F.struct("trees", "depth", "other")
    sides = pairs.select(F.col("a").alias("own"), F.col("b").alias("other"), "trees", "depth").union(pairs.select(F.col("b").alias("own"), F.col("a").alias("other"), "trees", "depth"))
    best = sides.groupBy("own").agg(F.max(rank).alias("best"))
    return best.select(F.least("own", "best.other").alias("a"), F.greatest("own", "best.other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    rows = scratch(signed(docs, text, width), "signatures")
    some = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch(some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes, ["k1", "k2", "n_shingles"]).filter("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", "forest")
    trees = reps.select(
        "doc_id", F.explode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(forest[3 * t] as region, forest[3 * t + 1] as o1, forest[3 * t + 2] as o2))")).alias("key")
    ).select("key.region", "key.o1", "key.o2", "doc_id")
    trees = scratch(trees, "trees")
    pairs = scratch(walk_orders(trees, scratch), "candidates")
    scratch.drop(trees)
    # Only texts of candidates are looked at again.
    ids = scratch(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidate-ids")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).alias("text"))
    texts = scratch(by_ids(texts, ids, "id", "left_semi"), "candidate-texts")
    first = scratch(best_of(pairs), "best-candidates")
    checked = scratch(confirmed(first, texts, width, percent), "checked")
    found = components(checked.filter("link"), scratch=scratch)
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    label = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    rest = rest.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    more = scratch(confirmed(scratch(rest, "open-candidates"), texts, width, percent), "checked")
    checked = checked.union(more)
    links = checked.filter("link").select("a", "b")
    if more.filter("link").limit(1).count():
        found = components(links, scratch=scratch)
    last = settle(checked.filter("not link").select("a", "b"), found, texts, width, percent, scratch)
    if last is not None:
        links = links.union(scratch(last, "links"))
        found = components(links, scratch=scratch)
    # What is still apart, exactly.
    wholes = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(text).alias("text"))
    labelled = classes.select(F.col("rep").alias("id"), "k1").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    labelled = scratch(labelled.select("id", F.coalesce("component", "id").alias("c"), "k1").dropDuplicates(["id"]), "labelled-classes")
    amount = pieces(labelled.count(), ORDER_TEXTS)
    known, counts = frequencies(by_ids(wholes, labelled.filter(F.pmod("k1", F.lit(amount)) == 0).select("id"), "id", "left_semi"), width, scratch)
    told = by_ids(wholes, labelled.select("id", "c"), "id", "inner")
    open_ = scratch(apart(told, known, counts, width, percent, scratch), "pairs-apart")
    unseen = open_.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    ids = scratch(unseen.select(F.col("a").alias("id")).union(unseen.select("b")).distinct(), "apart-ids")
    exact = scratch(confirmed(unseen, scratch(by_ids(wholes, ids, "id", "left_semi"), "apart-texts"), width, percent), "checked")
    if exact.filter("link").limit(1).count():
        found = components(links.union(exact.filter("link").select("a", "b")), scratch=scratch)
    of = found.select(F.col("node").alias("rep"), "component")
    joined = rows.select("doc_id", "n_shingles", "k1", "k2").join(classes.join(of, "rep", "left"), ["k1", "k2", "n_shingles"], "left")
    component = F.coalesce("component", "rep", "doc_id")
    result = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
    return scratch.finish(result)
