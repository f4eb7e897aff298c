r"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items are compared by 64-bit hashes. Seeds are runs of SEED words that a document shares
with an item. An item is filed under the seeds that touch one stretch of its words, so long that without it too little of the
item is left to be leaked; of all stretches the one whose seeds are rarest among the items. So a document is put beside
the items whose rare seeds it holds, not beside all that share a phrase with it, and none that can be leaked is missed. All
seeds of such a pair then bound from above what tiles can cover. For the pairs left, running Karp-Rabin tiling finds the
longest common runs of words that no earlier tile marks, marks them in both texts, and goes on with shorter ones down to SEED
words; what a mark leaves of a run is a run again, so tiles are those of the plain greedy rule. Tiles may come in any order,
so passages put together anew are caught. An item is leaked into a document whose tiles cover COVERAGE of the item's words.

Items of fewer than SEED words are met only as a whole. The benchmark is read in blocks of at most BLOCK_BYTES of
text (one pass over the documents for each), and only such a block is sent to the tasks.

Words are runs of letters and digits, in lower case. Null and empty texts have no words and match nothing; repeated items
and documents are handled one by one; an empty benchmark leaves all documents clean. Texts are read whole; further
columns are passed on.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stmtflow.llm.common import pieces
from stmtflow.llm.tokens import GAP, ranges, runs_of, small_batches, words_of

SEED = 5
COVERAGE = 0.8
BLOCK_BYTES = 16 << 20
PLAIN = np.arange(256, dtype=np.uint8)
HITS = "array<struct<item_id:bigint,covered:bigint,item_words:bigint,coverage:double,tiles:array<struct<doc_word:bigint,item_word:bigint,words:bigint>>>>"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (with one more at the end)."""
    words = words_of(pc.utf8_lower(texts.fill_null("")), GAP, PLAIN)
    return words.hashes(), words.first()


def rare_stretch(counts: np.ndarray, n: int, width: int, coverage: float) -> tuple[int, int]:
    """First and last seed that touch the stretch of an item of n words that has to be there, where seeds are rarest."""
    long = n - math.ceil(coverage * n) + 1
    begin = np.arange(n - long + 1)
    low, high = np.maximum(begin - width + 1, 0), np.minimum(begin + long - 1, len(counts) - 1)
    sums = np.concatenate([[0], np.cumsum(counts)])
    best = int(np.argmin(sums[high + 1] - sums[low]))
    return int(low[best]), int(high[best])


@dataclass
class Block:
    """A part of the benchmark: items' words and seed widths, and for each width the sorted seeds that items are filed under."""

    ids: list[int | None]
    words: np.ndarray
    first: np.ndarray
    filed: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list[int | None], texts: pa.Array, coverage: float = COVERAGE) -> Block:
        words, first = word_hashes(texts)
        lengths = np.diff(first)
        filed = {}
        for width in sorted({int(min(n, SEED)) for n in lengths if n}):
            items = np.flatnonzero(np.minimum(lengths, SEED) == width)
            n = lengths[items] - width + 1
            hashes = runs_of(words, width)[ranges(first[items], n)]
            _, same, times = np.unique(hashes, return_inverse=True, return_counts=True)
            counts, ends = times[same], np.cumsum(n)
            spans = [rare_stretch(counts[e - k : e], int(lengths[i]), width, coverage) for i, k, e in zip(items, n, ends)]
            low = np.array([e - k + a for (a, _), k, e in zip(spans, n, ends)], np.int64)
            size = np.array([b - a + 1 for a, b in spans], np.int64)
            chosen, item = hashes[ranges(low, size)], np.repeat(items, size)
            order = np.argsort(chosen, kind="stable")
            filed[width] = chosen[order], item[order]
        return Block(ids, words, first, filed)

    def width(self, item: int) -> int:
        return min(int(self.first[item + 1] - self.first[item]), SEED)

    def pairs(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (document, item) of a batch that share a seed under which the item is filed, in order."""
        found = [np.zeros((0, 2), np.int64)]
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for width, (known, item) in self.filed.items():
            runs = runs_of(words, width)
            if not len(runs):
                continue
            sieve = np.zeros(1 << 20, bool)
            sieve[known & np.uint64(0xFFFFF)] = True
            at = np.flatnonzero(sieve[runs & np.uint64(0xFFFFF)])
            at = at[doc_of[at] == doc_of[at + width - 1]]
            at = at[np.isin(runs[at], known)]
            # A seed that a document repeats names its items once.
            once = np.unique(np.rec.fromarrays([doc_of[at], runs[at]], names="doc,run"))
            low, high = np.searchsorted(known, once.run), np.searchsorted(known, once.run, side="right")
            named = np.column_stack([np.repeat(once.doc, high - low), item[ranges(low, high - low)]])
            found.append(np.unique(named, axis=0))
        both = np.concatenate(found)
        return both[np.lexsort((both[:, 1], both[:, 0]))]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in doc, place in item, words) of two hash arrays, by running Karp-Rabin.

    Always the longest common run without marks comes next, of several the first in the document, then in the item.
    """
    doc_free, item_free, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []
    length = max(least, min(len(doc), len(item)))
    while True:
        found = _matches(doc, item, doc_free, item_free, length)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, d, i) for n, d, i in found]
        heapq.heapify(queue)
        while queue:
            n, d, i = heapq.heappop(queue)
            free = doc_free[d : d - n] & item_free[i : i - n]
            if free.all():
                doc_free[d : d - n] = item_free[i : i - n] = False
                tiles.append((d, i, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= length:
                    heapq.heappush(queue, (a - b, d + a, i + a))
        if length == least:
            return sorted(tiles)
        length = max(least, length // 2)


def _matches(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal common free runs of at least `length` words: (words, place in doc, place in item)."""
    table: dict[int, list[int]] = {}
    own = runs_of(item, length)
    for i in _free_windows(item_free, length).tolist():
        table.setdefault(int(own[i]), []).append(i)
    if not table:
        return []
    hashes = runs_of(doc, length)
    places = _free_windows(doc_free, length)
    places = places[np.isin(hashes[places], np.array(list(table), np.uint64))]
    out = []
    for d in places.tolist():
        for i in table[int(hashes[d])]:
            if d and i and doc_free[d - 1] and item_free[i - 1] and doc[d - 1] == item[i - 1]:
                continue  # a run is told from its first word
            most = min(len(doc) - d, len(item) - i)
            same = (doc[d : d + most] == item[i : i + most]) & doc_free[d : d + most] & item_free[i : i + most]
            n = most if same.all() else int(np.argmin(same))
            if n >= length:
                out.append((n, d, i))
    return out


def _free_windows(free: np.ndarray, length: int) -> np.ndarray:
    """Places of windows without a mark."""
    if len(free) < length:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[length:] - sums[:-length] == length)


def leaks(texts: pa.Array, block: Block, coverage: float = COVERAGE) -> list[list[dict]]:
    """The items of the block leaked into each text."""
    words, first = word_hashes(texts)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    held: dict[int, np.ndarray] = {}
    before = -1
    for d, i in block.pairs(words, first).tolist():
        own, width = block.words[block.first[i] : block.first[i + 1]], block.width(i)
        if d != before:
            held, before = {}, d
        if width not in held:
            held[width] = np.unique(runs_of(words[first[d] : first[d + 1]], width))
        # What tiles cover is covered by seeds, so this bound drops no leak.
        shared = np.flatnonzero(np.isin(runs_of(own, width), held[width]))
        seen = np.zeros(len(own), bool)
        for shift in range(width):
            seen[shared + shift] = True
        if seen.sum() < coverage * len(own):
            continue
        tiles = tile(words[first[d] : first[d + 1]], own, width)
        covered = sum(n for _, _, n in tiles)
        if covered >= coverage * len(own):
            out[d].append(
                {
                    "item_id": block.ids[i],
                    "covered": covered,
                    "item_words": len(own),
                    "coverage": covered / len(own),
                    "tiles": [{"doc_word": x, "item_word": y, "words": n} for x, y, n in tiles],
                }
            )
    return out


def blocks_of(benchmark: DataFrame, most: int = BLOCK_BYTES, coverage: float = COVERAGE) -> Iterator[Block]:
    """The benchmark in blocks of about `most` bytes of text, each small enough for the driver."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = pieces(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], most)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        got = part.orderBy("item_id", "text").toArrow().combine_chunks()
        texts = got.column("text")
        yield Block.of(got.column("item_id").to_pylist(), texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0), coverage)


def with_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """(_doc, leaks): the columns `keep` of each row as a struct, and the items leaked into it (null: none)."""
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), F.col(text).alias("_text"), F.lit(None).cast(HITS).alias("leaks"))
    for block in blocks_of(benchmark, coverage=coverage):
        found = _pass(found, docs.sparkSession.sparkContext.broadcast(block), coverage)
    return found.select("_doc", "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of docs with `leaks`, an array of the leaked items with coverage and tiles.

    An input column of that name is replaced.
    """
    own = [c for c in keep or docs.columns if c != "leaks"]
    return with_leaks(docs, benchmark, own, coverage, text).select("_doc.*", F.coalesce("leaks", F.array().cast(HITS)).alias("leaks"))


def _pass(docs: DataFrame, block, coverage: float) -> DataFrame:
    names, at, hits = ["_doc", "_text", "leaks"], 1, 2
    schema = StructType(list(docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            kind = batch.schema.field(hits).type
            new = leaks(batch.column(at), block.value, coverage)
            if any(new):
                old = batch.column(hits).to_pylist()
                column = pa.array([(a or []) + b if b else a for a, b in zip(old, new)], kind)
            else:
                column = batch.column(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], names=names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents into which no item has leaked."""
    return with_leaks(docs, benchmark, docs.columns, coverage).filter("leaks is null").select("_doc.*")
