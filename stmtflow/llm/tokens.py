"""Words and hashes of whole Arrow batches of texts, in numpy.

Hashes are 64-bit: a word's bytes as a polynomial modulo 2**64, from running sums, then mixed. Two different words
share one with a chance of about 2**-60.
"""

from __future__ import annotations

import ctypes
import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII characters that are no letters or digits.
GAP = np.ones(256, bool)
GAP[128:] = False
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    GAP[_a:_b] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each.

    Only tasks keep them: what the driver kept would be shipped with every function that needs this module.
    """
    if 0 in _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0]
    in_task = TaskContext.get() is not None
    if in_task:
        tidy()
    size = ((int(n) >> 18) + 1) << 18
    made = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    for table in made:
        table[0] = 1
        np.multiply.accumulate(table, out=table)
    if in_task:
        _POWERS[0] = made
    return made


def tidy() -> None:
    """Give back the memory of tasks that came before in this worker.

    Spark keeps Python workers, and the tables of a function that has come to its end wait in cycles for the collector.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not a C library that can.
        return


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and the n + 1 offsets of its values."""
    large = texts.cast(pa.large_binary())
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch: byte ranges, document of each, and what is needed to hash parts of them."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    sums: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def first(self) -> np.ndarray:
        """Number of the first word of each document, with one more at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def hashes(self, length: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first `length` bytes (words that are shorter hash whole)."""
        stop = self.end if length is None else np.minimum(self.end, self.start + length)
        down = powers(len(self.data) + 1)[1]
        return mixed((self.sums[stop] - self.sums[self.start]) * down[self.start])


def words_of(texts: pa.Array, gap: np.ndarray = SPACE, lower: np.ndarray = LOWER) -> Words:
    """Maximal runs of bytes that are not `gap`; runs end with their document. Nulls have no words."""
    data, offsets = raw_bytes(texts.fill_null(b"" if pa.types.is_binary(texts.type) else ""))
    data = lower[data]
    n = len(data)
    inside = ~gap[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < n]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n + 1)[0][:n], out=sums[1:])
    return Words(data, offsets, start, end, doc, sums)


def runs_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive hashes, in order; shorter by width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mixed(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + counts[i] - 1 of all i, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def small_batches(batches, column: int, most: int = 2 << 20):
    """Cut record batches so that the texts of each hold about `most` bytes; a longer text stays whole."""
    for batch in batches:
        sizes = np.diff(raw_bytes(batch.column(column).fill_null(""))[1])
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin] - sizes[begin]
            stop = max(begin + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop
