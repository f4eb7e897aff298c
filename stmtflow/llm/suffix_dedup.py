r"""Remove repeated byte strings with shard suffix arrays.

A byte goes if a string of MATCH bytes over it also starts earlier: in a document with a smaller id or earlier in the same
one. All strings are judged on the input texts.

Which strings can repeat at all is told by anchors. Each start of a MATCH-byte window chooses the leftmost smallest GRAM-byte
hash in its window; equal windows choose equal grams at equal places. Windows of a text that share an anchor lie next to
each other and form a context, so each window is in exactly one context. An anchor hash met once in the corpus has only
windows that do not repeat. The contexts of the other hashes go to shards by hash, so equal windows meet in one shard; equal
contexts are sent once per block of documents, as their first occurrence.

A window of a context holds the anchor and 68 more bytes, so it holds the SIDE bytes before the anchor or the SIDE bytes after it.
Once equal contexts are one, a context whose anchor meets no other with the same SIDE bytes on either side holds no window of
another context, nor one window twice, as equal windows have equal anchors at equal places. All its windows are first ones; only
the other contexts are sorted.

A shard builds the suffix array of these contexts by induced sorting: suffixes are classified, leftmost-smaller substrings
are sorted by inducing, named and ranked, and the array is induced from them. Induction goes bucket by bucket with numpy
over whole buckets, so it is linear in the shard. Names, whose alphabet is too large for buckets, are ranked by
doubling up to MATCH bytes, beyond which order does not matter here. Lengths of common prefixes with the predecessor are
taken in text order (permuted) and clipped at MATCH bytes; stretches of the array where they reach MATCH are equal windows. Contexts lie in
the shard's text in the order of their occurrence, so the first occurrence of a window is its smallest place.
The shard tells which windows are first occurrences; all others of a repeated anchor are removed.

An anchor hash with many distinct contexts (HOT), such as the edge of a passage that a third of all documents share,
would bring an unbounded group to one shard. Its windows are sent one by one instead, to shards by a hash of the window and
once per block, and the first of each hash is kept. The hash joins 64 bits of the block's rolling sums with two independent
residues modulo the prime 2^31 - 1: whatever the bytes, two different windows agree in those two with a chance below
(MATCH / 2^31)^2 over the choice of bases, besides the other 64 bits.

Blocks, shards and the parts in which anchors are counted have bounded sizes, their number follows the bytes of the corpus. A
text longer than a block is a block of its own; anchors are chosen STEP starts at a time, so its length is not limited.

Null and empty texts have no bytes; texts shorter than MATCH lose nothing. Rows with equal ids are ordered as they are read and
count as different documents; null ids come first. Texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stmtflow.llm.common import pieces
from stmtflow.llm.tokens import mixed, powers, ranges, raw_bytes

MATCH, GRAM = 100, 32
SPAN = MATCH - GRAM + 1
#: Bytes that a window holds beside its anchor on one side at least.
SIDE = (MATCH - GRAM) // 2
BLOCK_BYTES, SHARD_BYTES, ANCHORS_PER_PART = 2 << 20, 4 << 20, 1_000_000
HOT = 4096
#: Window starts whose anchors are chosen at once, few enough for a processor's cache, and bits of a place among them.
STEP, PLACE_BITS = 1 << 15, 26
#: The prime of the windows' residues, bytes summed up at once, and two bases, powers of the prime's root 7.
PRIME, FIELD = (1 << 31) - 1, 1 << 16
BASES = (pow(7, 104_729, PRIME), pow(7, 224_737, PRIME))

ANCHORS = "h bigint, block bigint, times bigint, kinds bigint"
MARKS = "block bigint, kind int, h bigint, doc bigint, row bigint, start bigint, stop bigint"
PARTS = "route bigint, kind int, w1 bigint, w2 bigint, block bigint, doc bigint, row bigint, start bigint, bytes binary"


def field_powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo PRIME."""
    values = np.ones(1, np.uint64)
    while len(values) < n:
        values = np.concatenate([values, values * np.uint64(pow(base, len(values), PRIME)) % np.uint64(PRIME)])
    return values[:n]


def modulo(values: np.ndarray) -> np.ndarray:
    """Numbers below 2^62 modulo PRIME, whose bits above the 31st count as ones."""
    prime, bits = np.uint64(PRIME), np.uint64(31)
    for _ in range(2):
        values = (values & prime) + (values >> bits)
    values[values == prime] = 0
    return values


def running_sums(data: np.ndarray) -> np.ndarray:
    """Sums of data + 1 as digits of the base of `tokens.powers`, from no value to all, taken FIELD values at a time."""
    n, up = len(data), powers(len(data) + 1)[0]
    sums = np.zeros(n + 1, np.uint64)
    for lo in range(0, n, FIELD):
        part = data[lo : lo + FIELD].astype(np.uint64)
        part += np.uint64(1)
        part *= up[lo : lo + len(part)]
        part[:1] += sums[lo : lo + 1]
        np.cumsum(part, out=sums[lo + 1 : lo + 1 + len(part)])
    return sums


class Block:
    """Texts of a block in order of (id, row), with their anchors: context i has window starts first[i] to last[i].

    The anchor of context i starts at place[i].
    """

    def __init__(self, rows: pa.Table):
        ids, row = rows.column("doc_id"), rows.column("_row").to_numpy()
        self.null = ids.is_null().to_numpy()
        self.ids = ids.fill_null(-(1 << 63)).to_numpy()
        self.order = np.lexsort((row, self.ids))
        self.ids, self.null, self.row = self.ids[self.order], self.null[self.order], row[self.order]
        texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks == 1 else texts
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.fill_null("").cast(pa.large_string()).take(pa.array(self.order))
        self.data, self.offsets = raw_bytes(texts)
        self._anchors()

    def _hash(self, sums: np.ndarray, start: np.ndarray, size) -> np.ndarray:
        return mixed((sums[start + size] - sums[start]) * powers(len(self.data) + 1)[1][start])

    def _anchors(self) -> None:
        n = len(self.data)
        self.first = self.last = self.place = np.zeros(0, np.int64)
        self.h = np.zeros(0, np.uint64)
        if n < MATCH:
            return
        sums, down = running_sums(self.data), powers(n + 1)[1]
        self.sums = sums
        # Windows that reach beyond their document.
        edges = self.offsets[1:-1]
        begin = np.maximum(edges - MATCH + 1, 0)
        inside = np.ones(n - MATCH + 1, bool)
        inside[ranges(begin, np.maximum(np.minimum(edges, n - MATCH + 1) - begin, 0))] = False
        low = np.uint64((1 << PLACE_BITS) - 1)
        number = np.arange(min(STEP + SPAN - 1, n - GRAM + 1), dtype=np.uint64)
        heads, anchors, places = [], [], []
        before = -1
        for lo in range(0, n - MATCH + 1, STEP):
            hi = min(lo + STEP + SPAN - 1, n - GRAM + 1)
            gram = mixed((sums[lo + GRAM : hi + GRAM] - sums[lo:hi]) * down[lo:hi])
            key = (gram & ~low) | number[: hi - lo]
            width = 1
            while 2 * width <= SPAN:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            if width < SPAN:
                key = np.minimum(key[: len(key) - (SPAN - width)], key[SPAN - width :])
            place = (key & low).astype(np.int64)
            within = inside[lo : lo + len(place)]
            new = np.empty(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (within[1:] != within[:-1])
            # A context that began in the last step goes on.
            new[0] = before != lo + place[0] or inside[lo - 1] != within[0]
            before = lo + place[-1]
            at = np.flatnonzero(new)
            heads.append(lo + at)
            places.append(lo + place[at])
            anchors.append(gram[place[at]])
        head = np.concatenate(heads)
        tail = np.append(head[1:], n - MATCH + 1) - 1
        use = inside[head]
        self.first, self.last, self.place = head[use], tail[use], np.concatenate(places)[use]
        self.h = np.concatenate(anchors)[use]

    def residues(self, start: np.ndarray, base: int) -> np.ndarray:
        """The windows from rising `start` as polynomials in a base, modulo PRIME. Sums are taken FIELD bytes at a time."""
        prime = np.uint64(PRIME)
        # Only the bytes under these windows count.
        runs = np.flatnonzero(np.concatenate([[True], np.diff(start) > MATCH]))
        size = start[np.append(runs[1:], len(start)) - 1] + MATCH - start[runs]
        data = self.data[ranges(start[runs], size)]
        start = start - np.repeat(start[runs] - (np.cumsum(size) - size), np.diff(np.append(runs, len(start))))
        n = len(data)
        up, back = field_powers(base, FIELD), pow(base, -1, PRIME)
        sums, carried = np.zeros(n + 1, np.uint32), np.uint64(0)
        for lo in range(0, n, FIELD):
            part = modulo((data[lo : lo + FIELD].astype(np.uint64) + np.uint64(1)) * up[: min(FIELD, n - lo)])
            part = modulo(np.cumsum(modulo(part * np.uint64(pow(base, lo, PRIME)))) + carried)
            sums[lo + 1 : lo + 1 + len(part)], carried = part, part[-1]
        low, high = field_powers(back, FIELD), field_powers(pow(back, FIELD, PRIME), n // FIELD + 1)
        held = modulo(sums[start + MATCH].astype(np.uint64) + prime - sums[start])
        return modulo(modulo(held * low[start % FIELD]) * high[start // FIELD])

    def window_hash(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two words that tell windows apart, the second independent of the first."""
        w2 = (self.residues(start, BASES[0]) << np.uint64(31)) | self.residues(start, BASES[1])
        return self._hash(self.sums, start, MATCH), w2

    def context_hash(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the contexts `at`."""
        size = self.last[at] - self.first[at] + MATCH
        return self._hash(self.sums, self.first[at], size) ^ mixed(size.astype(np.uint64)) if len(size) else self.h[at]


def members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted array `known`, -1 where it is not there."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def block_anchors(rows: pa.Table) -> pa.Table:
    """How often each anchor hash of a block occurs, and with how many distinct contexts."""
    block = Block(rows)
    number = rows.column("block")[0].as_py() if rows.num_rows else 0
    order = np.argsort(block.h)
    h = block.h[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(h)))
    kinds = np.ones(len(head), np.int64)
    many = np.repeat(times > 1, times)
    if many.any():
        group, c = np.repeat(np.arange(len(head)), times)[many], block.context_hash(order[many])
        by = np.lexsort((c, group))
        group, c = group[by], c[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (c[1:] != c[:-1])])
        kinds = np.bincount(group[new], minlength=len(head)) + (times == 1)
    return pa.table({"h": h[head].view(np.int64), "block": np.full(len(head), number), "times": times, "kinds": kinds})


def repeated_anchors(batches):
    """(block, h) of hashes met more than once; kind 1 if they have many contexts. Takes whole hash partitions."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got)
    h, block, times, kinds = (rows.column(c).to_numpy() for c in ("h", "block", "times", "kinds"))
    order = np.argsort(h)
    head = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    number = np.zeros(len(h), np.int64)
    number[head[1:]] = 1
    number = np.cumsum(number)
    use = (np.add.reduceat(times[order], head) > 1)[number]
    hot = (np.add.reduceat(kinds[order], head) >= HOT)[number]
    at = order[use]
    none = np.zeros(len(at), np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(block[at]), pa.array(hot[use].astype(np.int32)), pa.array(h[at]), *[pa.array(none)] * 4],
        names=[c.split()[0] for c in MARKS.split(", ")],
    )


def block_parts(rows: pa.Table, marks: pa.Table, shards: int) -> pa.Table:
    """The contexts (kind 0) or windows (kind 1) of a block's repeated anchors, equal ones once.

    Contexts carry the place of their anchor as w2.
    """
    block = Block(rows)
    known = marks.column("h").to_numpy().view(np.uint64)
    order = np.argsort(known)
    at = members(block.h, known[order])
    hot = np.append(marks.column("kind").to_numpy()[order], 0)[at] == 1
    plain = np.flatnonzero((at >= 0) & ~hot)
    number = rows.column("block")[0].as_py() if rows.num_rows else 0
    if len(plain):
        _, one = np.unique(block.context_hash(plain), return_index=True)
        plain = plain[np.sort(one)]
    size = block.last[plain] - block.first[plain] + MATCH
    text = block.data[ranges(block.first[plain], size)]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    contexts = pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(ends), pa.py_buffer(text)])
    hot_at = np.flatnonzero((at >= 0) & hot)
    window, w1, w2 = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(hot_at):
        window = ranges(block.first[hot_at], block.last[hot_at] - block.first[hot_at] + 1)
        w1, w2 = block.window_hash(window)
        keep = np.lexsort((window, w2, w1))
        new = np.concatenate([[True], (w1[keep][1:] != w1[keep][:-1]) | (w2[keep][1:] != w2[keep][:-1])])
        keep = keep[new]
        window, w1, w2 = window[keep], w1[keep], w2[keep]
    start = np.concatenate([block.first[plain], window])
    doc = np.searchsorted(block.offsets, start, side="right") - 1
    n, m = len(plain), len(window)
    route = np.concatenate([block.h[plain], w1]) % np.uint64(shards)
    return pa.table(
        {
            "route": route.astype(np.int64),
            "kind": (np.arange(n + m) >= n).astype(np.int32),
            "w1": np.concatenate([np.zeros(n, np.uint64), w1]).view(np.int64),
            "w2": np.concatenate([(block.place[plain] - block.first[plain]).astype(np.uint64), w2]).view(np.int64),
            "block": np.full(n + m, number),
            "doc": block.ids[doc],
            "row": block.row[doc],
            "start": start - block.offsets[doc],
            "bytes": pa.concat_arrays([contexts, pa.nulls(m, pa.binary())]),
        }
    )


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S); the last, a unique smallest value, is S."""
    n = len(text)
    less = np.empty(n, np.int8)
    less[-1] = 1
    less[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    place = np.where(less != 0, np.arange(n), n)
    return less[np.minimum.accumulate(place[::-1])[::-1]] > 0


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array induced from leftmost-smaller suffixes in the order given; ends[c] is where bucket c ends."""
    n, starts = len(text), np.concatenate([[0], ends[:-1]])
    values = len(ends)
    array = np.full(n, -1, np.int32)
    counts = np.bincount(text[lms], minlength=values)
    lms_from = ends - counts
    order = np.argsort(text[lms], kind="stable")
    array[ranges(lms_from, counts)] = lms[order]
    head = starts.copy()

    def put(items: np.ndarray, pointer: np.ndarray, forward: bool) -> None:
        chars = text[items]
        order = np.argsort(chars, kind="stable")
        chars, items = chars[order], items[order]
        number = np.bincount(chars, minlength=values)
        inside = np.arange(len(items)) - (np.cumsum(number) - number)[chars]
        if forward:
            array[pointer[chars] + inside] = items
            pointer += number
        else:
            array[pointer[chars] - 1 - inside] = items
            pointer -= number

    for c in range(values):
        done = starts[c]
        while done < head[c]:
            items = array[done : head[c]]
            done = head[c]
            before = items[items > 0] - 1
            before = before[~small[before]]
            if len(before):
                put(before, head, True)
        items = array[lms_from[c] : ends[c]]
        before = items[items > 0] - 1
        before = before[~small[before]]
        if len(before):
            put(before, head, True)
    tail = ends.copy()
    for c in range(values - 1, -1, -1):
        done = ends[c]
        while done > tail[c]:
            items = array[tail[c] : done][::-1]
            done = tail[c]
            before = items[items > 0] - 1
            before = before[small[before]]
            if len(before):
                put(before, tail, False)
        items = array[starts[c] : head[c]][::-1]
        before = items[items > 0] - 1
        before = before[small[before]]
        if len(before):
            put(before, tail, False)
    array[0] = n - 1
    return array


def _rank(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of `names` by their first `depth` values, by doubling."""
    n, rank, reach = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - reach, 0)] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        reach *= 2
        if new[-1] == n - 1 or reach >= depth:
            return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of small integers that end with a unique smallest 0, right in the first `depth` values (default all)."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))
    small = _types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if not len(lms):
        return _induce(text, small, np.array([n - 1]), ends)
    induced = _induce(text, small, lms, ends)
    by_substring = induced[is_lms[induced]]
    # Substrings from one leftmost-smaller place to the next: equal length and bytes are equal names.
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:], n - 1)
    sums = running_sums(text)
    size = stop[by_substring] - by_substring + 1
    value = (sums[by_substring + size] - sums[by_substring]) * powers(n + 1)[1][by_substring]
    new = np.concatenate([[0], np.cumsum((value[1:] != value[:-1]) | (size[1:] != size[:-1]))])
    if new[-1] == len(lms) - 1:
        return _induce(text, small, by_substring, ends)
    names = np.empty(n, np.int64)
    names[by_substring] = new
    ordered = lms[_rank(names[lms], len(lms) if depth is None else depth // 2 + 1)]
    return _induce(text, small, ordered, ends)


def common_prefixes(text: np.ndarray, places: np.ndarray, match: int = MATCH) -> np.ndarray:
    """For windows in suffix order: how many of `match` bytes each shares with the one before it, taken in text order."""
    before = np.full(len(text), -1, np.int64)
    before[places[1:]] = places[:-1]
    at = np.flatnonzero(before >= 0)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = as_strided(padded[:8].view(np.uint64), shape=(len(text),), strides=(1,))
    common = np.zeros(len(text), np.int16)
    for shift in [*range(0, match - 7, 8), *([match - 8] if match % 8 else [])]:
        apart = words[at + shift] ^ words[before[at] + shift]
        ends = apart != 0
        # The lowest set bit lies in the first byte that differs.
        lowest = apart[ends] & (~apart[ends] + np.uint64(1))
        common[at[ends]] = shift + (np.log2(lowest.astype(float)) // 8).astype(np.int16)
        at = at[~ends]
    common[at] = match
    return common[places]


def first_windows(contexts: list[bytes] | pa.Array, windows: np.ndarray, match: int = MATCH) -> np.ndarray:
    """Of contexts in order of occurrence with `windows` starts each: which windows occur first there (flat, in order)."""
    data, offsets = raw_bytes(contexts if isinstance(contexts, pa.Array) else pa.array(contexts, pa.binary()))
    n, k = len(data), len(offsets) - 1
    size = np.diff(offsets)
    begin = offsets[:-1] + np.arange(k)
    text = np.ones(n + k + 1, np.uint16)
    text[ranges(begin, size)] = data.astype(np.uint16) + 2
    text[-1] = 0
    flat = np.zeros(n + k + 1, np.uint8)
    flat[ranges(begin, size)] = data
    start = np.zeros(n + k + 1, bool)
    places = ranges(begin, windows)
    start[places] = True
    array = suffix_array(text, match)
    ordered = array[start[array]].astype(np.int64)
    same = common_prefixes(flat, ordered, match) >= match
    head = np.flatnonzero(~same)
    first = np.minimum.reduceat(ordered, head)
    owner = np.zeros(n + k + 1, bool)
    owner[first] = True
    return owner[places]


def shard_firsts(rows: pa.Table) -> pa.Table:
    """Ranges of window starts of a shard that are first occurrences, as MARKS of kind 2."""
    kind, doc, row, start = (rows.column(c).to_numpy() for c in ("kind", "doc", "row", "start"))
    out = []
    at = np.flatnonzero(kind == 0)
    if len(at):
        at = at[np.lexsort((start[at], row[at], doc[at]))]
        contexts = rows.column("bytes").combine_chunks()
        contexts = pa.concat_arrays(contexts.chunks) if isinstance(contexts, pa.ChunkedArray) else contexts
        contexts = contexts.take(pa.array(at))
        sums, offsets = context_sums(contexts)
        _, one = np.unique(context_keys(sums, offsets), return_index=True)
        one = np.sort(one)
        at, windows = at[one], (np.diff(offsets) - MATCH + 1)[one]
        near = may_share(sums, offsets[one], windows, rows.column("w2").to_numpy()[at])
        owner = np.ones(windows.sum(), bool)
        if near.any():
            owner[np.repeat(near, windows)] = first_windows(contexts.take(pa.array(one[near])), windows[near])
        context = np.repeat(np.arange(len(at)), windows)
        place = ranges(start[at], windows)
        new = owner & np.concatenate([[True], ~owner[:-1] | (context[1:] != context[:-1])])
        end = owner & np.concatenate([~owner[1:] | (context[1:] != context[:-1]), [True]])
        out.append((at[context[new]], place[new], place[end]))
    at = np.flatnonzero(kind == 1)
    if len(at):
        w1, w2 = rows.column("w1").to_numpy()[at], rows.column("w2").to_numpy()[at]
        order = np.lexsort((start[at], row[at], doc[at], w2, w1))
        w1, w2, at = w1[order], w2[order], at[order]
        at = at[np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])]
        out.append((at, start[at], start[at]))
    who, begin, stop = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    who = who.astype(np.int64)
    return pa.table(
        {
            "block": rows.column("block").to_numpy()[who],
            "kind": np.full(len(who), 2, np.int32),
            "h": np.zeros(len(who), np.int64),
            "doc": doc[who],
            "row": row[who],
            "start": begin,
            "stop": stop,
        }
    )


def context_sums(contexts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over all bytes of contexts, and the offsets of each."""
    data, offsets = raw_bytes(contexts)
    return running_sums(data), offsets


def context_keys(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit keys of contexts."""
    size = np.diff(offsets)
    return mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * powers(len(sums))[1][offsets[:-1]]) ^ mixed(size.astype(np.uint64))


def may_share(sums: np.ndarray, begin: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which of different contexts may share a window with another, by the bytes on either side of their anchors.

    A context begins at `begin`, has so many windows and its anchor at place `anchor`.
    """
    down = powers(len(sums))[1]
    near = np.zeros(len(begin), bool)
    before, after = anchor >= SIDE, windows - 1 + MATCH >= anchor + GRAM + SIDE
    for side, shift in ((before, -SIDE), (after, 0)):
        at = np.flatnonzero(side)
        start = begin[at] + anchor[at] + shift
        _, which, times = np.unique((sums[start + GRAM + SIDE] - sums[start]) * down[start], return_inverse=True, return_counts=True)
        near[at[times[which] > 1]] = True
    return near


def removed_bytes(block: Block, marks: pa.Table) -> np.ndarray:
    """Which bytes of a block go, from its repeated anchors and first windows."""
    kind, h = marks.column("kind").to_numpy(), marks.column("h").to_numpy().view(np.uint64)
    repeated = np.sort(h[kind < 2])
    at = np.flatnonzero(members(block.h, repeated) >= 0)
    gone = np.zeros(len(block.data) + 1, bool)
    gone[ranges(block.first[at], block.last[at] - block.first[at] + 1)] = True
    mine = np.flatnonzero(kind == 2)
    if len(mine):
        doc, row, start, stop = (marks.column(c).to_numpy()[mine] for c in ("doc", "row", "start", "stop"))
        by_row = np.argsort(block.row)
        place = block.offsets[by_row[np.searchsorted(block.row[by_row], row)]]
        gone[ranges(place + start, stop - start + 1)] = False
    starts = np.flatnonzero(gone)
    edge = np.zeros(len(block.data) + MATCH + 1, np.int32)
    edge[starts] += 1
    edge[starts + MATCH] -= 1
    return np.cumsum(edge)[: len(block.data)] > 0


def block_result(rows: pa.Table, marks: pa.Table, schema: pa.Schema, with_text: bool) -> pa.Table:
    block = Block(rows)
    gone = removed_bytes(block, marks)
    n = len(block.offsets) - 1
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edges = block.offsets[1:-1][block.offsets[1:-1] < len(gone)]
    begins[edges] = gone[edges]
    doc = np.repeat(np.arange(n), np.diff(block.offsets))
    removed, spans = np.bincount(doc[gone], minlength=n), np.bincount(doc[begins], minlength=n)
    kept, digest, texts = ~gone, [], []
    for i in range(n):
        a, b = block.offsets[i], block.offsets[i + 1]
        left = block.data[a:b] if not removed[i] else block.data[a:b][kept[a:b]]
        if with_text:
            texts.append(left.tobytes().decode("utf-8", "ignore"))
        else:
            digest.append(hashlib.sha256(left).hexdigest())
    ordered = rows.take(pa.array(block.order))
    out = {"_doc": ordered.column("_doc"), "n_bytes": np.diff(block.offsets), "n_removed": removed, "n_spans": spans}
    out |= {"kept_text": pa.array(texts, pa.string())} if with_text else {"kept_sha256": pa.array(digest, pa.string())}
    return pa.table([pa.array(out[f.name], f.type) if isinstance(out[f.name], np.ndarray) else out[f.name].cast(f.type) for f in schema], schema=schema)


def deduplicate(docs: DataFrame, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """The columns `keep` of docs, n_bytes, n_removed, n_spans and kept_sha256 or, on demand, kept_text.

    What remains of a text is decoded without the parts of characters that were cut.
    """
    keep = ["doc_id"] if keep is None else keep
    added = ["n_bytes", "n_removed", "n_spans", "kept_text" if with_text else "kept_sha256"]
    own = [c for c in keep if c not in added]
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, shards = pieces(total, BLOCK_BYTES), pieces(total, SHARD_BYTES)
    parts = pieces(total // 30, ANCHORS_PER_PART, 8)
    texts = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    anchors = texts.groupBy("block").applyInArrow(block_anchors, ANCHORS)
    repeated = anchors.repartition(parts, "h").mapInArrow(repeated_anchors, MARKS)
    cut = texts.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(lambda rows, marks: block_parts(rows, marks, shards), PARTS)
    firsts = cut.groupBy("route").applyInArrow(shard_firsts, MARKS)
    marks = repeated.unionByName(firsts)
    kinds = ["bigint", "bigint", "bigint", "string"]
    schema = StructType([texts.schema["_doc"], *StructType.fromDDL(", ".join(map(" ".join, zip(added, kinds)))).fields])
    arrow = to_arrow_schema(schema)
    done = texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda rows, m: block_result(rows, m, arrow, with_text), schema)
    return done.select("_doc.*", *added)
