"""Many saved filters at once: how many statements of a log meet each of them, in one scan.

Lines are folded before they are read, statements to classes (text, operation, flags, duration), and both are stored. Each class's
text is put to one automaton over the words of all filters, which finds every word that it holds in one pass. Classes for which
the same conditions hold are one kind, with a histogram of durations. Every filter is filed under one condition, its longest
word if it has one; only filters filed under a condition that holds for a kind are looked at, and of these all conditions must
hold. Durations are one range per filter, answered from the running counts of the kind's histogram.

A block of filters is known to all tasks, its size is bounded; further blocks are further passes. Counts leave a task once
per filter that matched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtflow.functions.filters import SQL_KEYWORDS, Condition, describe_filter, parse_filter
from stmtflow.functions.text import SPACE
from stmtflow.plans.materialize import materialize
from stmtflow.schema import OP_CODES

#: Filters of one pass, kinds that are put to them at once, classes and bytes of held words that a task keeps before it does so.
BLOCK, ROWS, CLASSES, HELD_BYTES = 20_000, 64, 1 << 18, 64 << 20
FLAGS = ("error", "n+1", "slow")
ALWAYS, NEVER = "always", "never"


@dataclass
class Filters:
    """A block of filters as tables of numbers."""

    names: list[str]
    words: dict[str, int]
    tests: dict[tuple, int]
    needs: np.ndarray
    filed_from: np.ndarray
    filed: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    timed: np.ndarray


def _test(cond: Condition) -> tuple:
    """A condition other than a duration as a key: ("text", word), ("op", code), ("keyword", word), a flag, or never."""
    if cond.kind == "op":
        pattern = str(cond.value)
        if pattern in OP_CODES:
            return "op", OP_CODES[pattern]
        return ("keyword", pattern) if pattern in SQL_KEYWORDS else (NEVER,)
    return ("text", str(cond.value)) if cond.kind == "text" else (cond.kind,)


def compiled(names: list[str], lines: list[str]) -> Filters:
    """Filter lines, named by their canonical form, as tables."""
    tests: dict[tuple, int] = {(ALWAYS,): 0}
    words: dict[str, int] = {}
    every, above, upto, timed, heads = [], [], [], [], []
    for line in lines:
        conds = parse_filter(line)
        # Whole microseconds: over floor(ns / 1000), or up to one below the limit rounded up.
        longer = [int(c.value) // 1000 for c in conds if c.kind == "duration" and not c.less]
        shorter = [-(-int(c.value) // 1000) - 1 for c in conds if c.kind == "duration" and c.less]
        above.append(max(longer, default=-(1 << 63)))
        upto.append(min(shorter, default=(1 << 63) - 1))
        timed.append(bool(longer or shorter))
        own = sorted({_test(c) for c in conds if c.kind != "duration"}, key=lambda t: (t[0] != "text", -len(str(t[-1])), str(t)))
        for t in own:
            at = tests.setdefault(t, len(tests))
            if t[0] == "text":
                words[t[1]] = at
        every.append([tests[t] for t in own])
        heads.append(every[-1][0] if own else 0)
    wide = max(map(len, every), default=0)
    needs = np.array([e + [0] * (wide - len(e)) for e in every], np.int64).reshape(len(lines), wide)
    order = np.argsort(heads, kind="stable")
    filed_from = np.searchsorted(np.array(heads)[order], np.arange(len(tests) + 1))
    return Filters(names, words, tests, needs, filed_from, order, np.array(above), np.array(upto), np.array(timed, bool))


class Kinds:
    """Classes seen so far by kind: the words that the text holds, and the operation, keyword and flags that filters ask for."""

    def __init__(self, filters: Filters):
        self.filters, self.automaton = filters, ahocorasick.Automaton() if filters.words else None
        for word, at in filters.words.items():
            self.automaton.add_word(word, at)
        if self.automaton is not None:
            self.automaton.make_automaton()
        self.ops = [t[1] for t in filters.tests if t[0] == "op"]
        self.keywords = [t[1] for t in filters.tests if t[0] == "keyword"]
        self.others = (len(self.ops) + 1) * (len(self.keywords) + 1) << len(FLAGS)
        self.total = np.zeros(len(filters.names), np.int64)
        self.clear()

    def clear(self) -> None:
        self.sets: dict[bytes, int] = {}
        self.seen: list[tuple[np.ndarray, ...]] = []
        self.classes = self.bytes = 0

    def words_of(self, text: str | None) -> int:
        """Number of the set of words that a text holds."""
        held = {at for _, at in self.automaton.iter(text)} if text and self.automaton is not None else ()
        key = np.array(sorted(held), np.int32).tobytes()
        if key not in self.sets:
            self.sets[key] = len(self.sets)
            self.bytes += len(key)
        return self.sets[key]

    def add(self, batch: pa.RecordBatch) -> None:
        coded = batch.column("text").dictionary_encode()
        # A null text holds no word.
        words = np.array([self.words_of(t) for t in [*coded.dictionary.to_pylist(), None]], np.int64)
        other = np.zeros(batch.num_rows, np.int64)
        for column, asked in (("op", self.ops), ("keyword", self.keywords)):
            known = batch.column(column)
            at = pc.index_in(known, pa.array(asked, known.type)).fill_null(len(asked))
            other = other * (len(asked) + 1) + at.to_numpy(zero_copy_only=False)
        for flag in FLAGS:
            other = other * 2 + batch.column(flag).to_numpy(zero_copy_only=False)
        dur, n = batch.column("dur_us"), batch.column("n").to_numpy(zero_copy_only=False)
        at = coded.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False)
        self.seen.append((words[at] * self.others + other, dur.is_valid().to_numpy(zero_copy_only=False), dur.fill_null(0).to_numpy(zero_copy_only=False), n))
        self.classes += batch.num_rows
        if self.classes >= CLASSES or self.bytes >= HELD_BYTES:
            self.count()

    def _truth(self, kinds: np.ndarray, sets: list[bytes]) -> np.ndarray:
        """One row per kind, one column per distinct condition."""
        truth = np.zeros((len(kinds), len(self.filters.tests)), bool)
        truth[:, 0] = True
        for row, held in enumerate((kinds // self.others).tolist()):
            truth[row, np.frombuffer(sets[held], np.int32)] = True
        other = kinds % self.others
        flags = {flag: other >> len(FLAGS) - 1 - i & 1 for i, flag in enumerate(FLAGS)}
        op, keyword = np.divmod(other >> len(FLAGS), len(self.keywords) + 1)
        for test, at in self.filters.tests.items():
            if test[0] == "op":
                truth[:, at] = op == self.ops.index(test[1])
            elif test[0] == "keyword":
                truth[:, at] = keyword == self.keywords.index(test[1])
            elif test[0] in flags:
                truth[:, at] = flags[test[0]]
        return truth

    def count(self) -> None:
        """Add the statements of the classes seen to the filters that they meet, and forget the classes."""
        if not self.classes:
            return
        filters = self.filters
        kind, known, dur, n = (np.concatenate(c) for c in zip(*self.seen))
        kinds, kind = np.unique(kind, return_inverse=True)
        every = np.zeros(len(kinds), np.int64)
        np.add.at(every, kind, n)
        # Running counts by kind and place of the duration: one search answers a range.
        durations, place = np.unique(dur[known], return_inverse=True)
        wide = len(durations) + 1
        key = kind[known] * wide + place
        order = np.argsort(key, kind="stable")
        key, upto = key[order], np.concatenate([[0], np.cumsum(n[known][order])])
        low, high = (np.searchsorted(durations, limit, side="right") for limit in (filters.above, filters.upto))
        sets = list(self.sets)
        for lo in range(0, len(kinds), ROWS):
            truth = self._truth(kinds[lo : lo + ROWS], sets)
            row, test = np.nonzero(truth)
            size = filters.filed_from[test + 1] - filters.filed_from[test]
            row, first = np.repeat(row, size), np.repeat(filters.filed_from[test] - np.cumsum(size) + size, size)
            filed = filters.filed[first + np.arange(len(row))]
            holds = np.ones(len(row), bool)
            for need in filters.needs.T:
                holds &= truth[row, need[filed]]
            row, filed = row[holds] + lo, filed[holds]
            timed = filters.timed[filed]
            np.add.at(self.total, filed[~timed], every[row[~timed]])
            row, filed = row[timed] * wide, filed[timed]
            within = upto[np.searchsorted(key, row + high[filed])] - upto[np.searchsorted(key, row + low[filed])]
            np.add.at(self.total, filed, np.maximum(within, 0))
        self.clear()


def _pass(classes: DataFrame, filters: Filters) -> DataFrame:
    """(canonical, matched) of the filters of a block that match anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(filters)
        for batch in batches:
            kinds.add(batch)
        kinds.count()
        hit = np.flatnonzero(kinds.total)
        yield pa.RecordBatch.from_arrays([pa.array([filters.names[i] for i in hit], pa.string()), pa.array(kinds.total[hit])], ["canonical", "matched"])

    return classes.mapInArrow(run, "canonical string, matched bigint")


def saved_filter_matches(events: DataFrame, saved: DataFrame, column: str = "filter") -> DataFrame:
    """(canonical, saved, matched, total): each canonical filter, how often it is saved, statements that meet it, all statements.

    `events` have `n_plus_1` and `slow_query`. Null lines take no part; an empty line matches everything.
    """
    # Equal lines are read once, and what several passes use is stored.
    folded = saved.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("line")).agg(F.count(F.lit(1)).alias("saved"))
    named = materialize(folded, "saved-lines").groupBy(describe_filter(F.col("line")).alias("canonical"))
    lines = materialize(named.agg(F.min("line").alias("line"), F.sum("saved").alias("saved")), "saved-filters")
    keyword = F.lower(F.regexp_extract("query", rf"\A{SPACE}*+((?i:{'|'.join(SQL_KEYWORDS)}))", 1))
    flag = lambda c: F.coalesce(c, F.lit(False))
    classes = events.groupBy(
        F.lower("query").alias("text"),
        keyword.alias("keyword"),
        "op",
        flag(F.col("error") != "").alias("error"),
        flag(F.col("n_plus_1")).alias("n+1"),
        flag(F.col("slow_query")).alias("slow"),
        "dur_us",
    ).agg(F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "statement-classes")
    blocks = -(-lines.count() // BLOCK) or 1
    found = None
    for b in range(blocks):
        own = lines if blocks == 1 else lines.filter(F.pmod(F.xxhash64("canonical"), F.lit(blocks)) == b)
        rows = own.select("canonical", "line").collect()
        part = _pass(classes, compiled([r.canonical for r in rows], [r.line for r in rows]))
        found = part if found is None else found.unionByName(part)
    matched = found.groupBy("canonical").agg(F.sum("matched").alias("matched"))
    zero = F.lit(0).cast("bigint")
    total = classes.agg(F.coalesce(F.sum("n"), zero).alias("total"))
    return lines.join(matched.hint("merge"), "canonical", "left").crossJoin(F.broadcast(total)).select("canonical", "saved", F.coalesce("matched", zero).alias("matched"), "total")
