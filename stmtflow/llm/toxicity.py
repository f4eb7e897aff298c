r"""Score texts for toxicity with a weighted finite-state pattern grammar.

Lexical transducers turn words into symbols: insult (with a weight), threat, target, negation, report; all other
words are skipped and the end of a clause (`.`, `,`, `;`, `:`, `!`, `?`, line feed) is a symbol. Small machines then
read the symbols of a clause, each with its own states and factors:

- insult and threat emit the weight of their word;
- target raises what a clause emits once somebody is addressed;
- negation lowers it for NEGATION_REACH words after a negation;
- report lowers it after a verb of saying.

`compose` builds the product machine; a clause's score is what the product emits over it. A document is scored from
its matched clauses: their sum, its share of the words and the largest clause, through a logistic fitted to labels.

Insults beyond the built-in list are learned as arcs over whole words and over first parts of words, so that
inflected forms are met: a word or part that many more toxic than clean documents hold gets the log of that ratio
as weight. Learning uses at most MOST_TOXIC and MOST_CLEAN labelled documents, those with the smallest hash of the
id; equal texts count once. Without labels of both kinds the built-in words and FALLBACK are used.

Null and empty texts have no clauses and get the score of the intercept. Rows are judged one by one, so repeated
rows get equal scores. Texts are read whole, in batches of bounded size. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stmtflow.llm.common import held_out
from stmtflow.llm.tokens import GAP, Words, small_batches, words_of

MOST_TOXIC, MOST_CLEAN = 2_000, 4_000
PART_BYTES = (5, 6, 7, 8)
MIN_TOXIC = 5
MIN_WEIGHT = 2.0
NEGATION_REACH = 3

INSULT, THREAT, TARGET, NEGATION, REPORT, END = "insult threat target negation report end".split()
BUILT_IN = {
    INSULT: "idiot idiots moron morons imbecile scum loser losers trash worthless pathetic disgusting stupid vermin filth clown dumb idiota imbécil basura idiot dummkopf abschaum idiote crétin ordure".split(),
    THREAT: "kill hurt destroy beat burn stab shoot strangle matar matarte töten umbringen tuer frapper".split(),
    TARGET: "you your yours yourself u they them their he him she her tú ti usted ustedes du dich dir ihr euch sie toi tu vous ils elles lui".split(),
    NEGATION: "not no never neither nor nobody cannot nicht kein keine nie nunca jamás sin ne pas jamais".split(),
    REPORT: "said says say wrote writes quoted quote claimed reported called sagte sagt schrieb dijo dice escribió dit écrit disait".split(),
}
BUILT_IN_WEIGHT = 3.0
SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, END)
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n"]] = True
#: Intercept and weights of log1p(sum), log1p(sum per 100 words), log1p(largest clause) if nothing can be fitted.
FALLBACK = (-4.0, 1.0, 1.0, 0.5)
PLAIN = np.arange(256, dtype=np.uint8)
#: (bytes of the part or 0 for a whole word, word or part, symbol number, weight)
Arc = tuple[int, bytes, int, float]


@dataclass(frozen=True)
class Machine:
    """States from 0; step[symbol][state] = next state, factor[symbol][state] multiplies what is emitted there."""

    states: int
    step: dict[str, tuple[int, ...]] = field(default_factory=dict)
    factor: dict[str, tuple[float, ...]] = field(default_factory=dict)


#: Emission starts at 1 for insults, THREAT_WEIGHT for threats that follow a target, little otherwise.
EMIT = Machine(1, {}, {INSULT: (1.0,), THREAT: (0.6,), TARGET: (0.0,), NEGATION: (0.0,), REPORT: (0.0,), END: (0.0,)})
ADDRESSED = Machine(2, {TARGET: (1, 1), END: (0, 0)}, {INSULT: (1.0, 1.3), THREAT: (0.1, 1.5)})
REPORTED = Machine(2, {REPORT: (1, 1), END: (0, 0)}, {INSULT: (1.0, 0.6), THREAT: (1.0, 0.4)})
#: State n: the negation still reaches n words.
NEGATED = Machine(
    NEGATION_REACH + 1,
    {NEGATION: (NEGATION_REACH,) * (NEGATION_REACH + 1), END: (0,) * (NEGATION_REACH + 1)},
    {INSULT: (1.0,) + (0.5,) * NEGATION_REACH, THREAT: (1.0,) + (0.3,) * NEGATION_REACH},
)


def compose(*machines: Machine) -> Machine:
    """The product machine: states are numbered combinations, factors multiply."""
    out = Machine(1)
    for m in machines:
        step, factor = {}, {}
        for s in SYMBOLS:
            a, b = out.step.get(s, tuple(range(out.states))), m.step.get(s, tuple(range(m.states)))
            fa, fb = out.factor.get(s, (1.0,) * out.states), m.factor.get(s, (1.0,) * m.states)
            step[s] = tuple(a[i] * m.states + b[j] for i in range(out.states) for j in range(m.states))
            factor[s] = tuple(fa[i] * fb[j] for i in range(out.states) for j in range(m.states))
        out = Machine(out.states * m.states, step, factor)
    return out


#: Negation comes last, so its state is the product's state modulo its size.
GRAMMAR = compose(EMIT, ADDRESSED, REPORTED, NEGATED)


@dataclass
class Lexicon:
    """Hashes of words (length 0) or of first parts of `length` bytes, with symbol numbers and weights."""

    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    arcs: list[Arc]

    @staticmethod
    def of(arcs: list[Arc]) -> Lexicon:
        tables = {}
        for length in sorted({a[0] for a in arcs}):
            own = {a[1]: a for a in arcs if a[0] == length}
            texts = list(own)
            hashes = words_of(pa.array(texts, pa.binary()), np.zeros(256, bool), PLAIN).hashes()
            order = np.argsort(hashes)
            symbols = np.array([a[2] for a in own.values()], np.int8)
            weights = np.array([a[3] for a in own.values()])
            tables[length] = hashes[order], symbols[order], weights[order]
        return Lexicon(tables, arcs)

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Symbol (-1: none) and weight of each word; the heaviest arc counts."""
        symbol, weight = np.full(len(words.start), -1, np.int8), np.zeros(len(words.start))
        for length, (known, symbols, weights) in self.tables.items():
            fits = np.ones(len(words.start), bool) if not length else words.end - words.start >= length
            at = np.flatnonzero(fits)
            hashes = words.hashes(length or None)[at]
            sieve = np.zeros(1 << 16, bool)
            sieve[known & np.uint64(0xFFFF)] = True
            maybe = np.flatnonzero(sieve[hashes & np.uint64(0xFFFF)])
            place = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
            hit = known[place] == hashes[maybe]
            at, place = at[maybe[hit]], place[hit]
            better = weights[place] > weight[at]
            symbol[at[better]], weight[at[better]] = symbols[place[better]], weights[place[better]]
        return symbol, weight


def built_in_arcs() -> list[Arc]:
    """Whole-word arcs of the built-in lists."""
    found = {}
    for name, words in BUILT_IN.items():
        for w in words:
            found.setdefault(w, (0, w, SYMBOLS.index(name), BUILT_IN_WEIGHT if name in (INSULT, THREAT) else 1.0))
    return [(n, w.encode(), s, v) for n, w, s, v in found.values()]


def clause_scores(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """(sum of clauses, words, largest clause, matched clauses) of each text."""
    words = words_of(pc.utf8_lower(texts.fill_null("")), GAP, PLAIN)
    n = len(words.offsets) - 1
    out = np.zeros((n, 4))
    out[:, 1] = words.counts()
    symbol, weight = lexicon.read(words)
    strong = np.zeros(n, bool)
    strong[words.doc[(symbol == 0) | (symbol == 1)]] = True
    use = np.flatnonzero((symbol >= 0) & strong[words.doc])
    if not len(use):
        return out
    breaks = np.cumsum(BREAK[words.data])
    clause = breaks[words.start[use]]
    step = [GRAMMAR.step[s] for s in SYMBOLS]
    factor = [GRAMMAR.factor[s] for s in SYMBOLS]
    reach = NEGATION_REACH + 1
    state, before, sums = 0, None, 0.0

    def close(doc: int, total: float) -> None:
        if total > 0:
            out[doc, 0] += total
            out[doc, 2] = max(out[doc, 2], total)
            out[doc, 3] += 1

    for doc, at, c, s, w in zip(words.doc[use].tolist(), use.tolist(), clause.tolist(), symbol[use].tolist(), weight[use].tolist()):
        if before is None or before[0] != doc or before[2] != c:
            if before is not None:
                close(before[0], sums)
            state, sums = 0, 0.0
        else:
            left = state % reach
            state -= min(left, at - before[1] - 1)
        sums += factor[s][state] * w
        state = step[s][state]
        before = (doc, at, c)
    close(before[0], sums)
    return out


def features(scores: np.ndarray) -> np.ndarray:
    total, words, largest = scores[:, 0], scores[:, 1], scores[:, 2]
    return np.column_stack([np.ones(len(scores)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 20)), np.log1p(largest)])


def _chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of consecutive parts of about `most` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def _lowered(texts: list[str]) -> Words:
    return words_of(pc.utf8_lower(pa.array(texts, pa.string())), GAP, PLAIN)


def _clauses_of(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    parts = [clause_scores(pa.array(t, pa.string()), lexicon) for _, t in _chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def learned_arcs(texts: list[str], toxic: np.ndarray) -> list[Arc]:
    """Insult arcs over words and first parts that toxic documents hold far more often."""
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    lengths = (0, *PART_BYTES)
    chosen = {}
    for length in lengths:
        # One length at a time bounds what the driver holds.
        parts = []
        for begin, part in _chunks(texts):
            words = _lowered(part)
            own = np.flatnonzero(words.end - words.start >= length)
            hashes, docs = _distinct(words.hashes(length or None)[own], words.doc[own])
            parts.append((hashes, (docs + begin).astype(np.int32)))
        term, doc = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(term, kind="stable")
        term, doc = term[order], doc[order]
        heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        if not len(heads):
            continue
        in_toxic = np.add.reduceat(toxic[doc].astype(np.int32), heads)
        in_clean = np.add.reduceat((~toxic[doc]).astype(np.int32), heads)
        odds = np.log((in_toxic + 0.5) / (n_toxic + 1)) - np.log((in_clean + 0.5) / (n_clean + 1))
        use = np.flatnonzero((in_toxic >= MIN_TOXIC) & (odds >= MIN_WEIGHT))
        chosen[length] = dict(zip(term[heads[use]].tolist(), odds[use].tolist()))
    arcs = {}
    for _, part in _chunks(texts):
        words = _lowered(part)
        for length, weights in chosen.items():
            if len(weights) == 0:
                continue
            own = np.flatnonzero(words.end - words.start >= length)
            hashes = words.hashes(length or None)[own]
            for i in np.flatnonzero(np.isin(hashes, np.array(list(weights), np.uint64))).tolist():
                at = own[i]
                stop = words.end[at] if not length else words.start[at] + length
                text = words.data[words.start[at] : stop].tobytes()
                arcs[length, text] = (length, text, 0, weights[int(hashes[i])])
    return list(arcs.values())


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, document), in order of hash."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
    return h[new], d[new]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        clauses = clause_scores(texts, self.lexicon)
        return 1 / (1 + np.exp(-np.clip(features(clauses) @ np.array(self.weights), -30, 30))), clauses


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled texts on the driver, whose number the caller bounds."""
    distinct = dict(zip(texts, toxic))
    texts, y = list(distinct), np.array(list(distinct.values()), bool)
    base = built_in_arcs()
    if not y.any() or y.all():
        return Model(Lexicon.of(base), FALLBACK)
    # Arcs are learned on one half and judged on the other, so that the logistic sees honest clause scores.
    half = np.arange(len(y)) % 2 == 0
    x = np.zeros((len(y), 4))
    for own in (half, ~half):
        lexicon = Lexicon.of(_merged(base, learned_arcs([t for t, o in zip(texts, own) if o], y[own])))
        rest = np.flatnonzero(~own)
        x[rest] = features(_clauses_of([texts[i] for i in rest], lexicon))
    return Model(Lexicon.of(_merged(base, learned_arcs(texts, y))), tuple(logistic(x, y.astype(float))))


def _merged(base: list, learned: list) -> list:
    """Learned arcs replace built-in ones of the same word, but for words that are targets, negations or reports."""
    fixed = {(a[0], a[1]) for a in base if a[2] > 1}
    own = {(a[0], a[1]): a for a in base}
    own.update({(a[0], a[1]): a for a in learned if (a[0], a[1]) not in fixed})
    return list(own.values())


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """At most MOST_TOXIC + MOST_CLEAN labelled rows (text, label) that are not held out."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("_label")).filter(~held_out("doc_id") & F.col("_label").isin(0, 1))
    first = lambda value, n: rows.filter(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, MOST_TOXIC).union(first(0, MOST_CLEAN))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_label")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    # Ids may repeat: of more rows than twice the labels, those with the smallest hashes of their texts.
    told = training_rows(docs, labels).filter("text is not null")
    rows = told.orderBy(F.xxhash64("text"), "text", "_label").limit(2 * (MOST_TOXIC + MOST_CLEAN)).toArrow()
    order = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    return fit([t for t, _ in order], [y for _, y in order])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add toxicity, toxic_clauses and clause_sum to each row; input columns of these names are replaced."""
    plain = docs.drop("toxicity", "toxic_clauses", "clause_sum")
    at = plain.columns.index(text)
    schema = StructType(list(plain.schema.fields)).add("toxicity", "double").add("toxic_clauses", "long").add("clause_sum", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            p, clauses = model.score(batch.column(at))
            arrays = [*batch.columns, pa.array(p), pa.array(clauses[:, 3].astype(np.int64)), pa.array(clauses[:, 0])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return plain.mapInArrow(run, schema)
