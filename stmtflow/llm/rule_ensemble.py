r"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark expressions. Shallow boosted trees are grown on labelled rows; each path from a root to a node
is a rule, a conjunction of thresholds. A logistic with lasso penalty weighs the rules (and thereby keeps few),
and the rules that stay are compiled into one Spark column, so scoring runs in the JVM without Python.

Trees and weights are fitted on the driver on at most MOST_ROWS labelled rows of numbers, those with the smallest
hash of the id. Equal statistics with equal labels count as often as they come.

Null and empty texts have statistics of 0 and get the score that the rules give those. Rows with a null label are
not learned from. Without labels of both kinds the score is the smoothed share of the kind seen, 0.5 without any.
Repeated rows get equal scores; other columns are passed on; texts are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.llm.common import SPACES, held_out

MOST_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_ROWS, RATE = 24, 3, 32, 20, 0.3
LASSO = 0.002


def statistics(text: str = "text") -> dict[str, Column]:
    """Statistics of a text by name; they use the columns that `with_statistics` puts beside it."""
    chars, letters = F.col("_chars"), F.greatest(F.col("_letters"), F.lit(1))
    words, lines = F.greatest(F.col("_n_words"), F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    some = F.greatest(chars, F.lit(1))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "upper_share": F.col("_upper") / letters,
        "letter_share": F.col("_letters") / some,
        "digit_share": F.col("_digits") / some,
        "symbol_share": F.col("_symbols") / some,
        "marks_per_word": F.col("_marks") / words,
        "shouts_per_word": F.col("_shouts") / words,
        "distinct_words": F.col("_n_distinct") / words,
        "word_length": (chars - F.col("_spaces")) / words,
        "distinct_lines": F.size(F.array_distinct("_lines")) / lines,
        "words_per_line": F.col("_n_words") / lines,
    }


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """Add the statistics as columns _s_<name>; returns their names too."""
    whole = F.coalesce(F.col(text), F.lit(""))
    count = lambda drop: F.char_length(F.regexp_replace(whole, drop, "")).cast("double")
    cut = docs.withColumns(
        {
            "_chars": F.char_length(whole).cast("double"),
            "_upper": count(r"[^A-ZÀ-Þ]+"),
            "_letters": count(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"),
            "_digits": count(r"[^0-9]+"),
            "_symbols": count(r"[^#$%&*@^~|<>{}\\=+_/\[\]]+"),
            "_marks": count(r"[^.,;:]+"),
            "_shouts": count(r"[^!?]+"),
            "_spaces": count(r"[^\x20\x09-\x0D]+"),
            "_words": F.array_remove(F.split(whole, SPACES), ""),
            "_lines": F.split(whole, "\n"),
        }
    ).withColumns({"_n_words": F.size("_words").cast("double"), "_n_distinct": F.size(F.array_distinct("_words")).cast("double")})
    found = statistics(text)
    named = {f"_s_{k}": v.cast("double") for k, v in found.items()}
    return cut.select(*docs.columns, *[v.alias(k) for k, v in named.items()]), list(named)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): value > threshold if above, else value <= threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) == above
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            out = out & ((F.col(names[f]) > F.lit(t)) if above else (F.col(names[f]) <= F.lit(t)))
        return out


def thresholds(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]


def grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, hessian: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """One tree on gradients: the rules of its nodes and its prediction for each row."""
    rules, out = [], np.zeros(len(x))

    def split(rows: np.ndarray, terms: tuple, left: int) -> None:
        g, h = residual[rows].sum(), hessian[rows].sum()
        out[rows] = g / (h + 1.0)
        if terms:
            rules.append(Rule(terms))
        if not left or len(rows) < 2 * LEAST_ROWS:
            return
        best = (1e-6, None)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = binned[rows, f]
            n = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
            gl = np.cumsum(np.bincount(b, residual[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hessian[rows], len(cut) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (f, at))
        if best[1] is None:
            return
        f, at = best[1]
        above = binned[rows, f] > at
        split(rows[~above], (*terms, (f, False, float(cuts[f][at]))), left - 1)
        split(rows[above], (*terms, (f, True, float(cuts[f][at]))), left - 1)

    split(np.arange(len(x)), (), depth)
    return rules, out


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct rules of TREES boosted trees."""
    cuts = thresholds(x)
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    margin, found = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules, step = grow(x, binned, cuts, y - p, p * (1 - p), DEPTH)
        margin = margin + RATE * step
        found.update(dict.fromkeys(rules))
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a logistic, by accelerated proximal gradient steps."""
    n, k = z.shape
    size = np.linalg.norm(z, 2) ** 2 / n + 1 if k else 1.0
    step = 4.0 / size
    w = v = np.zeros(k)
    b = c = math.log((y.sum() + 1) / (n - y.sum() + 1))
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        u = v - step * (z.T @ r) / n
        u = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = u + (t - 1) / t2 * (u - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = u, b2, t2
    return b, w


@dataclass
class Model:
    names: list[str]
    intercept: float
    rules: list[tuple[Rule, float]]

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for rule, weight in self.rules:
            out = out + F.when(rule.column(self.names), F.lit(weight)).otherwise(F.lit(0.0))
        return out

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        show = lambda r: " and ".join(f"{self.names[f].removeprefix('_s_')} {'>' if a else '<='} {t:.4g}" for f, a, t in r.terms)
        return [f"{w:+.3f} if {show(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(names, math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    rules = tree_rules(x, y)
    if not rules:
        return Model(names, math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    z = np.column_stack([r.holds(x) for r in rules]).astype(float)
    b, w = lasso(z, y)
    return Model(names, b, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on at most MOST_ROWS labelled rows that are not held out."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("_label")).filter(~held_out("doc_id") & F.col("_label").isin(0, 1))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(MOST_ROWS)
    told, names = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # Ids may repeat: the bound takes rows in order of id, then of their statistics.
    got = told.select("doc_id", "_label", *names).orderBy("doc_id", *names, "_label").limit(2 * MOST_ROWS).toPandas()
    return fit(got[names].to_numpy(float), got["_label"].to_numpy(float), names)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `quality_score`, the rules' probability of a good text; an input column of that name is replaced."""
    own = [c for c in docs.columns if c != "quality_score"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), F.col(text).alias("_text"))
    told, _ = with_statistics(packed, "_text")
    return told.select("_doc.*", (1 / (1 + F.exp(-model.margin()))).alias("quality_score"))
