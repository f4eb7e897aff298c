"""Whitening and vector codes against plain arithmetic, and odd input."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stmtflow.llm import trie_codes, whitening

VECTORS = "vec_id bigint, embedding array<double>, label int"


def frame(spark, vectors, schema=VECTORS):
    return spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors)], schema)


def random_vectors(n, dim, seed=1, spread=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) * np.linspace(spread, 0.2, dim)).tolist()


def plain_characteristic(m):
    """Faddeev and LeVerrier's recurrence in fractions, lowest power first."""
    d = len(m)
    a, c, coefficients = [[Fraction(0)] * d for _ in range(d)], Fraction(1), [Fraction(1)]
    for k in range(1, d + 1):
        a = [[sum(m[i][t] * a[t][j] for t in range(d)) + (c if i == j else 0) for j in range(d)] for i in range(d)]
        c = -sum(m[i][t] * a[t][i] for i in range(d) for t in range(d)) / k
        coefficients.append(c)
    return [int(v) for v in reversed(coefficients)]


def test_characteristic_polynomial(spark):
    rng = random.Random(4)
    for d in (1, 2, 5, 9):
        x = [[rng.randrange(-10**9, 10**9) for _ in range(d)] for _ in range(d + 1)]
        m = [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]
        assert whitening.characteristic(spark, m) == plain_characteristic(m)
    # Ones throughout: elimination meets empty columns.
    assert whitening.characteristic(spark, [[1] * 4] * 4) == [0, 0, 0, -4, 1]


def test_exact_products():
    rng = np.random.default_rng(2)
    for most in (3, 1 << 19, 1 << 40, 1 << 52):
        y = rng.integers(-most, most, size=(50, 4))
        want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(4)] for i in range(4)]
        assert whitening.gram(y).tolist() == want


def test_roots():
    # (x - 2)^3 (x - 5) (x - 7)^2, and one with roots close together: x^2 - 2x + (1 - 10^-20) scaled to whole numbers.
    poly = [1]
    for r in (2, 2, 2, 5, 7, 7):
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    found = [whitening.root(poly, k) for k in range(1, 7)]
    assert [round(float(v), 12) for v, _ in found] == [7, 7, 5, 2, 2, 2] and [e for _, e in found] == [0, 1, 0, 0, 1, 2]
    close = [10**40 - 1, -2 * 10**20, 1]
    values = [whitening.root(close, k) for k in (1, 2)]
    assert [abs(v - w) < Fraction(1, 10**20) for (v, _), w in zip(values, (10**20 + 1, 10**20 - 1))] == [True, True]
    assert [e for _, e in values] == [0, 0]
    assert whitening.roots_above(poly, 2) == 3 and whitening.roots_above(poly, 1) == 6 and whitening.roots_above(poly, 7) == 0


@pytest.mark.parametrize("n, dim", [(40, 6), (300, 20)])
def test_whitening_equals_plain_arithmetic(spark, n, dim):
    vectors = random_vectors(n, dim)
    vectors += vectors[:5]
    rows, fit = whitening.whiten(frame(spark, vectors), keep=["vec_id"])
    x = np.floor(np.array(vectors) * 64).astype(int) + 1_000_000
    own = np.unique(x, axis=0)
    size, sums = len(own), own.sum(axis=0)
    assert fit.n == size
    values, axes = np.linalg.eigh(np.cov(own.T, bias=True))
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    assert np.allclose(fit.variances, values, rtol=1e-9) and np.allclose(fit.explained, values / np.trace(np.cov(own.T, bias=True)), rtol=1e-9)
    assert np.allclose(np.abs(np.array(fit.components) @ axes), np.eye(len(values)), atol=1e-7)
    assert np.allclose(np.array(fit.components) @ np.array(fit.components).T, np.eye(len(values)), atol=1e-14)
    assert fit.identity_error < 1e-9
    got = {r.vec_id: r for r in rows.collect()}
    assert len(got) == len(vectors)
    for i, v in enumerate(x):
        assert int(got[i].deviation) == sum((size * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
        want = (v - sums / size) @ np.array(fit.components).T / np.sqrt(fit.variances)
        assert np.allclose(got[i].whitened, want, atol=1e-6)


def test_equal_eigenvalues(spark):
    """Signed unit vectors: the covariance is a multiple of the identity, so any orthonormal axes serve."""
    dim = 5
    vectors = [[float(s * (i == j)) for j in range(dim)] for i in range(dim) for s in (1, -1)]
    rows, fit = whitening.whiten(frame(spark, vectors))
    axes = np.array(fit.components)
    assert np.allclose(axes @ axes.T, np.eye(dim), atol=1e-14) and np.allclose(fit.explained, 1 / dim)
    assert fit.identity_error < 1e-12 and rows.count() == 2 * dim


def test_low_rank(spark):
    line = [[float(t), 2.0 * t, 0.0, 1.0] for t in range(6)]
    rows, fit = whitening.whiten(frame(spark, line))
    assert len(fit.components) == 1 and math.isclose(fit.explained[0], 1.0) and fit.identity_error < 1e-12
    assert {len(r.whitened) for r in rows.collect()} == {1}


def test_whitening_of_odd_rows(spark):
    vectors = [[1.0, 2.0], None, [1.0, None], [float("nan"), 0.0], [float("inf"), 0.0], [0.0, 0.5], [3.0, 1.0, 1.0], [0.25, -1.0]]
    rows = [(i if i else None, v, "own") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, whitened string")
    got, fit = whitening.whiten(df)
    assert got.columns == ["vec_id", "embedding", "deviation", "whitened"]
    assert {r.vec_id for r in got.collect()} == {None, 5, 7} and fit.n == 3 and len(fit.components) == 2
    for few in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]]):
        got, fit = whitening.whiten(frame(spark, few))
        assert got.collect() == [] and fit.components == [] and got.columns == ["vec_id", "embedding", "label", "deviation", "whitened"]


def plain_codes(vectors, parts, entries, rounds, scale):
    """Lloyd's rounds in plain Python."""
    whole = [[math.floor(scale * c) for c in v] for v in vectors]
    width = -(-len(whole[0]) // parts)
    whole = [v + [0] * (parts * width - len(v)) for v in whole]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def assign(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            homes = {}
            for v in cut:
                homes.setdefault(assign(p, v[p])[1], []).append(v[p])
            new.append([[sum(c) // len(c) for c in zip(*homes[e])] if e in homes else books[p][e] for e in range(len(books[p]))])
        books = new
    coded = [[assign(p, v[p]) for p in range(parts)] for v in cut]
    return ["".join(f"{i:02x}" for _, i in c) for c in coded], [sum(e for e, _ in c) for c in coded], books


@pytest.mark.parametrize("n, dim, parts, entries, scale", [(150, 16, 8, 16, 4096), (90, 7, 3, 5, 4), (9, 8, 4, 16, 64), (60, 4, 2, 4, 1)])
def test_codes_equal_plain_rounds(spark, monkeypatch, n, dim, parts, entries, scale):
    """Small scales give long common prefixes and ties; small runs cut the traversal often."""
    monkeypatch.setattr(trie_codes, "RUN", 16)
    vectors = random_vectors(n, dim, seed=n)
    coded, books = trie_codes.encode(frame(spark, vectors), parts=parts, entries=entries, rounds=4, scale=scale)
    codes, errors, want = plain_codes(vectors, parts, entries, 4, scale)
    got = sorted(coded.collect(), key=lambda r: r.vec_id)
    assert [r.code for r in got] == codes and [r.error for r in got] == errors
    assert books.books == want
    assert books.sha256 == hashlib.sha256(",".join(str(v) for b in want for e in b for v in e).encode()).hexdigest()
    assert len(books.decode(codes[0])) == parts * -(-dim // parts)


def test_label_errors_and_odd_rows(spark):
    vectors = [[1.0, 2.0], None, [1.0, None], [float("nan"), 0.0], [0.0, float("-inf")], [0.0, 0.5], [1.0, 2.0], [3.0], [0.25, -1.0]]
    rows = [(None if i == 5 else i, v, None if i in (0, 6) else 1, "own") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, code string")
    coded, books = trie_codes.encode(df, parts=2, entries=2, rounds=2, scale=8)
    assert coded.columns == ["vec_id", "embedding", "label", "code", "error"]
    # The null id comes last, so the books begin with the vectors 0 and 6, which are equal.
    summed = trie_codes.with_label_error(coded).collect()
    assert {r.vec_id for r in summed} == {0, None, 6, 8} and all(len(r.code) == 4 for r in summed)
    for r in summed:
        assert r.label_error == sum(s.error for s in summed if s.label == r.label)
    for few in ([], [None], [[]]):
        got, books = trie_codes.encode(frame(spark, few))
        assert got.collect() == [] and got.columns == ["vec_id", "embedding", "label", "code", "error"]
    one, books = trie_codes.encode(frame(spark, [[0.5] * 16] * 3))
    assert {(r.code, r.error) for r in one.collect()} == {("00" * 8, 0)}


def test_hot_part(spark):
    """A vector that a third of the rows share is one leaf."""
    vectors = [[0.5] * 8 if i % 3 == 0 else v for i, v in enumerate(random_vectors(120, 8))]
    coded, _ = trie_codes.encode(frame(spark, vectors), parts=4, entries=8)
    codes, errors, _ = plain_codes(vectors, 4, 8, 6, 4096)
    assert [(r.code, r.error) for r in coded.orderBy("vec_id").select("code", "error").collect()] == list(zip(codes, errors))
    assert coded.filter(F.col("code").isNull()).count() == 0
