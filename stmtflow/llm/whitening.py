"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Components become whole numbers x = floor(scale * c) + offset. The fit list holds each distinct x vector once; n of them
with sums S give the integer scatter M = n * sum(x x') - S S', which is n^2 times the covariance V. M does not depend on
the offset, so it is summed over x - offset, whose products are small; all sums are exact.

1. Scatter: tasks sum exact products over their distinct vectors, Spark adds these sums up.
2. Characteristic polynomial: M modulo a 31-bit prime is brought to Hessenberg form by elimination, whose polynomial follows
   by recurrence. The eigenvalues are not negative, so the coefficients are bounded by Maclaurin's inequality from the trace alone:
   that many primes are taken, dealt over Spark's tasks, and the residues are put together by Chinese remaindering.
3. Roots: all roots of the polynomial are real, so by Budan and Fourier the number of roots above a is exactly the number of
   sign changes among the Taylor coefficients at a. Bisection on this whole-number count isolates the k-th root, whatever its
   multiplicity; once it is alone, the sign of the polynomial narrows it further, to PRECISION bits. Components are dealt over
   Spark's tasks too.
4. Components: M - root * I is factored in DIGITS decimal digits, and inverse iteration from fixed starts gives its null space;
   for equal roots, one vector after the other is made orthogonal to those before. Signs: the largest entry is positive.
5. Rows are projected in parallel. The identity error is measured on the whitened fit list, again by sums of tasks.

Only matrices of dim x dim, one residue vector per prime and the components reach the driver: sizes set by the dimension and
by the number of digits of n, not by the rows.

Vectors that are null or hold null or non-finite components are dropped, and those whose length is not that of most. Rows with
null ids stay. Repeated vectors count once in the fit and are whitened row by row. Components with eigenvalue 0 have no
whitened value and are left out: equal vectors throughout, one row only or an empty table give no rows. Columns of the
added names in the input are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stmtflow.llm.common import Scratch, shuffle_width
from stmtflow.llm.vectors import common_length, rows_of, whole_rows

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Bits to which an eigenvalue is known, and decimal digits of the inverse iteration.
PRECISION, DIGITS = 160, 90
#: Bits of a limb, and rows of a block whose limb products add up exactly in floats.
LIMB, BLOCK = 20, 4096
WIDE = pa.decimal128(38, 0)


# Exact sums


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as floats of LIMB bits, lowest first; the last one carries the sign."""
    parts = []
    while np.abs(y).max(initial=0) >= 1 << LIMB:
        parts.append((y & ((1 << LIMB) - 1)).astype(float))
        y = y >> LIMB
    return [*parts, y.astype(float)]


def gram(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers of any size."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for lo in range(0, len(y), BLOCK):
        parts = limbs(y[lo : lo + BLOCK])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def _scatter_sums(fit: DataFrame, dim: int) -> tuple[list[list[int]], list[int]]:
    """Exact sums of products and of vectors of the fit list."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, plain = np.zeros((dim, dim), dtype=object), np.zeros(dim, dtype=object)
        for batch in batches:
            y = rows_of(batch.column("x"), dim)
            squares += gram(y)
            plain += np.array([int(v) for v in y.sum(axis=0)], dtype=object)
        i, j = np.triu_indices(dim)
        values = [*squares[i, j], *plain]
        where = [*(i * dim + j), *range(dim * dim, dim * dim + dim)]
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array([Decimal(int(v)) for v in values], WIDE)], ["at", "value"])

    parts = fit.select("x").mapInArrow(sums, "at bigint, value decimal(38,0)")
    found = {r.at: int(r.value) for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    squares = [[found[min(i, j) * dim + max(i, j)] for j in range(dim)] for i in range(dim)]
    return squares, [found[dim * dim + i] for i in range(dim)]


# Characteristic polynomial


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with the bases that decide it for numbers below 3 * 10^9."""
    if n % 2 == 0:
        return n == 2
    d, twos = n - 1, 0
    while d % 2 == 0:
        d, twos = d // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds a bound."""
    found, product, candidate = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def characteristic_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(xI - M) modulo a prime, lowest power first."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], dtype=np.int64).reshape(d, d)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(d):
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] = (polys[k + 1] - int(h[k, k]) * polys[k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            polys[k + 1] = (polys[k + 1] - chain * int(h[i, k]) % p * polys[i] % p) % p
    return [int(c) for c in polys[d]]


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Whole numbers from their residues, each below the product of the primes."""
    product = math.prod(p for p, _ in residues)
    total = [0] * len(residues[0][1])
    for p, values in residues:
        rest = product // p
        unit = rest * pow(rest, -1, p)
        total = [t + unit * v for t, v in zip(total, values)]
    return [t % product for t in total]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(xI - M), lowest power first, of a matrix without negative eigenvalues."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    primes = primes_for(max(math.comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [primes[i] for i in batch.column("id").to_pylist()]
            found = [[str(c) for c in characteristic_mod(matrix, p)] for p in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["p", "values"])

    dealt = spark.range(0, len(primes), 1, min(len(primes), shuffle_width(spark)))
    rows = dealt.mapInArrow(step, "p bigint, values array<string>").collect()
    # det(xI - M) has signs in turn; e_k, the k-th symmetric sum of eigenvalues, is not negative.
    sums = remaindered([(r.p, [int(c) * (-1) ** (d - i) % r.p for i, c in enumerate(r["values"])]) for r in rows])
    if sums[d] != 1 or sums[d - 1] != trace:
        raise ArithmeticError("the characteristic polynomial does not fit the trace")
    return [s * (-1) ** (d - i) for i, s in enumerate(sums)]


# Roots


def roots_above(poly: list[int], at: int) -> int:
    """Roots above a whole number, with multiplicity, of a polynomial whose roots are all real."""
    shifted = list(poly)
    for i in range(len(shifted) - 1):
        for j in range(len(shifted) - 2, i - 1, -1):
            shifted[j] += at * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_at(poly: list[int], at: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * at + c
    return value


def magnified(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    d = len(poly) - 1
    return [c << bits * (d - i) for i, c in enumerate(poly)]


def root(poly: list[int], k: int, precision: int = PRECISION) -> tuple[Fraction, int]:
    """The k-th largest root, from 1, of a polynomial with real roots, and how many of its copies (to the precision) come before."""
    # No root exceeds the sum of them all, and the search starts from whole numbers.
    bits, low, high = 0, 0, -poly[-2] + 1
    above_low, above_high = len(poly) - 1, 0
    while True:
        scaled = magnified(poly, bits)
        while high - low > 1 and above_low - above_high > 1:
            middle = (low + high) // 2
            n = roots_above(scaled, middle)
            if n >= k:
                low, above_low = middle, n
            else:
                high, above_high = middle, n
        if above_low - above_high == 1:
            # Alone in (low, high]: the sign above the root is that at the upper end.
            sign = value_at(scaled, high)
            if sign == 0:
                return Fraction(high, 1 << bits), k - 1 - above_high
            while high - low > 1:
                middle = (low + high) // 2
                here = value_at(scaled, middle)
                if here == 0:
                    return Fraction(middle, 1 << bits), k - 1 - above_high
                low, high = (low, middle) if (here > 0) == (sign > 0) else (middle, high)
        if low.bit_length() >= precision:
            return Fraction(2 * low + 1, 2 << bits), k - 1 - above_high
        more = max(8, precision - low.bit_length() + 1)
        bits, low, high = bits + more, low << more, high << more


# Null space


def null_vectors(matrix: list[list[int]], value: Fraction, count: int) -> list[list[Decimal]]:
    """`count` orthonormal vectors of the eigenvalue, by inverse iteration with one factoring in decimal digits."""
    d = len(matrix)
    with localcontext(Context(prec=DIGITS)):
        shift = Decimal(value.numerator) / Decimal(value.denominator)
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object).reshape(d, d)
        for i in range(d):
            a[i, i] -= shift
        largest = max((abs(v) for v in a.flat), default=Decimal(1)) or Decimal(1)
        tiny = largest * Decimal(10) ** (10 - DIGITS)
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda r: abs(a[r, k]))
            if pivot != k:
                a[[pivot, k]] = a[[k, pivot]]
                order[pivot], order[k] = order[k], order[pivot]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solve(b: np.ndarray) -> np.ndarray:
            x = b[order].copy()
            for i in range(d):
                x[i + 1 :] = x[i + 1 :] - a[i + 1 :, i] * x[i]
            for i in range(d - 1, -1, -1):
                x[i] = x[i] / a[i, i]
                x[:i] = x[:i] - a[:i, i] * x[i]
            return x

        def unit(x: np.ndarray) -> np.ndarray:
            x = x / max(abs(v) for v in x)
            for v in found:
                x = x - v * np.dot(v, x)
            return x / np.dot(x, x).sqrt()

        found: list[np.ndarray] = []
        for number in range(count):
            # Fixed starts without symmetry, different for each vector.
            x = np.array([Decimal(1) / Decimal(1 + (i * (number + 1) * 7 + number) % (2 * d + 1)) for i in range(d)], dtype=object)
            for _ in range(3):
                x = unit(unit(solve(x)))
            most = max(range(d), key=lambda i: (abs(x[i].normalize(Context(prec=12))), -i))
            found.append(x if x[most] > 0 else -x)
        return [list(v) for v in found]


# The operator


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors with sums (of x without the offset), components, and their eigenvalues of V as floats."""

    dim: int
    n: int
    sums: list[int]
    components: list[list[float]]
    variances: list[float]
    explained: list[float]
    identity_error: float = 0.0

    def project(self, y: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Exact deviations sum((n x - S)^2), and whitened rows."""
        total = np.array(self.sums, dtype=object)
        most = self.n * int(np.abs(y).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if most * most * max(self.dim, 1) < 1 << 62:
            centred = y * self.n - total.astype(np.int64)
            deviations = (centred * centred).sum(axis=1).tolist()
        else:
            centred = y.astype(object) * self.n - total
            deviations = (centred * centred).sum(axis=1).tolist()
        size = np.sqrt(np.array(self.variances)) * self.n
        return deviations, centred.astype(float) @ np.array(self.components).reshape(-1, self.dim).T / size


def fit_components(spark: SparkSession, n: int, squares: list[list[int]], sums: list[int], components: int) -> Whitening:
    """The components of a fit list from its exact sums."""
    dim = len(sums)
    scatter = [[n * squares[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    trace = sum(scatter[i][i] for i in range(dim))
    if not trace:
        return Whitening(dim, n, sums, [], [], [])
    poly = characteristic(spark, scatter)
    rank = dim - next(i for i, c in enumerate(poly) if c)
    positive = poly[dim - rank :]
    wanted = min(components, rank)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, vectors, variances, shares = [], [], [], []
            for k in batch.column("id").to_pylist():
                value, earlier = root(positive, k)
                numbers.append(k)
                vectors.append([float(v) for v in null_vectors(scatter, value, earlier + 1)[earlier]])
                variances.append(float(value / n**2))
                shares.append(float(value / trace))
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip((numbers, vectors, variances, shares), kinds)], ["k", "vector", "variance", "share"]
            )

    dealt = spark.range(1, wanted + 1, 1, wanted).mapInArrow(step, "k bigint, vector array<double>, variance double, share double")
    rows = sorted(dealt.collect(), key=lambda r: r.k)
    return Whitening(dim, n, sums, [list(r.vector) for r in rows], [r.variance for r in rows], [r.share for r in rows])


def measured_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    size = len(model.components)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, plain = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            w = model.project(rows_of(batch.column("x"), model.dim))[1]
            products += w.T @ w
            plain += w.sum(axis=0)
        values = np.concatenate([products.ravel(), plain])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int64()), pa.array(values)], ["at", "value"])

    rows = fit.select("x").mapInArrow(sums, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(size * size + size)
    for r in rows:
        values[r.at] = r.value
    means = values[size * size :] / model.n
    return float(np.abs(values[: size * size].reshape(size, size) / model.n - np.outer(means, means) - np.eye(size)).max(initial=0))


def whiten(
    vectors: DataFrame, column: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS, scale: int = SCALE
) -> tuple[DataFrame, Whitening]:
    """Rows with `deviation` (a whole number) and `whitened` (one value per component), and the fit.

    `keep` names the columns that stay, else all but those of the added names.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whitening")
    names = [c for c in (vectors.columns if keep is None else keep) if c not in ("deviation", "whitened")]
    dim = common_length(vectors, column)
    rows = scratch(whole_rows(vectors, column, scale, dim, names), "rows")
    fit = scratch(rows.select("x").distinct(), "fit")
    n = fit.count()
    model = fit_components(spark, n, *_scatter_sums(fit, dim), components) if n and dim else Whitening(dim, n, [0] * dim, [], [], [])
    if model.components:
        model = Whitening(**{**model.__dict__, "identity_error": measured_error(fit, model)})

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviations, whitened = model.project(rows_of(batch.column("x"), dim))
            flat = pa.array(whitened.ravel())
            offsets = pa.array(np.arange(len(batch) + 1) * whitened.shape[1], pa.int32())
            own = [batch.column(f"_c{i}") for i in range(len(names))]
            small = max(deviations, default=0) < 1 << 63
            exact = pa.array(deviations, pa.int64()).cast(WIDE) if small else pa.array([Decimal(v) for v in deviations], WIDE)
            yield pa.RecordBatch.from_arrays(
                [*own, exact, pa.ListArray.from_arrays(offsets, flat)],
                [*[f"_c{i}" for i in range(len(names))], "deviation", "whitened"],
            )

    if not model.components:
        empty = rows.limit(0).drop("x").withColumns({"deviation": F.lit(0).cast("decimal(38,0)"), "whitened": F.array().cast("array<double>")})
        return scratch.finish(empty.toDF(*names, "deviation", "whitened")), model
    schema = rows.drop("x").schema.add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))
    return scratch.finish(rows.mapInArrow(project, schema).toDF(*names, "deviation", "whitened")), model
