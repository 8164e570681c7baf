"""Embedding whitening from the exact characteristic polynomial of an integer scatter matrix.

Each component c becomes the integer x = floor(1024 * c) + 100000. One pass adds up x and its products in integers, by task and then by entry of
the matrix, so n * sum(x x') - S S' is exact; all that comes to the driver has the size of that matrix. Its characteristic polynomial is
computed modulo many primes, in Spark tasks, by reduction to Hessenberg form, and put together by Chinese remaindering with as many primes as a bound on
the coefficients asks for. All its roots are real and none is negative, so the sign changes of the shifted polynomial count exactly how many lie above a number: the
greatest ones are isolated by that count, multiple roots included, and then narrowed in integers to 90 bits. The components are null vectors of
matrix minus root, found by inverse iteration whose residuals are exact. A second pass projects all vectors; what it writes gives the covariance
of the result natively, and from it the identity error.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those of another length than most (the
least such length of several). Components without variance (fewer vectors than dimensions, equal vectors) aren't returned, so rows have as many as there are
positive eigenvalues, at most ``components``. Where a component belongs to a multiple eigenvalue, any orthonormal basis of its space is one.
The sign is that of the entry of largest absolute value, made positive. A deviation beyond 64 bits is null; all else is exact for components of any size.
Repeated rows count as often as they are there. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.jobs import numbered, refuse_columns, widened, written
from tilewright.llm.vectors import NARROW, common_length, from_limbs, limbs, matrix, on_grid, whole

COMPONENTS = 8
SHIFT = 100_000
#: Bits to which a root is narrowed, relative to its size, and from which on roots that still lie together are taken for one.
ROOT_BITS, CLUSTER_BITS = 90, 44
VECTOR_BITS = 100
PRIMES_A_TASK = 16
LONG = (1 << 63) - 1


def scatter(kept: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of x - 100000 by dimension, and n * sum(x x') - S S', which the shift doesn't change. All exact."""
    upper = np.triu_indices(d)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros(len(upper[0]), object)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):  # 4096 products of 24-bit numbers are exact in a double's 53 bits only below 2^20
                x = on_grid(matrix(batch.column("vector").slice(at, 4096), d))
                exact = x.astype(np.float64) if x.dtype != object and (not x.size or np.abs(x).max() < 1 << 20) else x
                own = exact.T @ exact
                n, sums = n + len(x), sums + x.sum(0).astype(object)
                products += (own.astype(np.int64) if own.dtype != object else own)[upper].astype(object)
        if n:
            flat = np.concatenate([np.array([n], object), sums, products])
            for k, limb in enumerate(limbs(flat)):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), k)), pa.array(limb)], ["at", "limb", "v"])

    found: dict[int, dict[int, int]] = {}
    for row in kept.select("vector").mapInArrow(add_up, "at long, limb long, v long").groupBy("at", "limb").agg(F.sum("v").alias("v")).collect():  # d * d rows
        found.setdefault(row["at"], {})[row["limb"]] = row["v"]
    flat = [from_limbs(found.get(at, {})) for at in range(1 + d + len(upper[0]))]
    n, sums = flat[0], flat[1 : 1 + d]
    m = [[0] * d for _ in range(d)]
    for i, j, v in zip(*(u.tolist() for u in upper), flat[1 + d :], strict=True):
        m[i][j] = m[j][i] = n * v - sums[i] * sums[j]
    return n, sums, m


def primes_below(top: int, count: int) -> list[int]:
    """The greatest primes below top, odd and under 2^32: strong tests to three bases decide there."""
    out, n = [], top | 1
    while len(out) < count:
        n -= 2
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 7, 61):
            x = pow(base, odd, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
                break
        else:
            out.append(n)
    return out


def hessenberg_polynomials(m: list[list[int]], primes: list[int]) -> np.ndarray:
    """The characteristic polynomial of m modulo each prime: (primes, d + 1) coefficients, the constant first."""
    d, p = len(m), np.array(primes, np.int64)
    whole_m = np.array(m, object)
    a = np.stack([(whole_m % q).astype(np.int64) for q in primes])
    p1, p2 = p[:, None], p[:, None, None]
    for j in range(d - 2):
        for k, q in enumerate(primes):  # a pivot that isn't zero comes below the diagonal, by a swap of rows and columns
            if a[k, j + 1, j] == 0:
                below = np.flatnonzero(a[k, j + 1 :, j])
                if len(below):
                    i = j + 1 + below[0]
                    a[k, [j + 1, i]] = a[k, [i, j + 1]]
                    a[k, :, [j + 1, i]] = a[k, :, [i, j + 1]]
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(a[:, j + 1, j], primes, strict=True)], np.int64)
        u = a[:, j + 2 :, j] * inverse[:, None] % p1
        a[:, j + 2 :] = (a[:, j + 2 :] - u[:, :, None] * a[:, None, j + 1] % p2) % p2
        a[:, :, j + 1] = (a[:, :, j + 1] + (a[:, :, j + 2 :] * u[:, None] % p2).sum(2)) % p1
    polynomials = [np.zeros((len(primes), d + 1), np.int64)]
    polynomials[0][:, 0] = 1
    for k in range(d):
        last = polynomials[-1]
        new = np.zeros_like(last)
        new[:, 1:] = last[:, :-1]
        new = (new - a[:, k, k, None] * last) % p1
        chain = np.ones(len(primes), np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * a[:, i + 1, i] % p
            new = (new - (a[:, i, k] * chain % p)[:, None] * polynomials[i]) % p1
        polynomials.append(new)
    return polynomials[-1]


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """The coefficients of det(t - m), the constant first, of a positive semidefinite integer matrix.

    The k-th symmetric sum of its d roots is at most comb(d, k) * (trace / d)^k; the product of the primes passes twice that.
    """
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    bound = 2 * max(-(-comb(d, k) * trace**k // d**k) for k in range(d + 1)) + 1
    primes = primes_below((1 << 31) + 1, bound.bit_length() // 30 + 1)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("prime").to_pylist()
            for at in range(0, len(own), PRIMES_A_TASK):
                some = own[at : at + PRIMES_A_TASK]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(hessenberg_polynomials(m, some).tolist(), pa.list_(pa.int64()))], ["prime", "c"])

    tasks = -(-len(primes) // PRIMES_A_TASK)
    rows = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(tasks).mapInArrow(reduce, "prime long, c array<long>").collect()  # a bound set by d and the matrix
    whole_product = prod(primes)
    weights = [(whole_product // r["prime"]) * pow(whole_product // r["prime"], -1, r["prime"]) for r in rows]
    out = []
    for k in range(d + 1):
        c = sum(w * r["c"][k] for w, r in zip(weights, rows, strict=True)) % whole_product
        out.append(c - whole_product if c > whole_product // 2 else c)
    return out


class RealRoots:
    """The greatest roots of a polynomial all of whose roots are real."""

    def __init__(self, coefficients: list[int]):
        self.c, self.d = coefficients, len(coefficients) - 1

    def above(self, at: Fraction) -> int:
        """How many roots are greater: sign changes of the polynomial shifted by ``at`` (Descartes' rule is exact for real roots)."""
        shift, den = at.numerator, at.denominator
        c = [v * den ** (self.d - k) for k, v in enumerate(self.c)]
        for i in range(self.d):
            for k in range(self.d - 1, i - 1, -1):
                c[k] += shift * c[k + 1]
        signs = [v > 0 for v in c if v]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def positive(self, at: Fraction) -> int:
        """The sign there."""
        total, power = 0, 1
        for v in reversed(self.c):
            total, power = total * at.numerator + v * power, power * at.denominator
        return (total > 0) - (total < 0)

    def greatest(self, count: int, top: Fraction) -> list[tuple[Fraction, int]]:
        """The ``count`` greatest positive roots below ``top``, falling, each with its multiplicity, as far as they are apart."""
        out: list[tuple[Fraction, int]] = []
        open_parts = [(Fraction(0), top, self.above(Fraction(0)), 0)]
        while open_parts and sum(m for _, m in out) < count:
            low, high, from_low, from_high = open_parts.pop()
            if from_low == from_high:
                continue
            middle = (low + high) / 2
            if from_low - from_high == 1 and low > 0:
                out.append((self._narrow(low, high), 1))
            elif (high - low) * (1 << CLUSTER_BITS) < high:
                out.append((middle, from_low - from_high))
            else:
                between = self.above(middle)
                open_parts += [(low, middle, from_low, between), (middle, high, between, from_high)]
        return out

    def _narrow(self, low: Fraction, high: Fraction) -> Fraction:
        """The one root in (low, high]."""
        if self.positive(high) == 0:
            return high
        side = self.positive(high)
        while (high - low) * (1 << ROOT_BITS) > high:
            middle = (low + high) / 2
            sign = self.positive(middle)
            if sign == 0:
                return middle
            low, high = (low, middle) if sign == side else (middle, high)
        return (low + high) / 2


def null_vectors(m: list[list[int]], root: Fraction, many: int, seed: int) -> np.ndarray:
    """``many`` orthonormal vectors that m maps to root times themselves, by inverse iteration with exact residuals."""
    d = len(m)
    size = max(sum(m[i][i] for i in range(d)), 1)
    exact = np.array(m, object) * root.denominator - np.diag(np.full(d, root.numerator, object))
    scale = size * root.denominator
    near = np.array([[float(Fraction(v, scale)) for v in row] for row in exact.tolist()]) + np.eye(d) * 1e-15
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, many)))[0]
    for _ in range(6):
        v = np.linalg.qr(np.linalg.solve(near, v))[0]
    one = 1 << VECTOR_BITS
    fixed = np.array([[int(Fraction(x) * one) for x in row] for row in v.tolist()], object)
    for _ in range(4):
        left = exact @ fixed
        wrong = np.array([[float(Fraction(x, scale * one)) for x in row] for row in left.tolist()])
        step = np.linalg.solve(near, wrong)
        step -= v @ (v.T @ step)  # what is along the space itself is no error
        fixed = fixed - np.array([[int(Fraction(x) * one) for x in row] for row in step.tolist()], object)
    return np.linalg.qr(fixed.astype(float) / float(one))[0]


@dataclass
class Whitening:
    """n vectors, the sums of x by dimension, and the components: unit rows, eigenvalues, shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def components_of(spark: SparkSession, n: int, m: list[list[int]], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of m / n^2 as rows, its eigenvalues, falling, and their shares of the trace."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    if trace == 0:
        return np.zeros((0, d)), np.zeros(0), np.zeros(0)
    rows, values = [], []
    for k, (root, many) in enumerate(RealRoots(characteristic(spark, m)).greatest(count, Fraction(trace + 1))):
        for v in null_vectors(m, root, many, k).T:
            rows.append(v if v[np.argmax(np.abs(v))] > 0 else -v)
            values.append(root)
    values, rows = values[:count], rows[:count]
    return np.array(rows), np.array([float(r / n**2) for r in values]), np.array([float(r / trace) for r in values])


def fit(kept: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    n, low, m = scatter(kept, d)
    vectors, eigenvalues, explained = components_of(kept.sparkSession, n, m, components) if n else (np.zeros((0, d)), np.zeros(0), np.zeros(0))
    return Whitening(n, [s + SHIFT * n for s in low], vectors, eigenvalues, explained)


def project(kept: DataFrame, names: list[str], d: int, model: Whitening) -> DataFrame:
    """The columns ``names``, deviation, and w, the whitened coordinates, written."""
    low = [s - SHIFT * model.n for s in model.sums]  # sums of x - 100000; n * x - S is the same without the shift
    onto = (model.vectors / np.sqrt(model.eigenvalues)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = on_grid(matrix(batch.column("vector"), d))
            reach = model.n * (NARROW if x.dtype != object else 1 << 200) + max(map(abs, low), default=0)
            if reach * reach * d > LONG:  # more than 64 bits, or so it might be
                reach = model.n * max((abs(int(v)) for v in x.ravel().tolist()), default=0) + max(map(abs, low), default=0)
            wide = reach * reach * d > LONG
            off = x.astype(object) * model.n - np.array(low, object) if wide else x * model.n - np.array(low, np.int64)
            deviation = (off * off).sum(1).tolist()
            w = (off.astype(np.float64) / model.n) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            made = [pa.array([v if v <= LONG else None for v in deviation], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], [*names, "deviation", "w"])

    return written(kept.mapInArrow(run, widened(kept.select(*names), deviation="long", w="array<double>")))


def identity_error(projected: DataFrame, many: int) -> float:
    """The largest entry of the covariance of w, less the identity."""
    if not many:
        return 0.0
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    row = projected.select(*[F.col("w")[i].alias(f"w{i}") for i in range(many)]).agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, row, strict=True))


def whiten(df: DataFrame, vector_col: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """For each vector that takes part and each component: the columns ``keep`` (all but the vector, if None), component, n, deviation, whitened, explained and identity_error; and the model."""
    keep = [c for c in df.columns if c != vector_col] if keep is None else keep
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    refuse_columns(df.select(*[F.col(f"`{c}`") for c in keep]), *added)
    narrow, names = numbered(df, keep, F.col(f"`{vector_col}`").alias("vector"))
    there = narrow.filter(whole(F.col("vector")))
    d = common_length(there, "vector")
    there = there.filter(F.size("vector") == d)
    model = fit(there, d, components)
    projected = project(there, names, d, model)
    error = identity_error(projected, len(model.vectors))
    shares = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    rows = projected.select(*names, "deviation", F.posexplode("w").alias("at", "whitened"))
    out = rows.select(*names, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    return out.toDF(*keep, *added), model
