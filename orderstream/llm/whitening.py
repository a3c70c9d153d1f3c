"""Whitening of embeddings along exact principal components.

Vectors become integers, so their sums and products add up exactly, in limbs, whatever the order. n times the sums of
products less the products of the sums is the integer scatter A, n squared times the covariance. Its characteristic
polynomial is computed modulo as many 31-bit primes as its coefficients need (Hessenberg form modulo a prime, primes dealt
over tasks) and put together by Chinese remaindering. All its roots are real, so the sign changes of the shifted
polynomial count the roots above a point exactly, with multiplicity: bisection isolates each root, or a cluster of equal
ones, to PRECISION bits. Inverse iteration in fixed-point integers on A less the root gives the components: a cluster's
null space is iterated as a block, so equal roots get orthogonal components.

What passes through the driver has the size of the dimension squared, or of a polynomial's residues; rows stay in tasks.

Rows whose vector is null or holds a null or non-finite entry are left out; so are vectors whose length is not the
commonest (of equally common ones the greatest). Entries beyond 2**62 after scaling are cut to that. A null id stays null;
repeated rows count and come out each. A component without variance has explained 0 and a null projection. A deviation
that does not fit a long is null. Without vectors, or with vectors of no entries, the result is empty. Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.llm.common import read

MOST, SCALE = 32, 64
PRECISION = 180
POINT = 2 * PRECISION + 64
LIMB = 40
BLOCK = 4096


# Rows in tasks


def usable(vec: Column) -> Column:
    """The vector has no null, infinite or undefined entry."""
    return vec.isNotNull() & F.forall(vec, lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))


def integers(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    """floor(scale * entry), before the shift, which no covariance sees."""
    flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(flat * scale), -(2.0**62), 2.0**62).astype(np.int64)


def products(x: np.ndarray) -> np.ndarray:
    """The exact sum of x x' over the rows, as Python integers."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0))
    if most * most * len(x) < 2.0**52:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, rest, k = (-1, -value, 0) if value < 0 else (1, value, 0)
    while rest:
        yield k, sign * (rest & ((1 << LIMB) - 1))
        rest, k = rest >> LIMB, k + 1


def summed(dim: int, scale: int):
    """A task's sums: row -1 has those of each entry, row -2 the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, both = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = integers(batch, dim, scale)
            n += len(x)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                total += part.astype(object).sum(0) if np.abs(part).max(initial=0) > 1 << 48 else part.sum(0).astype(object)
                both += products(part)
        cells = [(-2, 0, n), *((-1, j, total[j]) for j in range(dim)), *((i, j, both[i, j]) for i in range(dim) for j in range(i, dim))]
        rows = [(i, j, k, v) for i, j, value in cells for k, v in limbs(int(value))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "k", "v"])

    return run


class Fit(NamedTuple):
    n: int
    sums: list[int]
    scatter: list[list[int]]


def fitted(vectors: DataFrame, dim: int, scale: int) -> Fit:
    """Number, sums (before the shift) and the scatter n * sum(x x') - S S' of all vectors."""
    cells = vectors.select("vec").mapInArrow(summed(dim, scale), "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    found: dict[tuple[int, int], int] = {}
    for row in cells.collect():  # by the dimension: half its square, times a few limbs
        found[row.i, row.j] = found.get((row.i, row.j), 0) + (row.v << LIMB * row.k)
    n, s = found.get((-2, 0), 0), [found.get((-1, j), 0) for j in range(dim)]
    return Fit(n, s, [[n * found.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(dim)] for i in range(dim)])


# Characteristic polynomial


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every number below 2**31."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(over: int) -> list[int]:
    """Primes below 2**31, falling, until their product is greater."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= over:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix of the same characteristic polynomial modulo p, with zeros below the subdiagonal."""
    a = a.copy()
    for k in range(1, len(a) - 1):
        found = np.flatnonzero(a[k:, k - 1])
        if not len(found):
            continue
        i = k + int(found[0])
        if i != k:
            a[[i, k]] = a[[k, i]]
            a[:, [i, k]] = a[:, [k, i]]
        u = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - u[:, None] * a[k]) % p
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * u % p).sum(1)) % p
    return a


def characteristic(h: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p, lowest first, from the leading minors of a Hessenberg matrix."""
    n = len(h)
    minors = np.zeros((n + 1, n + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, n + 1):
        row = np.roll(minors[k - 1], 1) - h[k - 1, k - 1] * minors[k - 1] % p
        chain, weights = 1, []
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            weights.append(chain * int(h[k - i - 1, k - 1]) % p)
        if weights:
            row = row - (np.array(weights, np.int64)[:, None] * minors[k - 2 :: -1][: k - 1] % p).sum(0)
        minors[k] = row % p
    return minors[n]


def residues(scatter: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.column("p").to_pylist():
                a = np.array([[v % p for v in row] for row in scatter], np.int64)
                out.append(characteristic(hessenberg(a, p), p).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(out, pa.list_(pa.int64()))], ["p", "c"])

    return run


def coefficients(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """The characteristic polynomial over the integers, lowest coefficient first.

    The roots are not negative and sum to the trace, so no coefficient exceeds that of as many equal roots.
    """
    dim, trace = len(scatter), sum(scatter[i][i] for i in range(len(scatter)))
    mean = -(-trace // dim)
    ps = primes(2 * max(math.comb(dim, k) * mean**k for k in range(dim + 1)))
    tasks = min(len(ps), 4 * spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(p,) for p in ps], "p long").repartition(tasks)
    value, modulus = [0] * (dim + 1), 1
    for p, c in dealt.mapInArrow(residues(scatter), "p long, c array<long>").orderBy("p").collect():
        inverse = pow(modulus % p, -1, p)
        value = [v + modulus * ((r - v) * inverse % p) for v, r in zip(value, c, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


# Roots


class Root(NamedTuple):
    """A root at m / 2**s and how many there are of it."""

    m: int
    s: int
    times: int


def roots_above(c: list[int], m: int, s: int) -> int:
    """The number of roots above m / 2**s: the sign changes of the polynomial shifted there."""
    n = len(c) - 1
    a = [v << s * (n - i) for i, v in enumerate(c)]
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            a[j] += m * a[j + 1]
    signs = [v > 0 for v in a if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def sign_at(c: list[int], m: int, s: int) -> int:
    n, v = len(c) - 1, c[-1]
    for i in range(n - 1, -1, -1):
        v = v * m + (c[i] << s * (n - i))
    return (v > 0) - (v < 0)


def narrow(lo: int, hi: int) -> bool:
    return (hi - lo) << PRECISION <= lo


def largest_roots(c: list[int], trace: int, most: int) -> list[Root]:
    """The largest positive roots, falling, until there are so many with multiplicity, or no more.

    Roots that agree in PRECISION bits count as one root of their number.
    """
    zeros = next(i for i, v in enumerate(c) if v)
    c = c[zeros:]
    found: list[Root] = []
    open_ = [(0, trace, 0, len(c) - 1, 0)] if len(c) > 1 else []  # lo, hi, s, roots above lo, roots above hi; the top one last
    while open_ and sum(r.times for r in found) < most:
        lo, hi, s, below, above = open_.pop()
        if below == above:
            continue
        if below - above == 1:
            found.append(refined(c, lo, hi, s))
            continue
        if narrow(lo, hi):
            found.append(Root(lo + hi, s + 1, below - above))
            continue
        lo, hi, s = (lo, hi, s) if hi - lo > 1 else (2 * lo, 2 * hi, s + 1)
        mid = (lo + hi) // 2
        between = roots_above(c, mid, s)
        open_ += [(lo, mid, s, below, between), (mid, hi, s, between, above)]
    return found


def refined(c: list[int], lo: int, hi: int, s: int) -> Root:
    """The one root above lo and not above hi."""
    top = sign_at(c, hi, s)
    if top == 0:
        return Root(hi, s, 1)
    while not narrow(lo, hi):
        lo, hi, s = (lo, hi, s) if hi - lo > 1 else (2 * lo, 2 * hi, s + 1)
        mid = (lo + hi) // 2
        now = sign_at(c, mid, s)
        if now == 0:
            return Root(mid, s, 1)
        lo, hi = (lo, mid) if now == top else (mid, hi)
    return Root(lo + hi, s + 1, 1)


# Components, in fixed-point integers with POINT bits behind the point


def factored(b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Lower and upper factors in one matrix, and the order of the rows."""
    b, order = b.copy(), list(range(len(b)))
    for k in range(len(b)):
        i = max(range(k, len(b)), key=lambda r: abs(b[r, k]))
        if i != k:
            b[[i, k]] = b[[k, i]]
            order[i], order[k] = order[k], order[i]
        if not b[k, k]:
            b[k, k] = 1
        b[k + 1 :, k] = (b[k + 1 :, k] << POINT) // b[k, k]
        b[k + 1 :, k + 1 :] -= (b[k + 1 :, k, None] * b[k, None, k + 1 :]) >> POINT
    return b, order


def solved(lu: np.ndarray, order: list[int], x: np.ndarray) -> np.ndarray:
    x = x[order].copy()
    for k in range(len(x)):
        x[k + 1 :] -= (lu[k + 1 :, k, None] * x[k]) >> POINT
    for k in range(len(x) - 1, -1, -1):
        x[k] = (x[k] << POINT) // lu[k, k]
        x[:k] -= (lu[:k, k, None] * x[k]) >> POINT
    return x


def orthonormal(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for j in range(x.shape[1]):
        for _ in range(2):
            x[:, j] = (x[:, j] << POINT) // max(1, math.isqrt(int((x[:, j] * x[:, j]).sum())))
            for i in range(j):
                x[:, j] -= (((x[:, i] * x[:, j]).sum() >> POINT) * x[:, i]) >> POINT
        x[:, j] = (x[:, j] << POINT) // max(1, math.isqrt(int((x[:, j] * x[:, j]).sum())))
    return x


def null_space(scatter: list[list[int]], trace: int, root: Root) -> np.ndarray:
    """Orthonormal columns, as many as the root's number, that A less the root takes to nothing."""
    up = max(0, POINT - trace.bit_length())
    down = max(0, trace.bit_length() - POINT)
    b = np.array([[(v << up) >> down for v in row] for row in scatter], object)
    b[np.diag_indices(len(b))] -= (root.m << up) >> (root.s + down)
    lu, order = factored(b)
    state = np.random.default_rng(root.times)
    x = np.array([[int(v) << (POINT - 60) for v in row] for row in state.integers(-(1 << 60), 1 << 60, (len(b), root.times))], object)
    x = orthonormal(x)
    for _ in range(24):
        x = orthonormal(solved(lu, order, x))
        left = np.abs((b @ x) >> POINT).max()
        if int(left).bit_length() <= POINT - PRECISION + 24:
            break
    return x


class Components(NamedTuple):
    """Unit vectors by columns, eigenvalues of the covariance and their shares; those past the rank are 0."""

    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def components(spark: SparkSession, fit: Fit, most: int) -> Components:
    dim, trace = len(fit.sums), sum(fit.scatter[i][i] for i in range(len(fit.sums)))
    most = min(most, dim)
    vectors, values, explained = np.zeros((dim, most)), np.zeros(most), np.zeros(most)
    roots = largest_roots(coefficients(spark, fit.scatter), trace, most) if trace else []
    at = 0
    for root in roots:
        x = null_space(fit.scatter, trace, root)
        for j in range(min(root.times, most - at)):
            v = np.array([int(y) / (1 << POINT) for y in x[:, j]])
            vectors[:, at] = v if v[np.abs(v).argmax()] > 0 else -v
            values[at], explained[at] = root.m / (fit.n * fit.n << root.s), root.m / (trace << root.s)
            at += 1
    return Components(vectors, values, explained)


# Projection


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - S, exactly."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * fit.n + max((abs(float(s)) for s in fit.sums), default=0.0)
    if most < 2.0**61:
        return fit.n * x - np.array(fit.sums, np.int64)
    return fit.n * x.astype(object) - np.array(fit.sums, object)


def deviations(c: np.ndarray) -> pa.Array:
    if c.dtype != object and float((c.astype(np.float64) ** 2).sum(1).max(initial=0)) < 2.0**62:
        return pa.array((c * c).sum(1))
    total = [sum(int(v) * int(v) for v in row) for row in c]
    return pa.array([v if v < 1 << 63 else None for v in total], pa.int64())


def projected(batch: pa.RecordBatch, fit: Fit, weight: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    c = centred(integers(batch, len(fit.sums), scale), fit)
    return c, (c / fit.n).astype(np.float64) @ weight


def moments(fit: Fit, weight: np.ndarray, scale: int):
    """A task's sums of the projections (row -1) and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = weight.shape[1]
        total, both = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = projected(batch, fit, weight, scale)[1]
            total += z.sum(0)
            both += z.T @ z
        i = np.repeat(np.arange(-1, k, dtype=np.int32), k)
        j = np.tile(np.arange(k, dtype=np.int32), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.concatenate([total, both.ravel()]))], ["i", "j", "v"])

    return run


def identity_error(vectors: DataFrame, fit: Fit, weight: np.ndarray, scale: int) -> float:
    """The largest entry of the projections' covariance less the identity; 0 without components."""
    k = weight.shape[1]
    if not k:
        return 0.0
    total, both = np.zeros(k), np.zeros((k, k))
    sums = vectors.select("vec").mapInArrow(moments(fit, weight, scale), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for row in sums.collect():  # by the number of components, squared
        if row.i < 0:
            total[row.j] = row.v
        else:
            both[row.i, row.j] = row.v
    mean = total / fit.n
    return float(np.abs(both / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def written(fit: Fit, found: Components, weight: np.ndarray, error: float, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, rank = len(found.values), weight.shape[1]
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                c, z = projected(part, fit, weight, scale)
                n, row = len(part), pa.array(np.repeat(np.arange(len(part)), most))
                whole = np.zeros((n, most))
                whole[:, :rank] = z
                absent = np.tile(np.arange(most) >= rank, n)
                columns = [
                    part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * most, fit.n)), deviations(c).take(row), pa.array(whole.ravel(), mask=absent),
                    pa.array(np.tile(found.explained, n)), pa.array(np.full(n * most, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = MOST, scale: int = SCALE
) -> DataFrame:
    """A row for each usable vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(usable(F.col("vec")))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    commonest = vectors.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if commonest is None or not commonest.dim:
        return spark.createDataFrame([], shape)
    vectors = vectors.filter(F.size("vec") == commonest.dim)
    fit = fitted(vectors, commonest.dim, scale)
    found = components(spark, fit, most)
    rank = int((found.values > 0).sum())
    weight = found.vectors[:, :rank] / np.sqrt(found.values[:rank])
    error = identity_error(vectors, fit, weight, scale)
    return vectors.mapInArrow(written(fit, found, weight, error, scale), shape)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(read(spark, folder, "embeddings"))
