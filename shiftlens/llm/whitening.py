"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Each entry c becomes the integer floor(1024 * c) + 100000. Spark sums the entries, then the products of centred entries, both
exactly. The d x d scatter M = n^2 * covariance is an integer matrix. Its characteristic polynomial is found modulo primes
(Spark deals the primes; each one is a reduction to Hessenberg form and a recurrence) and put together by Chinese
remaindering. All roots of M are real, so the number of roots beyond a point is the number of sign changes of the polynomial
shifted there (Descartes): bisection in integers isolates each wanted root to 2^-PRECISION of the trace, with its
multiplicity. Inverse iteration in fixed-point integers finds the null space of M - root. Spark deals the components.

What a task or the driver holds is of the size of M, whatever the number of rows; d is bounded by MAX_DIMENSION.

Defined cases: a vector that is null, empty, or holds null or non-finite entries is left out, and so is one of another length
than most vectors have (of lengths alike frequent the greatest counts), or with an integer beyond 2^50. Rows with a null id
stay and count. Rows alike count as often as they occur. A component of eigenvalue zero can't be whitened and gives no
row, so a table of one distinct vector gives none. Equal eigenvalues have an orthonormal basis of their common space, the
same for all rows. Sums beyond a long raise an error rather than wrap. Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 1024.0, 100_000, 1 << 50
#: Bits of a root, as a share of the trace; bits of the fixed-point numbers of inverse iteration beyond those of the trace.
PRECISION, DIGITS = 160, 448
MAX_DIMENSION = 1024
#: float64 products are summed as long as they stay exact.
EXACT = 1 << 53


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: list[float]  # eigenvalues of the covariance, falling
    shares: list[float]  # of the trace
    components: np.ndarray  # a unit vector a row


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, the integers of each usable vector."""
    c = F.col("__v")
    whole = vectors.select("vec_id", F.col(column).cast("array<double>").alias("__v"))
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= LARGEST / SCALE)
    kept = whole.where(F.col("__v").isNotNull() & (F.size(c) > 0) & F.forall(c, fine))
    return kept.select("vec_id", F.transform(c, lambda e: F.floor(e * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column of length d."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _of_length(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of the most frequent length, that length, and how many they are."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return rows, 0, 0
    if best.d > MAX_DIMENSION:
        raise ValueError(f"vectors of {best.d} dimensions: at most {MAX_DIMENSION}")
    return rows.where(F.size("x") == best.d), best.d, best.n


def column_sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sums of the entries by dimension: partial sums of a task's rows first."""

    def part(batches):
        total = [0] * d
        for batch in batches:
            if batch.num_rows:
                block = _matrix(batch.column(0), d)
                for at in range(0, len(block), 4096):  # entries are under 2^51, so these sums fit
                    total = [t + int(s) for t, s in zip(total, block[at : at + 4096].sum(0, dtype=np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total], pa.string())], names=["k", "s"])

    parts = rows.select("x").mapInArrow(part, "k int, s string")
    got = parts.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r.s) for r in sorted(got, key=lambda r: r.k)]


def scatter(rows: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """n times the sum of centred products, exactly: n * sum (x - S/n)(x - S/n)'. Entries are centred at the whole part of
    the mean before they are multiplied, the rest is corrected in integers."""
    d = len(sums)
    centre = np.array([s // n for s in sums], np.int64)

    def part(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(0), d) - centre
            most = int(np.abs(y).max()) or 1
            step = EXACT // (most * most)
            for at in range(0, len(y), max(1, step)):
                some = y[at : at + max(1, step)]
                if step:
                    total += (some.astype(float).T @ some.astype(float)).astype(np.int64).astype(object)
                else:
                    total += some.astype(object).T @ some.astype(object)
        at = [(i, j) for i in range(d) for j in range(i, d)]
        columns = [pa.array([i * d + j for i, j in at], pa.int32()), pa.array([str(total[i, j]) for i, j in at], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "s"])

    parts = rows.select("x").mapInArrow(part, "k int, s string")
    got = {r.k: int(r.s) for r in parts.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    return [[n * got[min(i, j) * d + max(i, j)] - rest[i] * rest[j] for j in range(d)] for i in range(d)]


def primes_below(top: int, count: int) -> list[int]:
    """The greatest `count` odd primes below top."""
    small = np.ones(isqrt(top) + 2, bool)
    small[:2] = False
    for k in range(2, isqrt(len(small)) + 1):
        if small[k]:
            small[k * k :: k] = False
    divisors, out, high = np.flatnonzero(small), [], top
    while len(out) < count and high > 3:
        low = max(3, high - (1 << 16))
        own = np.ones(high - low, bool)
        for q in divisors[divisors.astype(np.int64) ** 2 < high]:
            own[max(-low % q, q * q - low) :: q] = False
        out += [int(p) for p in (np.flatnonzero(own) + low)[::-1]]
        high = low
    return out[:count]


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, the constant first: the matrix is brought to Hessenberg form by similar steps of
    elimination, then the minors of its corners follow from each other. p is below 2^31, so products fit a long."""
    h, d = matrix % p, len(matrix)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        row = k + int(below[0])
        if row != k:
            h[[k, row]] = h[[row, k]]
            h[:, [k, row]] = h[:, [row, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(1)) % p
    corners = np.zeros((d + 1, d + 1), np.int64)
    corners[0, 0] = 1
    for k in range(1, d + 1):
        corners[k, 1:] = corners[k - 1, :-1]
        corners[k] = (corners[k] - h[k - 1, k - 1] * corners[k - 1]) % p
        link = 1
        for i in range(k - 1, 0, -1):
            link = link * int(h[i, i - 1]) % p
            if not link:
                break
            corners[k] = (corners[k] - int(h[i - 1, k - 1]) * link % p * corners[i - 1]) % p
    return corners[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix) of a symmetric integer matrix without negative eigenvalues, the constant first.

    A coefficient is at most the largest of C(d, k) * (trace / d)^k, which says how many primes are needed."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bits, c = 1, 1
    for k in range(1, d + 1):
        c = c * (d - k + 1) // k
        bits = max(bits, c.bit_length() + k * (trace // d + 1).bit_length())
    moduli = primes_below(1 << 31, (bits + 2) // 30 + 1)
    values = np.array(matrix, object)

    def reduced(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = polynomial_modulo((values % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["p", "c"])

    slices = min(len(moduli), spark.sparkContext.defaultParallelism * 2)
    dealt = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(slices)
    got = dealt.mapInArrow(reduced, "p long, c array<long>").collect()  # (d + 1) numbers for each prime
    product = 1
    for p in moduli:
        product *= p
    weights = [product // r.p * pow(product // r.p, -1, r.p) for r in got]
    out = []
    for k in range(d + 1):
        v = sum(w * r.c[k] for w, r in zip(weights, got)) % product
        out.append(v - product if 2 * v > product else v)
    return out


def roots_beyond(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are greater than the integer `at`: sign changes of poly(x + at)."""
    c = poly[::-1]
    for k in range(len(c) - 1):
        for i in range(1, len(c) - k):
            c[i] += at * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(poly: list[int], k: int, scale: int, top: int) -> tuple[int, int, int]:
    """The k-th greatest root (from 1) times 2^scale, rounded down, and the ranks of the first and the last root in its cell."""
    d = len(poly) - 1
    finer = [c << (scale * (d - i)) for i, c in enumerate(poly)]
    low, high = -1, top << scale  # more than k - 1 roots beyond low, fewer than k beyond high
    while high - low > 1:
        mid = (low + high) // 2
        if roots_beyond(finer, mid) >= k:
            low = mid
        else:
            high = mid
    return low, roots_beyond(finer, high) + 1, roots_beyond(finer, low)


def null_space(matrix: list[list[int]], root: int, scale: int, size: int, rounds: int = 3) -> np.ndarray:
    """`size` orthonormal vectors that matrix - root / 2^scale nearly sends to zero: inverse iteration in fixed-point integers, with
    partial pivoting; no number is a float before the end."""
    d, one = len(matrix), 1 << DIGITS
    a = np.array([[v << DIGITS for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= (root << DIGITS) >> scale
    order, lower = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        row = max(range(k, d), key=lambda i: abs(a[i, k]))
        if row != k:
            a[[k, row]], lower[[k, row]] = a[[row, k]], lower[[row, k]]
            order[k], order[row] = order[row], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        for i in range(k + 1, d):
            if a[i, k]:
                lower[i, k] = (a[i, k] << DIGITS) // a[k, k]
                a[i, k + 1 :] -= (lower[i, k] * a[k, k + 1 :]) >> DIGITS
                a[i, k] = 0
    rng = np.random.default_rng(11)
    block = [np.array([int(v) << (DIGITS - 20) for v in rng.integers(-(1 << 20), 1 << 20, d)], object) for _ in range(size)]
    for _ in range(rounds):
        solved = []
        for b in block:
            y = b[order]
            for i in range(d):
                y[i] -= sum(lower[i, :i] * y[:i]) >> DIGITS if i else 0
            for i in range(d - 1, -1, -1):
                y[i] = ((y[i] - (sum(a[i, i + 1 :] * y[i + 1 :]) >> DIGITS if i < d - 1 else 0)) << DIGITS) // a[i, i]
            y = (y << DIGITS) // max(1, max(abs(v) for v in y))
            for earlier in solved:
                y = y - ((sum(y * earlier) >> DIGITS) * earlier >> DIGITS)
            length = isqrt(sum(v * v for v in y)) or 1
            solved.append((y << DIGITS) // length)
        block = solved
    return np.array([[v / one for v in b] for b in block])


def components_of(spark, matrix: list[list[int]], poly: list[int], count: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(root, bits of its fraction) of the `count` greatest roots, and their vectors; one component a row that Spark deals."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    scale = max(1, PRECISION - trace.bit_length())

    def solve(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                root, first, last = isolate(poly, k, scale, trace + 1)
                vector = null_space(matrix, root, scale, last - first + 1)[k - first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([str(root)], pa.string()), pa.array([vector.tolist()], pa.list_(pa.float64()))], names=["k", "root", "v"]
                )

    dealt = spark.createDataFrame([(k,) for k in range(1, min(count, d) + 1)], "k int").repartition(min(count, d))
    got = sorted(dealt.mapInArrow(solve, "k int, root string, v array<double>").collect(), key=lambda r: r.k)
    return [(int(r.root), scale) for r in got], np.array([r.v for r in got]).reshape(len(got), d)


def fit(vectors: DataFrame, count: int = 8) -> tuple[Whitening | None, DataFrame]:
    """The whitening of all usable vectors with at most `count` components, and their integers; None where there is no vector."""
    rows, d, n = _of_length(integers(vectors))
    if not n:
        return None, rows
    sums = column_sums(rows, d)
    matrix = scatter(rows, n, sums)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return Whitening(n, sums, [], [], np.zeros((0, d))), rows
    spark = vectors.sparkSession
    roots, parts = components_of(spark, matrix, characteristic_polynomial(spark, matrix), count)
    kept = [k for k, (root, _) in enumerate(roots) if root > 0]
    values = [roots[k][0] / (n * n << roots[k][1]) for k in kept]
    shares = [roots[k][0] / (trace << roots[k][1]) for k in kept]
    return Whitening(n, sums, values, shares, parts[kept]), rows


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (the sum of (n * x - S)^2, exact) and w, the whitened entries, of rows of integers."""
    d, n = len(model.sums), model.n
    whole, rest = [s // n for s in model.sums], [s % n for s in model.sums]
    turned = (model.components / np.sqrt(np.array(model.values))[:, None]).T

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column(1), d) - np.array(whole, np.int64)
            most = (int(np.abs(y).max()) + 1) * n
            z = y if d * most * most < 1 << 63 else y.astype(object)
            deviation = ((z * n - np.array(rest, z.dtype)) ** 2).sum(1)
            w = (y - np.array(rest) / n) @ turned
            ends = pa.array(np.arange(len(y) + 1) * w.shape[1], pa.int32())
            columns = [batch.column(0), pa.array(deviation.tolist(), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation long, w array<double>")


def identity_error(done: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of w (k entries a row) minus the identity, after a pass for the means."""
    means = done.agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)]).first()
    mean = np.array([means[i] / n for i in range(k)])

    def part(batches):
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0), k) - mean
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["k", "s"])

    parts = done.select("w").mapInArrow(part, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    found = np.zeros(k * k)
    for r in parts:
        found[r.k] = r.s / n
    return float(np.abs(found.reshape(k, k) - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, count: int = 8) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained (the component's
    share of the trace) and identity_error (one value for all rows)."""
    model, rows = fit(vectors, count)
    if model is None or not model.values:
        return vectors.sparkSession.createDataFrame([], RESULT)
    done = whitened(rows, model)
    error = identity_error(done, model.n, len(model.values))
    shares = F.array(*[F.lit(s) for s in model.shares])
    long = done.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return long.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
