"""Whitening of embeddings by exact arithmetic.

Entries become integers, `floor(scale * c) + offset`, so sums and products of them have exact values. The fit list is
each distinct vector once. Its scatter matrix M (n * sum of products less the products of the sums, n^2 times the
covariance) is summed by tasks in blocks small enough for exact products, and by Spark over tasks. From then on the work
depends on the number of dimensions only: the characteristic polynomial of M is computed modulo one prime a row
(reduction to Hessenberg form), and its coefficients follow from the Chinese remainder theorem. M is symmetric, so all
roots are real, and the sign variations of the polynomial moved by c count the roots above c exactly: bisection isolates
the largest ones and follows them to far more digits than a double has. Inverse iteration on M less a root, in decimal
arithmetic, gives the null space, one cluster of equal roots a row.

What reaches the driver is bounded by the dimensions alone: M, the residues, the components.

Edge cases: a null vector, an empty one, and one with null or non-finite entries is dropped, as is a vector whose length
is not the most frequent one (the longer of two equally frequent). Scaled entries beyond 2^61 count as 2^61. A null id
and repeated ids are rows of their own. Components without variance are left out, so there may be fewer than `top`, and
none for one distinct vector. Equal eigenvalues get some orthonormal basis of their space, the same for all rows. A
deviation of more than 38 digits is null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import decimal
import math
import random
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import stored

#: Rows with an entry of this size or more are multiplied as Python integers.
LARGE = 1 << 26
#: Scaled entries are kept within this size.
MOST = float(1 << 61)
#: Bits to which roots are followed, counted from the trace down; roots closer than CLUSTER bits are taken as equal.
ROOT_BITS, CLUSTER_BITS = 200, 150
#: Digits of the decimal arithmetic of inverse iteration.
DIGITS = 90
#: Sums of products travel in two parts, as one may be longer than a decimal of 38 digits.
PART = 60

RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Distinct vectors, their sums by dimension (of entries less the offset), components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]
    scale: int
    offset: int
    identity_error: float = 0.0
    large: bool = field(default=False)

    def moved(self, z: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; as Python integers where 64 bits may not hold it."""
        most = max(int(np.abs(z).max(initial=0)), 1) * self.n + max(map(abs, self.sums))
        if most < 1 << 62:
            return self.n * z - np.array(self.sums, np.int64)
        return self.n * z.astype(object) - np.array(self.sums, object)

    def whitened(self, moved: np.ndarray) -> np.ndarray:
        return (moved.astype(np.float64) / self.n) @ (self.components / np.sqrt(np.array(self.eigenvalues))[:, None]).T


# --- the integer vectors and their scatter


def _lattice(id_col: str, vec_col: str, scale: int):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.names.index(vec_col))
            lists = vectors.cast(pa.large_list(pa.float64()))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            fine = sizes > 0
            fine[owner[~np.isfinite(values)]] = False
            kept = np.clip(np.floor(scale * values[fine[owner]]), -MOST, MOST).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes[fine])]).astype(np.int32)
            rows = pa.array(np.flatnonzero(fine))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(id_col)).take(rows), pa.ListArray.from_arrays(pa.array(at), pa.array(kept))], ["_id", "_z"])

    return run


def lattice(embeddings: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(_id, _z): the integer entries less the offset, of every row whose vector has finite entries only."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    return embeddings.select(id_col, vec_col).mapInArrow(_lattice(id_col, vec_col, scale), f"_id {kind}, _z array<long>")


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(z: np.ndarray) -> np.ndarray:
    """z' z as Python integers, exactly."""
    d = z.shape[1]
    total = np.zeros((d, d), object)
    sizes = np.abs(z).max(axis=1, initial=0)
    large, small = z[sizes >= LARGE], z[sizes < LARGE]
    if len(small):
        step = max((1 << 53) // max(int(sizes[sizes < LARGE].max()) ** 2, 1), 1)
        for a in range(0, len(small), step):
            part = small[a : a + step].astype(np.float64)
            total = total + (part.T @ part).astype(np.int64).astype(object)
    if len(large):
        part = large.astype(object)
        total = total + part.T @ part
    return total


def _sums(d: int):
    import pyarrow as pa

    def run(batches):
        n, first, second = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            z = matrix(batch.column(0))
            n += len(z)
            first = first + (z.sum(axis=0) if np.abs(z).max(initial=0) < LARGE else z.astype(object).sum(axis=0))
            second = second + products(z)
        if n:
            i, j = np.triu_indices(d)
            values = [n, *map(int, first), *map(int, second[i, j])]
            rows, cols = [-1, *range(d), *i.tolist()], [-1, *[-1] * d, *j.tolist()]
            wide = pa.decimal128(38, 0)
            high = pa.array([Decimal(v >> PART) for v in values], wide)
            low = pa.array([Decimal(v & (1 << PART) - 1) for v in values], wide)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), high, low], ["i", "j", "high", "low"])

    return run


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums by dimension and n * (sum of products) - sum * sum, of a table of vectors of d integers `_z`."""
    parts = fit.select("_z").mapInArrow(_sums(d), "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    value = {(r["i"], r["j"]): (int(r["high"]) << PART) + int(r["low"]) for r in rows}
    n, sums = value.get((-1, -1), 0), [value.get((i, -1), 0) for i in range(d)]
    return n, sums, [[n * value.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


# --- the characteristic polynomial


def is_prime(p: int) -> bool:
    """Miller and Rabin's test with the bases that decide every number below 3,215,031,751."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7)):
        return p in (2, 3, 5, 7)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than so many bits."""
    found, product, p = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits + 1:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def polynomial_modulo(m: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - m) modulo p, from the constant up. The entries are residues, p is below 2^31."""
    a, d = m.copy(), len(m)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        a[[k + 1, pivot]] = a[[pivot, k + 1]]
        a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factor % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)
    leading[0, 0] = 1
    for k in range(d):
        weights = np.zeros(k + 1, np.int64)
        product = 1
        for i in range(k, -1, -1):
            weights[i] = int(a[i, k]) * product % p
            product = product * int(a[i, i - 1]) % p if i else 0
        leading[k + 1, 1:] = leading[k, :-1]
        leading[k + 1] = (leading[k + 1] - (leading[: k + 1] * weights[:, None] % p).sum(axis=0)) % p
    return leading[d].tolist()


def combined(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """The integers of least size with these residues, position by position."""
    whole = math.prod(moduli)
    units = [(whole // p) * pow(whole // p, -1, p) for p in moduli]
    out = []
    for column in zip(*residues):
        x = sum(r * u for r, u in zip(column, units)) % whole
        out.append(x - whole if 2 * x > whole else x)
    return out


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - m) from the constant up, for an integer matrix without negative eigenvalues: its
    coefficients are bounded by (1 + trace / d) ^ d. One row a prime; the rows are the tasks' work."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    moduli = primes(d * (trace // d + 2).bit_length())
    held = spark.sparkContext.broadcast(m)

    def run(batches):
        import pyarrow as pa

        whole = held.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p = moduli[k]
                rest = polynomial_modulo(np.array([[v % p for v in row] for row in whole], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([rest], pa.list_(pa.int64()))], ["k", "rest"])

    slices = min(len(moduli), 2 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(moduli), 1, slices).mapInArrow(run, "k long, rest array<long>").collect()
    rest = {r["k"]: r["rest"] for r in rows}
    found = combined([rest[k] for k in range(len(moduli))], moduli)
    if found[d] != 1 or (d and found[d - 1] != -trace):
        raise ArithmeticError("the residues do not give the characteristic polynomial")
    return found


# --- its roots


def roots_above(scaled: list[int], c: int) -> int:
    """How many roots of a polynomial with real roots only lie above c: the sign variations of its coefficients about c."""
    moved = list(scaled)
    for i in range(len(moved) - 1):
        for j in range(len(moved) - 2, i - 1, -1):
            moved[j] += c * moved[j + 1]
    signs = [v > 0 for v in moved if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_at(scaled: list[int], c: int) -> int:
    total = 0
    for v in reversed(scaled):
        total = total * c + v
    return total


def largest_roots(poly: list[int], top: int, trace: int) -> tuple[list[int], int]:
    """The `top` largest positive roots with their multiplicity, falling, each as the largest integer below the root times
    2^s; and s. The polynomial is monic, has real roots only and none below zero."""
    d = len(poly) - 1
    s = max(ROOT_BITS - trace.bit_length(), 0)
    scaled = [c << s * (d - i) for i, c in enumerate(poly)]
    counts: dict[int, int] = {}

    def above(c: int) -> int:
        if c not in counts:
            counts[c] = roots_above(scaled, c)
        return counts[c]

    found = []
    for k in range(1, min(top, above(0)) + 1):
        #: at least k roots lie above `low`, fewer above `high`
        low = max((c for c, m in counts.items() if m >= k), default=0)
        high = min((c for c, m in counts.items() if m < k), default=(trace << s) + 1)
        while high - low > 1 and not (above(low) == k and above(high) == k - 1):
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        if high - low > 1:
            #: one simple root: the sign just below it is that of the lower end, which may itself be a root
            positive = (k - 1) % 2 == 0
            while high - low > 1:
                middle = (low + high) // 2
                v = value_at(scaled, middle)
                low, high = (low, middle) if v == 0 or (v > 0) == positive else (middle, high)
        found.append(low)
    return found, s


# --- and the components


def null_space(m: list[list[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """An orthonormal basis of the space of an eigenvalue of the symmetric m: inverse iteration from `count` fixed starts,
    each held orthogonal to the vectors before it."""
    d = len(m)
    with decimal.localcontext() as context:
        context.prec = DIGITS
        a = [[Decimal(v) for v in row] for row in m]
        size = max((abs(v) for row in a for v in row), default=Decimal(1)) or Decimal(1)
        for i in range(d):
            a[i][i] -= root
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
            a[k], a[pivot], order[k], order[pivot] = a[pivot], a[k], order[pivot], order[k]
            if a[k][k] == 0:
                a[k][k] = size.scaleb(-DIGITS)
            tail = a[k][k + 1 :]
            for i in range(k + 1, d):
                row = a[i]
                if row[k]:
                    row[k] /= a[k][k]
                    f = row[k]
                    row[k + 1 :] = [x - f * y for x, y in zip(row[k + 1 :], tail)]

        def length(v):
            return sum(x * x for x in v).sqrt()

        def orthogonal(v, others):
            for u in [*others, *others]:
                f = sum(x * y for x, y in zip(u, v))
                v = [y - f * x for x, y in zip(u, v)]
            scale = length(v)
            return [x / scale for x in v]

        def solved(v):
            y = []
            for k in range(d):
                y.append(v[order[k]] - sum(f * x for f, x in zip(a[k], y)))
            x = [Decimal(0)] * d
            for k in range(d - 1, -1, -1):
                x[k] = (y[k] - sum(f * z for f, z in zip(a[k][k + 1 :], x[k + 1 :]))) / a[k][k]
            return x

        basis: list[list[Decimal]] = []
        for c in range(count):
            chance = random.Random(c)
            v = orthogonal([Decimal(chance.randint(-999, 999) or 1) for _ in range(d)], basis)
            for _ in range(3):
                v = orthogonal(solved(v), basis)
            largest = max(v, key=abs)
            basis.append([-x for x in v] if largest < 0 else v)
        return basis


def components(spark, m: list[list[int]], top: int) -> tuple[np.ndarray, list[Decimal], int]:
    """Unit eigenvectors of an integer scatter matrix, one a row, by falling eigenvalue, the eigenvalues, and the trace."""
    trace = sum(m[i][i] for i in range(len(m)))
    if not trace:
        return np.zeros((0, len(m))), [], 0
    poly = characteristic_polynomial(spark, m)
    #: one root more than asked for, so that a cluster at the end is seen whole
    found, s = largest_roots(poly, len(m) if top >= len(m) else top + 1, trace)
    near = 1 << max(s + trace.bit_length() - CLUSTER_BITS, 0)
    clusters: list[list[int]] = []
    for root in found:
        if clusters and clusters[-1][0] - root <= near:
            clusters[-1].append(root)
        else:
            clusters.append([root])
    with decimal.localcontext() as context:
        context.prec = DIGITS
        roots = [(2 * Decimal(c[0]) + 1) / (Decimal(2) ** (s + 1)) for c in clusters]
    held = spark.sparkContext.broadcast((m, roots, [len(c) for c in clusters]))

    def run(batches):
        import pyarrow as pa

        whole, values, counts = held.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                basis = [[float(x) for x in v] for v in null_space(whole, values[k], counts[k])]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(basis), pa.int64()), pa.array(range(len(basis)), pa.int64()), pa.array(basis, pa.list_(pa.float64()))], ["k", "place", "vector"])

    rows = spark.range(0, len(clusters), 1, len(clusters)).mapInArrow(run, "k long, place long, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["k"], r["place"]))[:top]
    return np.array([r["vector"] for r in rows]).reshape(len(rows), len(m)), [roots[r["k"]] for r in rows], trace


# --- fit and application


def _identity(model: Whitening):
    import pyarrow as pa

    k = len(model.eigenvalues)

    def run(batches):
        first, second, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            w = model.whitened(model.moved(matrix(batch.column(0))))
            n, first, second = n + len(w), first + w.sum(axis=0), second + w.T @ w
        if n:
            i, j = np.triu_indices(k)
            rows, cols = [*range(k), *i.tolist()], [*[-1] * k, *j.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array([*first, *second[i, j]], pa.float64())], ["i", "j", "v"])

    return run


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    rows = fit.select("_z").mapInArrow(_identity(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    value = {(r["i"], r["j"]): r["v"] / model.n for r in rows}
    return max(abs(v - value[i, -1] * value[j, -1] - (i == j)) for (i, j), v in value.items() if j >= 0)


def fit_whitening(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 16, scale: int = 64, offset: int = 1_000_000) -> Whitening | None:
    """The exact model over each distinct integer vector once; None where no row has a usable vector."""
    rows = lattice(embeddings, id_col, vec_col, scale)
    lengths = rows.groupBy(F.size("_z").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    fit = stored(rows.where(F.size("_z") == d).select("_z").distinct(), "fit-list")
    n, sums, m = scatter(fit, d)
    vectors, roots, trace = components(embeddings.sparkSession, m, top)
    with decimal.localcontext() as context:
        context.prec = DIGITS
        eigenvalues, explained = [float(r / n / n) for r in roots], [float(r / trace) for r in roots]
    model = Whitening(n, sums, vectors, eigenvalues, explained, scale, offset)
    if eigenvalues:
        model.identity_error = _identity_error(fit, model)
    return model


def _applied(id_col: str, model: Whitening):
    import pyarrow as pa

    k, d = len(model.eigenvalues), len(model.sums)

    def run(batches):
        for batch in batches:
            moved = model.moved(matrix(batch.column(1)))
            if moved.dtype != object and int(np.abs(moved).max(initial=0)) ** 2 * d >= 1 << 63:
                squares = (moved.astype(object) ** 2).sum(axis=1)
            else:
                squares = (moved**2).sum(axis=1)
            rows = len(moved)
            each = np.repeat(np.arange(rows), k)
            deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n, np.int64)),
                    deviation.take(pa.array(each)),
                    pa.array(model.whitened(moved).ravel()),
                    pa.array(np.tile(np.array(model.explained), rows)),
                    pa.array(np.full(rows * k, model.identity_error)),
                ],
                [id_col, *(c.split()[0] for c in RESULT.replace("(38,0)", "").split(", "))],
            )

    return run


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row a usable vector and component: the id, component (from 1), n (distinct vectors), deviation (sum over
    dimensions of (n*x - S)^2, exact), whitened, explained (share of the trace) and identity_error."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {RESULT}"
    model = fit_whitening(embeddings, id_col, vec_col, top, scale, offset)
    if model is None or not model.eigenvalues:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = lattice(embeddings, id_col, vec_col, scale).where(F.size("_z") == len(model.sums))
    return rows.mapInArrow(_applied(id_col, model), schema)
