"""Whitening: exact polynomial, roots and components against numpy, exact deviations, edge cases."""

import math

import numpy as np
import pytest

from marlstone.llm.registry import op13_embedding_whitening
from marlstone.llm.whitening import (
    combined,
    components,
    is_prime,
    largest_roots,
    null_space,
    polynomial_modulo,
    primes,
    products,
    roots_above,
    whiten,
)

D = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n long"


def scatter_of(x):
    z = np.array(x, object)
    n, s = len(z), z.sum(axis=0)
    return n, s, n * (z.T @ z) - np.outer(s, s)


def check(rows, vectors, top=16, tolerance=1e-9):
    """Hold every column against plain numpy over the usable vectors."""
    x = {k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for k, v in vectors.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, s, m = scatter_of(fit)
    v = np.array([[float(e) for e in row] for row in m]) / n / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(top, int((e > 1e-9 * e[0]).sum()))
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(found) == len(rows) and set(found) == {(i, c) for i in x for c in range(1, k + 1)}
    for i, row in x.items():
        moved = [n * a - int(b) for a, b in zip(row, s)]
        for c in range(1, k + 1):
            r = found[i, c]
            assert r.n == n and int(r.deviation) == sum(a * a for a in moved)
            assert math.isclose(r.explained, e[c - 1] / e.sum(), rel_tol=1e-9) and r.identity_error <= 1e-9
    for c in range(1, k + 1):
        got = np.array([found[i, c].whitened for i in x])
        want = np.array([[float(n * a - int(b)) / n for a, b in zip(row, s)] for row in x.values()]) @ u[:, c - 1] / math.sqrt(e[c - 1])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < tolerance


def test_query_over_the_whole_table(spark):
    rows = op13_embedding_whitening(spark, D).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()}
    check(rows, vectors, tolerance=1e-7)


def test_rows_that_are_dropped_repeats_and_clashing_names(spark):
    chance = np.random.default_rng(5)
    good = {k: chance.normal(0, 1 + k % 3, 3).tolist() for k in range(40)}
    good[40] = good[41] = good[0]
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [1.0, float("nan"), 2.0], 1), (104, [float("inf"), 0.0, 2.0], 1), (105, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(k, v, 7) for k, v in good.items()] + bad, SCHEMA).selectExpr("*", "vec_id as component", "1 as _id", "2 as i")
    check(whiten(df).collect(), good, tolerance=1e-8)
    twice = whiten(df.union(df)).collect()
    assert len(twice) == 2 * 3 * len(good) and {r.n for r in twice} == {40}
    none = whiten(spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [2.0, 1.0], 1)], SCHEMA)).collect()
    assert [(r.vec_id, r.component, int(r.deviation), round(abs(r.whitened), 9), r.explained) for r in none] == [(None, 1, 2 * 64 * 64, 1.0, 1.0)] * 2


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_nothing_to_whiten(spark, rows):
    out = whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_constant_dimensions_and_equal_eigenvalues(spark):
    rows = [(k, [a, b, 3.0], 0) for k, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)])]
    out = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in out} == {1, 2} and all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-12 for r in out)
    by = {(r.vec_id, r.component): r.whitened for r in out}
    cloud = np.array([[by[k, c] for c in (1, 2)] for k in range(4)])
    assert np.abs(cloud.T @ cloud / 4 - np.eye(2)).max() < 1e-12


def test_huge_entries_stay_exact(spark):
    rows = [(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.5, 2.0], 0)]
    out = {(r.vec_id, r.component): r for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {(k, c) for k in (1, 2, 3) for c in (1, 2)}
    most = 1 << 61
    s = [32, 64 + 128]
    assert int(out[3, 1].deviation) == (3 * 32 - s[0]) ** 2 + (3 * 128 - s[1]) ** 2
    assert out[1, 1].deviation is None or int(out[1, 1].deviation) == (3 * most - s[0]) ** 2 + s[1] ** 2


def test_products_are_exact_at_every_size():
    chance = np.random.default_rng(3)
    for size in (1, 1 << 20, (1 << 26) - 1, 1 << 26, 1 << 61):
        z = chance.integers(-size, size + 1, (50, 4))
        z[0] = size
        assert (products(z) == z.astype(object).T @ z.astype(object)).all()
    assert (products(np.zeros((0, 3), np.int64)) == 0).all()


def test_polynomial_roots_and_null_space(spark):
    chance = np.random.default_rng(8)
    for d in (1, 2, 3, 7, 12):
        _, _, m = scatter_of(chance.integers(-30, 30, (d + 5, d)))
        m = [[int(v) for v in row] for row in m]
        trace = sum(m[i][i] for i in range(d))
        moduli = primes(d * (trace // d + 2).bit_length())
        poly = combined([polynomial_modulo(np.array([[v % p for v in row] for row in m], np.int64), p) for p in moduli], moduli)
        want = np.poly(np.array(m, float))[::-1]
        assert all(math.isclose(a, b, rel_tol=1e-8) for a, b in zip(poly, want)) and poly[d - 1] == -trace
        eigen = np.sort(np.linalg.eigvalsh(np.array(m, float)))[::-1]
        roots, s = largest_roots(poly, d, trace)
        assert np.allclose([r / 2**s for r in roots], eigen, rtol=1e-9)
        assert [roots_above(poly, int(c)) for c in (-1, *eigen.astype(int), trace + 1)] == [d, *[int((eigen > int(c)).sum()) for c in eigen], 0]
        vectors, values, _ = components(spark, m, d)
        assert np.allclose(np.array(m, float) @ vectors.T, vectors.T * np.array([float(v) for v in values]), atol=1e-7 * float(values[0]))
        assert np.abs(vectors @ vectors.T - np.eye(d)).max() < 1e-14


def test_multiple_roots():
    # (x - 5)^3 (x - 2)^2 x
    poly = [1]
    for r in (5, 5, 5, 2, 2, 0):
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    roots, s = largest_roots(poly, 6, 19)
    assert [round(r / 2**s, 12) for r in roots] == [5, 5, 5, 2, 2] and roots_above(poly, 4) == 3
    from decimal import Decimal

    basis = null_space([[2, 0, 0], [0, 2, 0], [0, 0, 1]], Decimal(2), 2)
    assert abs(sum(float(a) * float(b) for a, b in zip(*basis))) < 1e-30 and all(abs(v[2]) < Decimal("1e-30") for v in basis)


def test_primes():
    assert [p for p in range(60) if is_prime(p)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert primes(10) == [(1 << 31) - 1] and math.prod(primes(200)).bit_length() > 200 and not is_prime(46337 * 46327)
