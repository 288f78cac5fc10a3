"""Whitening against numpy and exact arithmetic, and the odd rows."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tabloom.llm import whitening as w


def exact_polynomial(matrix):
    """Coefficients of det(x - matrix) by the traces of powers, in fractions."""
    d = len(matrix)
    c, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][x] * m[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = [[sum(matrix[i][x] * m[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(am[i][i] for i in range(d)) / k)
    return [int(v) for v in reversed(c)]


def gram(seed, d, rank, big):
    draw = random.Random(seed)
    m = [[draw.randint(-big, big) for _ in range(d)] for _ in range(rank)]
    return [[sum(row[i] * row[j] for row in m) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize(("d", "rank", "big"), [(1, 1, 9), (2, 1, 5), (4, 4, 10**9), (6, 3, 40), (9, 9, 10**6)])
def test_polynomial_is_exact(spark, d, rank, big):
    matrix = gram(d, d, rank, big)
    assert w.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_pivots_that_vanish(spark):
    matrix = [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]]
    assert w.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_roots_with_multiplicity_and_close_ones():
    def times(p, root):
        return [(p[k - 1] if k else 0) - root * (p[k] if k < len(p) else 0) for k in range(len(p) + 1)]

    p = [1]
    for root in (7, 7, 7, 10**9, 10**9 + 1, 0, 3):
        p = times(p, root)
    got = w.largest_roots(p, 6)
    assert [(round(float(r)), c) for r, c in got] == [(10**9 + 1, 1), (10**9, 1), (7, 3), (3, 1)]
    assert all(abs(r - round(r)) < Fraction(1, 2**100) for r, _ in got)
    assert w.largest_roots([0, 0, 1], 2) == []


def test_null_vectors_span_a_repeated_root():
    matrix = [[3, 0, 1, 0], [0, 4, 0, 0], [1, 0, 3, 0], [0, 0, 0, 4]]
    vectors = (w.null_vectors(matrix, Fraction(4), 3) / 2**200).astype(float)
    assert np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-15)
    assert np.allclose(np.array(matrix) @ vectors, 4 * vectors, atol=1e-14)


def vectors_of(draw, n, d):
    base = draw.normal(size=(n, d)) * np.linspace(2, 0.5, d)
    return [(int(i), [float(np.float32(v)) for v in row]) for i, row in enumerate(base)]


def brute(rows, scale=256, k=4):
    x = np.array([[math.floor(scale * c) for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    order = np.argsort(values)[::-1][:k]
    white = (x - total / n) @ vectors[:, order] / np.sqrt(values[order])
    return n, ((n * x - total) ** 2).sum(axis=1), white, values[order] / values.sum()


def test_whitening_is_that_of_numpy(spark):
    rows = vectors_of(np.random.default_rng(7), 300, 6)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows are one vector
    got = w.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect()
    n, deviation, white, explained = brute(rows)
    at = {i: k for k, (i, _) in enumerate(rows)}
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in got:
        k, c = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and int(r["deviation"]) == deviation[k]
        assert r["explained"] == pytest.approx(explained[c], rel=1e-12)
        sign = signs.setdefault(c, np.sign(r["whitened"] * white[k, c]))
        assert r["whitened"] == pytest.approx(sign * white[k, c], abs=1e-11)
    assert got[0]["identity_error"] < 1e-12


def test_repeated_eigenvalues_are_whitened(spark):
    rows = [(i, [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(
        [(s, 0, 0) for s in (1, -1)] + [(0, s, 0) for s in (1, -1)] + [(0, 0, s) for s in (1, -1)]
    )]
    got = w.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    assert got[0]["identity_error"] < 1e-12
    assert all(r["explained"] == pytest.approx(1 / 3) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [-0.0, 3.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
        (6, []), (7, [1.0]), (8, [5.0, 1.0]), (9, [1e15, -1e15]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS component", "3 AS n")
    got = w.whitened(df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted(
        (i is None, i or 0, c) for i in (1, 1, None, 8, 9) for c in (1, 2)
    )
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-9
    x = [[0, 256], [0, 768], [1280, 256], [256 * 10**15, -256 * 10**15]]
    sums = [sum(v[j] for v in x) for j in range(2)]
    by_id = {r["vec_id"]: r["deviation"] for r in got}
    for i, v in zip((1, None, 8, 9), x, strict=True):
        assert int(by_id[i]) == sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    assert w.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_one_vector_has_no_variance(spark):
    got = w.whitened(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in got] == [(1, 0, None, 0.0)] * 4
