"""Whitening against numpy's symmetric eigenvalue solver, and its numerics alone."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fileledger.llm import bidiagonal, whitening

KIND = "vec_id bigint, embedding array<double>, label int, n string"


def solved(matrix: np.ndarray) -> None:
    values, vectors = bidiagonal.right_singular(matrix)
    want = np.linalg.svd(matrix, compute_uv=False)
    top = max(want[0], 1e-100)
    assert np.all(np.diff(values) <= 0)
    assert np.max(np.abs(np.sqrt(values) - want)) < 1e-12 * top
    assert np.max(np.abs(vectors.T @ vectors - np.eye(len(matrix)))) < 1e-7
    assert np.max(np.abs(matrix.T @ (matrix @ vectors) - vectors * values)) < 1e-10 * top**2


def test_singular_vectors():
    pick = np.random.default_rng(3)
    turn = np.linalg.qr(pick.standard_normal((40, 40)))[0]
    wilkinson = np.diag(abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    rows = pick.standard_normal((300, 20)) @ pick.standard_normal((20, 48))
    close = np.diag([5.0] * 20 + [5 * (1 + 1e-9)] * 10 + [1.0] * 10)
    for matrix in (
        pick.standard_normal((64, 64)), np.triu(pick.standard_normal((90, 90))), np.eye(7), close @ turn, wilkinson,
        np.linalg.qr(rows)[1], np.ones((6, 6)), np.array([[3.0]]), np.zeros((4, 4)), np.diag([1.0, 0, 2, 0]),
        np.linalg.qr(pick.standard_normal((4000, 64)))[1],
    ):
        solved(matrix)
    for size in range(2, 10):
        for _ in range(20):
            solved(pick.standard_normal((size, size)) * 10.0 ** pick.integers(-8, 3, (size, 1)))


def test_small_singular_values_keep_their_digits():
    # The determinant, a product, is known to all digits.
    pick = np.random.default_rng(4)
    main, above = 10.0 ** pick.uniform(-9, 0, 30), 10.0 ** pick.uniform(-9, 0, 29)
    values = bidiagonal.dqds(main**2, above**2)
    assert np.log(values).sum() == pytest.approx(2 * np.log(main).sum(), abs=1e-11)


def brute(rows):
    good = [
        (i, [math.floor(64 * c) + 1000000 for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = np.array(sorted({tuple(x) for _, x in good}), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return good, n, sums, values[::-1], vectors[:, ::-1]


def compare(frame, components=16):
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    good, n, sums, values, vectors = brute(rows)
    found = whitening.whitened_embeddings(frame, components).collect()
    count = min(components, int((values > values[0] * 1e-12).sum()))
    assert len(found) == len(good) * count
    want = {}
    for i, x in good:
        scaled = n * np.array(x) - sums
        want[i] = sum(int(v) ** 2 for v in scaled), scaled / n @ vectors[:, :count] / np.sqrt(values[:count])
    for k in range(1, count + 1):
        own = [r for r in found if r.component == k]
        y = np.array([want[r.vec_id][1][k - 1] for r in own])
        w = np.array([r.whitened for r in own])
        assert min(np.abs(y - w).max(), np.abs(y + w).max()) < 1e-8
        assert all(r.n == n and r.deviation == want[r.vec_id][0] for r in own)
        assert all(abs(r.explained / (values[k - 1] / values.sum()) - 1) < 1e-9 for r in own)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-10


def test_whitening_of_the_table(spark):
    compare(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(5))


def test_whitening_of_odd_rows(spark):
    pick = np.random.default_rng(5)
    rows = [(k, (pick.standard_normal(6) * [9, 3, 1, 0.5, 0.1, 1e4]).tolist(), k, "x") for k in range(80)]
    rows += [(200 + k, rows[k % 3][1], 0, None) for k in range(300)]  # copies count once
    rows += [(900, None, 1, ""), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, ""), (902, [math.inf] * 6, 1, ""), (903, [math.nan] * 6, 1, "")]
    frame = spark.createDataFrame(rows, KIND)
    compare(frame.repartition(7))
    compare(frame.repartition(40, "vec_id"), 3)
    # Vectors of another length and empty ones are left out; ids may be null or repeated.
    more = spark.createDataFrame([(1, [1.0], 1, ""), (2, [], 1, ""), (None, rows[0][1], 1, ""), (5, rows[5][1], 1, "")], KIND)
    found = whitening.whitened_embeddings(frame.unionByName(more), 2).collect()
    assert len(found) == 2 * 382 and sum(r.vec_id is None for r in found) == 2 and sum(r.vec_id == 5 for r in found) == 4


def test_vectors_without_a_direction(spark):
    assert whitening.whitened_embeddings(spark.createDataFrame([], KIND)).count() == 0
    assert whitening.whitened_embeddings(spark.createDataFrame([(1, None, 1, ""), (2, [], 1, "")], KIND)).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0], 1, "") for k in range(9)], KIND)
    assert whitening.whitened_embeddings(same).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.5], 1, "") for k in range(9)], KIND)
    assert {r.component for r in whitening.whitened_embeddings(line).collect()} == {1}
    compare(line)


def test_exact_deviations_beyond_64_bits(spark):
    rows = [(k, [1e15 * k, 2.0], 1, "") for k in range(4)]
    found = whitening.whitened_embeddings(spark.createDataFrame(rows, KIND), 1).collect()
    assert [r.deviation for r in found] == [None] * 4
    assert found[0].identity_error < 1e-10
