"""Packed rows: sparse products, blocks, and what a pass over large keys sends to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from peaklake.operators import descent, solver
from peaklake.operators.rowblocks import Sparse, packed, together

RNG = np.random.default_rng(4)


def sparse_rows(n: int, p: int):
    x = np.where(RNG.random((n, p)) < 0.1, RNG.normal(size=(n, p)), 0.0)
    x[3] = 0.0
    row, col = np.nonzero(x)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return np.column_stack([x, np.ones(n)]), Sparse(ends, col, x[row, col], p)


def test_sparse_products_are_those_of_the_dense_matrix():
    dense, sparse = sparse_rows(40, 30)
    w, c = RNG.normal(size=(3, 31)), RNG.normal(size=(40, 3))
    np.testing.assert_allclose(sparse.times(w), dense @ w.T, atol=1e-12)
    np.testing.assert_allclose(sparse.gathered(c), c.T @ dense, atol=1e-12)
    np.testing.assert_allclose(sparse[np.array([5, 3, 9])].times(w), dense[[5, 3, 9]] @ w.T, atol=1e-12)
    np.testing.assert_allclose(sparse.dense(np.array([2, 7, 30])), dense[:, [2, 7, 30]])
    np.testing.assert_allclose(sparse.keep(np.array([2, 7])).times(w[:, [2, 7, 30]]), dense[:, [2, 7, 30]] @ w[:, [2, 7, 30]].T, atol=1e-12)
    y, s = np.where(dense[:, 0] > 0, 1.0, -1.0), np.full(40, 1 / 40)
    for loss in ("sq_hinge", "logistic", "hinge"):
        for curvature, along in ((False, None), (None, None), (None, w[::-1]), (False, w[::-1]), (np.array([[1, 4, 30]] * 3), None)):
            for a, b in zip(*(descent.batch_sums(x, y, s, w, loss, 0.5, curvature, along) for x in (dense, sparse))):
                assert (a is None) == (b is None)
                if a is not None:
                    np.testing.assert_allclose(a, b, atol=1e-12)


def test_blocks_hold_every_row_once(spark):
    n, p = 300, 20
    x = RNG.normal(size=(n, p))
    x[:, 1:] *= np.arange(n)[:, None] % 2 == 0  # rows of one key are sparse, those of the other dense
    rows = spark.createDataFrame([(i % 2, i % 3, 1 + i % 2, x[i].tolist()) for i in range(n)], "k int, y int, multiplicity int, x array<double>")
    found = packed(rows.repartition(3), ["k"]).toPandas()
    for k in (0, 1):
        y, times, held = together(found[found["k"] == k].reset_index(drop=True))
        assert isinstance(held, Sparse) == (k == 1)
        whole = held if k == 0 else held.dense(np.arange(p + 1))
        want = np.column_stack([x[k::2], np.ones(n // 2)])
        order, wanted = np.lexsort(whole.T[:1]), np.lexsort(want.T[:1])
        np.testing.assert_array_equal(whole[order], want[wanted])
        np.testing.assert_array_equal(y[order], (np.arange(n)[k::2] % 3)[wanted])
        assert (times == 1 + k).all()


def test_sparse_keys_are_measured_by_the_values_they_hold(spark, monkeypatch):
    """200 rows of 100 features with one value each take 300 numbers, not 20,000."""
    rows = spark.range(200).select(
        F.lit("d").alias("ds"), (F.col("id") % 2).cast("int").alias("y"),
        F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.when(i == F.col("id") % 100, 1.0 + F.col("id") / 200).otherwise(0.0)).alias("x"),
    ).cache()
    models = spark.range(1).select(F.lit("d").alias("ds"), F.lit("m").alias("model"), F.lit(None).cast("array<int>").alias("positions"), *solver.model_spec("logistic"))
    monkeypatch.setattr(solver, "_fit_distributed", None)  # would fail
    assert solver.fit_linear(rows, models, ["ds"], max_local_values=1_000).first().converged


def test_a_pass_sends_sums_only(spark, monkeypatch):
    """The line search sends one number for each length, and a symmetric matrix goes once."""
    x = RNG.normal(size=(60, 12))
    rows = spark.createDataFrame([("d", int(v[0] + RNG.normal() > 0), v.tolist()) for v in x], "ds string, y int, x array<double>").repartition(2).cache()
    models = spark.range(1).select(F.lit("d").alias("ds"), F.lit("m").alias("model"), F.lit(None).cast("array<int>").alias("positions"), *solver.model_spec("logistic", tol=1e-4))
    sent, job = [], solver._job

    def watched(*args):
        evaluate = job(*args)

        def run(w, which, delta, curvature, along=None):
            out = evaluate(w, which, delta, curvature, along)
            sent.append((curvature is None, [None if part is None else part.shape for part in out]))
            return out

        return run

    monkeypatch.setattr(solver, "_job", watched)
    there = solver.fit_linear(rows, models, ["ds"], max_local_values=1).first()
    here = solver.fit_linear(rows, models, ["ds"]).first()
    np.testing.assert_allclose(there.coef, here.coef, atol=1e-8)
    assert {s for only, shapes in sent if only for s in [tuple(map(str, shapes))]} == {(f"(1, {descent.LINE_LENGTHS.size})", "None", "None")}
