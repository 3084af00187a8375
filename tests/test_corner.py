"""The summed curvature of rows in the corner of the hinge."""

from __future__ import annotations

import numpy as np
import pandas as pd

from peaklake.operators import descent as D
from peaklake.operators import solver as S
from peaklake.operators.rowblocks import Sparse


def _rows(n: int, p: int, share: float):
    rng = np.random.default_rng(4)
    whole = np.where(rng.random((n, p)) < share, rng.normal(2.0, 1.0, (n, p)), 0.0)
    whole[3] = 0.0  # a row without values
    row, col = np.nonzero(whole)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    y01 = (whole[:, 0] - whole[:, 1] + rng.normal(size=n) > 0).astype(float)
    return Sparse(ends, col.astype(np.int32), whole[row, col], p), y01


def test_curvature_follows_weights_and_widths():
    x, y01 = _rows(400, 30, 0.2)
    signs, s = 2.0 * y01 - 1.0, np.linspace(0.5, 1.5, 400) / 400
    curved, rng = D.CurvedRows(x, signs, s, "hinge"), np.random.default_rng(5)
    assert curved.summed
    columns, which, w = np.arange(31)[None], np.array([0]), np.zeros((1, 31))
    for delta in (1.0, 0.5, 0.5, 0.1, 1.0):
        expected = D.batch_sums(x, signs, s, w, "hinge", delta, columns)[2]
        np.testing.assert_allclose(curved.among(w, which, delta, columns), expected, atol=1e-11)
        w = w + 0.05 * rng.normal(size=w.shape)


def test_squares_do_not_depend_on_the_cut():
    x, _ = _rows(50, 12, 0.3)
    weights, whole = np.linspace(-1.0, 1.0, 50), x.dense(np.arange(13))
    for most in (1, 40, 10_000):
        total = np.zeros((13, 13))
        x.add_squares(total, weights, most)
        np.testing.assert_allclose(total, (whole * weights[:, None]).T @ whole, atol=1e-12)


def test_wide_svc_of_many_short_rows_forms_no_products(monkeypatch):
    """Every step took hundreds of passes over the rows; the optimum is the same."""
    x, y01 = _rows(3_000, 300, 0.03)
    blocks = pd.DataFrame({
        "y": [y01.tobytes()], "multiplicity": [np.ones(3_000).tobytes()], "ends": [x.ends.astype(np.int64).tobytes()],
        "cols": [x.cols.tobytes()], "vals": [x.vals.tobytes()], "n": [3_000], "p": [300],
    })
    models = pd.DataFrame([{
        "model": "m", "positions": None, "kind": "svc", "C": 0.01, "lam": 0.0, "l1_ratio": 0.0, "balanced": True,
        "fit_intercept": True, "tol": 1e-7, "max_iter": 200, "accelerate": True, "step_size": np.nan, "record_history": False,
    }])
    passes, products = [], D.CurvedRows.products
    monkeypatch.setattr(D.CurvedRows, "products", lambda *a: passes.append(1) or products(*a))
    summed = S._fit_group(blocks, models).iloc[0]
    assert not passes and summed["converged"]
    monkeypatch.setattr(D, "GRAM_VALUES", 0)
    plain = S._fit_group(blocks, models).iloc[0]
    assert passes and plain["converged"]
    np.testing.assert_allclose(summed["coef"], plain["coef"], atol=1e-5)
    assert abs(summed["intercept"] - plain["intercept"]) < 1e-5
