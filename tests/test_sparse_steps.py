"""Sparse Newton steps against proximal steps: the same optimum in fewer passes over the data."""

from __future__ import annotations

import numpy as np
import pytest

from peaklake.operators import descent as D

TOL = 1e-7


def rows(n: int, p: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = np.where(x[:, :5] @ rng.normal(size=5) + rng.normal(size=n) > 0.5, 1.0, -1.0)
    return np.column_stack([x, np.ones(n)]), y, np.full(n, 1.0 / n)


def problem(loss, l1, l2, free, tol=TOL, **options):
    m = len(free)
    return D.Problem(loss=loss, l1=np.full(m, l1), l2=np.full(m, l2), free=free, tol=tol, max_iter=20_000, **options)


def run(optimiser, data, given):
    x, y, s = data
    passes = [0]

    def evaluate(w, which, delta, curvature, along=None):
        passes[0] += 1
        assert not isinstance(curvature, np.ndarray) or curvature.shape[1] <= D.DIRECT_FEATURES + 1
        return D.batch_sums(x, y, s, w, "quadratic" if delta < 0 else given.loss, delta, curvature, along)

    fit = optimiser(given, evaluate)
    everyone = np.arange(len(given.free))
    total, grad, _ = evaluate(fit.weights, everyone, 1.0, False)
    grad[:, :-1] += given.l2[:, None] * fit.weights[:, :-1]
    off = D._violation(given, fit.weights, grad, everyone)
    return fit, passes[0], total + D._penalised(given, fit.weights, everyone), off.max()


CASES = [
    (500, 64, "sq_hinge", 0.03, 0.0), (500, 64, "sq_hinge", 0.001, 0.0), (400, 24, "logistic", 0.0023, 0.0003),
    (400, 24, "logistic", 0.045, 0.005), (300, 1000, "logistic", 0.06, 0.007), (300, 1000, "sq_hinge", 0.1, 0.0),
]


@pytest.mark.parametrize("n,p,loss,l1,l2", CASES)
def test_same_optimum_in_less_than_half_the_passes(n, p, loss, l1, l2):
    data = rows(n, p)
    given = problem(loss, l1, l2, np.ones((2, p + 1)))
    plain, plain_passes, plain_value, _ = run(D._proximal, data, given)
    fit, passes, value, off = run(D._sparse_newton, data, given)
    assert plain.converged.all() and fit.converged.all() and off <= TOL
    assert np.all(value <= plain_value + 1e-10)
    np.testing.assert_allclose(fit.weights, plain.weights, atol=1e-3)
    assert passes < 50 and passes * 2 < plain_passes


def test_weights_that_may_not_move_stay_and_models_do_not_meet():
    data = rows(200, 12)
    free = np.ones((4, 13))
    free[0, :6], free[1, 12], free[2] = 0.0, 0.0, 0.0
    free[3, :12] = 0.0
    fit, _, _, off = run(D._sparse_newton, data, problem("logistic", 0.01, 0.001, free))
    assert fit.converged.all() and off <= TOL and np.all(fit.weights[free == 0] == 0)
    for i in range(4):
        alone, _, _, _ = run(D._sparse_newton, data, problem("logistic", 0.01, 0.001, free[i:i + 1]))
        np.testing.assert_allclose(alone.weights[0], fit.weights[i], atol=1e-10)


def test_a_model_of_many_weights_is_finished_by_proximal_steps(monkeypatch):
    monkeypatch.setattr(D, "DIRECT_FEATURES", 8)
    monkeypatch.setattr(D, "NEW_FEATURES", 4)
    data = rows(300, 40)
    given = problem("logistic", 0.001, 0.001, np.ones((1, 41)))
    plain, _, value, _ = run(D._proximal, data, given)
    fit, _, same, _ = run(D._sparse_newton, data, given)
    assert fit.converged.all() and np.count_nonzero(fit.weights) > 8
    np.testing.assert_allclose(same, value, atol=1e-10)


def test_one_class_alone_and_a_limit_of_steps():
    x, y, s = rows(100, 5)
    fit, _, _, _ = run(D._sparse_newton, (x, np.ones_like(y), s), problem("sq_hinge", 0.01, 0.0, np.ones((1, 6))))
    assert fit.converged.all() and np.all(fit.weights[0, :-1] == 0) and fit.weights[0, -1] == pytest.approx(1.0)
    given = problem("logistic", 0.001, 0.0, np.ones((1, 6)))
    given.max_iter = 2
    fit, _, _, _ = run(D._sparse_newton, (x, y, s), given)
    assert not fit.converged.any() and fit.steps[0] == 2
