"""Optimisers for many linear models at once.

Both work on ``evaluate(W, which, delta, curvature, along)``, which returns the sums of loss, gradient and curvature
of the models ``which`` at the weights ``W`` (one row per model, intercept last); with ``along`` the third part is the
curvature times these vectors, and with an array for ``curvature`` it is the curvature among these columns alone. The
caller decides whether the sums come from arrays in a task or from a Spark job, so there is one optimiser for both
cases. Without ``curvature`` (None) only losses are wanted: at ``W``, or, with ``along``, at all step lengths along these
vectors, one column each. With ``curvature`` False and ``along`` only the third part is. Which one a model gets depends on its loss and penalty, never on its data or the models beside it; only a sparse
model that comes to need more than ``DIRECT_FEATURES`` weights at once, or more than ``SPARSE_STEPS`` steps, is finished
by proximal steps.

Minimised: mean weighted loss + l1 * |w|_1 + l2 / 2 * |w|^2, intercept free.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

# Bounds of the second derivative of each loss with respect to the margin.
CURVATURE = {"sq_hinge": 2.0, "logistic": 0.25, "hinge": 1.0, "quadratic": 1.0}
HINGE_WIDTHS = (1.0, 0.5, 0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.0025, 0.001)  # the hinge is rounded off, ever more tightly
ROUGHLY = 1e-3  # slope at which a width is left for the next one
# Newton systems of wider models are solved without forming them; the steps are the same.
DIRECT_FEATURES = 256
LINE_LENGTHS = 2.0 ** -np.arange(0, 25)
NEW_FEATURES = 32  # a working set takes in so many features at first, later as many as have a weight

SWEEPS = 100  # of coordinate descent in one sparse step
SPARSE_STEPS = 40  # after these, proximal steps go on

CHECKED_STEPS = 10  # the first ones and then every tenth
Evaluate = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray | None]]
NO_COLUMN = -1  # fills up the rows of an array of columns
CURVED_MODELS = 8  # whose curved rows are remembered
SLICE_VALUES = 1 << 18  # margins that are held at once
GRAM_VALUES = 8_000_000  # of the summed curvature of all models: 64 MB
GRAM_SHARE = 0.25  # of a summed curvature that the values of all rows make up at least: fewer are multiplied themselves
SHORT_ROW = 64  # values of a mean row up to which its pairs of values are summed up
PAIR_VALUES = 1 << 21  # pairs of values that are held at once


@dataclass
class Problem:
    """M models over p features that share loss and optimiser."""

    loss: str
    l1: np.ndarray  # (M,)
    l2: np.ndarray  # (M,)
    free: np.ndarray  # (M, p + 1) weights that may move
    tol: float
    max_iter: int
    accelerate: bool = True
    step_size: float | None = None
    record: bool = False
    direct_features: int | None = None  # up to which Newton systems are formed, if not ``DIRECT_FEATURES``
    largest_row: float | np.ndarray | None = None  # largest squared norm of a row, without the intercept; one or one per model


@dataclass
class Fit:
    weights: np.ndarray
    steps: np.ndarray
    converged: np.ndarray
    history: list[list[float]]


def loss_terms(loss: str, margin: np.ndarray, delta: float):
    """Loss, first and second derivative by margin."""
    if loss == "sq_hinge":
        gap = np.maximum(0.0, 1.0 - margin)
        return gap * gap, -2.0 * gap, 2.0 * (gap > 0)
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))
        return np.logaddexp(0.0, -margin), -p, p * (1.0 - p)
    if loss == "hinge":
        gap = 1.0 - margin
        bent = np.clip(gap, 0.0, delta)
        value = bent * bent / (2.0 * delta) + np.maximum(gap - delta, 0.0)
        return value, -bent / delta, ((gap > 0) & (gap < delta)) / delta
    if loss == "quadratic":
        return 0.5 * margin * margin, margin, np.ones_like(margin)
    raise ValueError(f"unknown loss {loss!r}")


def loss_value(loss: str, margin: np.ndarray, delta: float) -> np.ndarray:
    """The loss alone."""
    if loss == "sq_hinge":
        gap = np.maximum(0.0, 1.0 - margin)
        return gap * gap
    if loss == "logistic":
        return np.logaddexp(0.0, -margin)
    return loss_terms(loss, margin, delta)[0]


def _times(x, w: np.ndarray) -> np.ndarray:
    return x @ w.T if isinstance(x, np.ndarray) else x.times(w)


def _gathered(x, c: np.ndarray) -> np.ndarray:
    return c.T @ x if isinstance(x, np.ndarray) else x.gathered(c)


def _some(x, columns: np.ndarray) -> np.ndarray:
    if not isinstance(x, np.ndarray):
        return x.dense(columns)
    return x if columns.size == x.shape[1] else x[:, columns]


def batch_sums(
    x, y: np.ndarray, s: np.ndarray, w: np.ndarray, loss: str, delta: float, curvature: bool | np.ndarray | None,
    along: np.ndarray | None = None,
):
    """Sums over the rows of one batch for every model in ``w``; ``x``, an array or sparse rows, ends with a column of ones.

    ``s`` weighs the rows, all models alike or, with a column for each, every model in its own way. ``curvature`` may be
    an array of columns, one row per model in rising order, filled up with ``NO_COLUMN``: then it is summed among these only.
    """
    wide = len(w) * (LINE_LENGTHS.size if curvature is None and along is not None else 1)
    if isinstance(curvature, np.ndarray):
        wide = max(wide, curvature.shape[1])
    elif curvature:
        wide = max(wide, x.shape[1])
    rows = max(256, SLICE_VALUES // max(1, wide))
    sums = _slice_sums(x[:rows], y[:rows], s[:rows], w, loss, delta, curvature, along)
    for start in range(rows, len(y), rows):
        at = slice(start, start + rows)
        more = _slice_sums(x[at], y[at], s[at], w, loss, delta, curvature, along)
        sums = tuple(None if a is None else a + b for a, b in zip(sums, more))
    return sums


def _slice_sums(x, y, s, w, loss, delta, curvature, along):
    each = s if s.ndim == 2 else s[:, None]
    margin = y[:, None] * _times(x, w)
    if curvature is None:
        if along is None:
            return (each * loss_value(loss, margin, delta)).sum(axis=0), None, None
        slant = y[:, None] * _times(x, along)
        value = loss_value(loss, margin[:, :, None] + slant[:, :, None] * LINE_LENGTHS, delta)
        return (each[:, :, None] * value).sum(axis=0), None, None
    value, slope, bend = loss_terms(loss, margin, delta)
    if along is not None:
        bent = bend * each
        if loss == "hinge":  # rows off the rounded corner have no curvature
            on = np.flatnonzero(bent.any(axis=1))
            if 2 * on.size < len(bent):
                x, bent = x[on], bent[on]
        return None, None, _gathered(x, bent * _times(x, along))
    total, grad = (each * value).sum(axis=0), _gathered(x, slope * each * y[:, None])
    if not isinstance(curvature, np.ndarray):
        if not curvature:
            return total, grad, None
        curvature = np.tile(np.arange(x.shape[1]), (len(w), 1))
    among = np.zeros((*curvature.shape, curvature.shape[1]))
    weights = each * bend
    for j, columns in enumerate(curvature):
        some = _some(x, columns[columns != NO_COLUMN])
        among[j, : some.shape[1], : some.shape[1]] = (some * weights[:, j][:, None]).T @ some
    return total, grad, among


class CurvedRows:
    """Products with the curvature for a caller that has all rows: curved rows are found once for the weights they belong to.

    The curvature of the hinge is the same for all rows in its corner. Of many short rows it is summed up once for a model, and
    new weights or another width only add the rows that came into the corner and take off those that left it.
    """

    def __init__(self, x, y: np.ndarray, s: np.ndarray, loss: str, models: int = 1):
        self.x, self.y, self.s, self.loss = x, y, s, loss
        self.known: dict[int, tuple] = {}
        side = x.shape[1]
        values = 0 if isinstance(x, np.ndarray) else len(x.vals)
        self.summed = loss == "hinge" and models * side**2 <= GRAM_VALUES and GRAM_SHARE * side**2 <= values <= SHORT_ROW * len(x)
        self.grams: dict[int, tuple] = {}

    def products(self, w: np.ndarray, which: np.ndarray, delta: float, along: np.ndarray) -> np.ndarray:
        out = np.empty_like(along)
        for i, model in enumerate(which):
            found = self.known.pop(model, None)
            if found is None or found[0] != delta or not np.array_equal(found[1], w[i]):
                found = (delta, w[i].copy(), *self._curved(model, w[i:i + 1], delta))
            _, _, x, bent = self.known[model] = found
            out[i] = _gathered(x, bent * _times(x, along[i:i + 1]))[0]
            while len(self.known) > CURVED_MODELS:
                self.known.pop(next(iter(self.known)))
        return out

    def _curved(self, model: int, w: np.ndarray, delta: float) -> tuple:
        each = self.s[:, model:model + 1] if self.s.ndim == 2 else self.s[:, None]
        bent = each * loss_terms(self.loss, self.y[:, None] * _times(self.x, w), delta)[2]
        on = np.flatnonzero(bent)
        return (self.x[on], bent[on]) if 2 * on.size < len(bent) else (self.x, bent)

    def among(self, w: np.ndarray, which: np.ndarray, delta: float, columns: np.ndarray) -> np.ndarray:
        """The curvature among these columns, as ``batch_sums`` gives it."""
        out = np.zeros((*columns.shape, columns.shape[1]))
        for j, model in enumerate(which):
            own = columns[j][columns[j] != NO_COLUMN]
            out[j, : own.size, : own.size] = self._gram(model, w[j], delta)[np.ix_(own, own)] / delta
        return out

    def _gram(self, model: int, w: np.ndarray, delta: float) -> np.ndarray:
        """Sum of s x x' over the rows in the corner: the curvature times the width."""
        last = self.grams.get(model)
        s = self.s[:, model] if self.s.ndim == 2 else self.s
        on = loss_terms(self.loss, self.y * _times(self.x, w[None])[:, 0], delta)[2] > 0
        if last is None or (changed := np.flatnonzero(on != last[0])).size >= on.sum():
            rows, gram = np.flatnonzero(on), np.zeros((w.size, w.size))
            self.grams.pop(model, None)
            self.x[rows].add_squares(gram, s[rows], PAIR_VALUES)
        else:
            gram = last[1]
            self.x[changed].add_squares(gram, np.where(on[changed], s[changed], -s[changed]), PAIR_VALUES)
        self.grams[model] = on, gram
        return gram


def solve(problem: Problem, evaluate: Evaluate) -> Fit:
    smooth = problem.l1 == 0
    sparse = _sparse_newton if problem.step_size is None and problem.loss != "hinge" else _proximal
    if not problem.accelerate:
        return _proximal(problem, evaluate)
    if not smooth.any():
        return sparse(problem, evaluate)
    if smooth.all():
        return _newton(problem, evaluate)
    fit = None
    for some, optimiser in ((np.flatnonzero(smooth), _newton), (np.flatnonzero(~smooth), sparse)):
        part = optimiser(*_only(problem, evaluate, some))
        if fit is None:
            m, p1 = problem.free.shape
            fit = Fit(np.zeros((m, p1)), np.zeros(m, dtype=int), np.zeros(m, dtype=bool), [[] for _ in range(m)])
        fit.weights[some], fit.steps[some], fit.converged[some] = part.weights, part.steps, part.converged
        for i, line in zip(some, part.history):
            fit.history[i] = line
    return fit


def _only(problem: Problem, evaluate: Evaluate, some: np.ndarray) -> tuple[Problem, Evaluate]:
    """The problem of some of the models."""
    rows = problem.largest_row[some] if isinstance(problem.largest_row, np.ndarray) else problem.largest_row
    part = replace(problem, l1=problem.l1[some], l2=problem.l2[some], free=problem.free[some], largest_row=rows)
    return part, lambda w, which, *more: evaluate(w, some[which], *more)


def _penalised(problem: Problem, w: np.ndarray, which: np.ndarray) -> np.ndarray:
    body = w[:, :-1]
    return problem.l1[which] * np.abs(body).sum(axis=1) + 0.5 * problem.l2[which] * (body * body).sum(axis=1)


def _largest_eigenvalue(problem: Problem, evaluate: Evaluate, rounds: int = 20) -> np.ndarray:
    """Power iteration on the weighted second-moment matrix of every model."""
    m, p1 = problem.free.shape
    everyone = np.arange(m)
    v = problem.free * (1.0 + 0.1 * np.cos(np.arange(p1)))
    value = np.ones(m)
    for _ in range(rounds):
        v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
        v = evaluate(v, everyone, -1.0, False)[1] * problem.free
        value = np.linalg.norm(v, axis=1)
    return np.maximum(1.1 * value, 1e-12)


def _proximal(problem: Problem, evaluate: Evaluate, start: np.ndarray | None = None) -> Fit:
    """Proximal gradient steps, accelerated with restarts unless ``accelerate`` is off."""
    m, p1 = problem.free.shape
    delta = HINGE_WIDTHS[-1]
    bend = CURVATURE[problem.loss] / (delta if problem.loss == "hinge" else 1.0)
    if problem.step_size is None and not problem.accelerate and problem.largest_row is not None:
        step = np.ones(m) / (bend * problem.largest_row + 1e-12)
    elif problem.step_size is None:
        step = 1.0 / (bend * _largest_eigenvalue(problem, evaluate) + problem.l2)
    else:
        step = np.full(m, problem.step_size)
    w = np.zeros((m, p1)) if start is None else start.copy()
    v, t = w.copy(), np.ones(m)
    steps, done = np.zeros(m, dtype=int), np.zeros(m, dtype=bool)
    history: list[list[float]] = [[] for _ in range(m)]
    for _ in range(problem.max_iter):
        a = np.flatnonzero(~done)
        if a.size == 0:
            break
        total, grad, _ = evaluate(v[a], a, delta, False)
        if problem.record:
            for j, value in zip(a, total + _penalised(problem, v[a], a)):
                history[j].append(float(value))
        grad[:, :-1] += problem.l2[a][:, None] * v[a][:, :-1]
        new = (v[a] - step[a][:, None] * grad) * problem.free[a]
        shrink = (step[a] * problem.l1[a])[:, None]
        new[:, :-1] = np.sign(new[:, :-1]) * np.maximum(np.abs(new[:, :-1]) - shrink, 0.0)
        moved, change = new - v[a], new - w[a]
        if problem.step_size is None and problem.accelerate and (steps[a] < CHECKED_STEPS).any() | (steps[a] % CHECKED_STEPS == 0).any():
            # the step rests on an estimate: where the quadratic bound fails at it, halve it and try again
            reached = evaluate(new, a, delta, None)[0] + 0.5 * problem.l2[a] * (new[:, :-1] ** 2).sum(axis=1)
            bound = total + 0.5 * problem.l2[a] * (v[a][:, :-1] ** 2).sum(axis=1) + (grad * moved).sum(axis=1)
            bound += (moved * moved).sum(axis=1) / (2.0 * step[a])
            failed = reached > bound + 1e-12 * np.maximum(1.0, np.abs(bound))
            step[a[failed]] *= 0.5
            a, new, moved, change = a[~failed], new[~failed], moved[~failed], change[~failed]
            if a.size == 0:
                continue
        steps[a] += 1
        if problem.accelerate:
            done[a] = np.abs(moved).max(axis=1) <= problem.tol * np.maximum(step[a], 1e-12)
            restart = (-moved * change).sum(axis=1) > 0
            t_new = np.where(restart, 1.0, 0.5 * (1.0 + np.sqrt(1.0 + 4.0 * t[a] ** 2)))
            pull = np.where(restart, 0.0, (t[a] - 1.0) / t_new)
            v[a] = new + pull[:, None] * change
            t[a] = t_new
        else:
            done[a] = np.linalg.norm(change[:, :-1], axis=1) + np.abs(change[:, -1]) < problem.tol
            v[a] = new
        w[a] = new
    return Fit(w, steps, done, history)


def _newton(problem: Problem, evaluate: Evaluate) -> Fit:
    """Damped Newton steps; one pass for slope and curvature, one for all step lengths together.

    Models of up to ``direct_features`` weights sum up their curvature; for wider ones conjugate gradients solve the
    same system with one pass for each product.
    """
    m, p1 = problem.free.shape
    w = np.zeros((m, p1))
    steps, converged = np.zeros(m, dtype=int), np.zeros(m, dtype=bool)
    lengths = LINE_LENGTHS
    most = DIRECT_FEATURES if problem.direct_features is None else problem.direct_features
    direct = problem.free.sum(axis=1) <= most
    widths = HINGE_WIDTHS if problem.loss == "hinge" else (1.0,)
    for delta in widths:
        done = np.zeros(m, dtype=bool)
        converged[:] = False
        for _ in range(problem.max_iter):
            a = np.flatnonzero(~done)
            if a.size == 0:
                break
            narrow, wide = np.flatnonzero(direct[a]), np.flatnonzero(~direct[a])
            total, grad, bend = np.zeros(a.size), np.zeros((a.size, p1)), None
            if narrow.size:
                own = [np.flatnonzero(problem.free[i]) for i in a[narrow]]
                columns = np.full((narrow.size, max(1, max(c.size for c in own))), NO_COLUMN)
                for row, c in zip(columns, own):
                    row[: c.size] = c
                total[narrow], grad[narrow], bend = evaluate(w[a[narrow]], a[narrow], delta, columns)
            if wide.size:
                total[wide], grad[wide], _ = evaluate(w[a[wide]], a[wide], delta, False)
            now = total + _penalised(problem, w[a], a)
            grad[:, :-1] += problem.l2[a][:, None] * w[a][:, :-1]
            grad *= problem.free[a]
            size = np.abs(grad).max(axis=1)
            flat = size <= (problem.tol if delta == widths[-1] else max(problem.tol, ROUGHLY))
            done[a[flat]] = converged[a[flat]] = True
            direction = np.zeros((a.size, p1))
            for i in np.flatnonzero(~flat):
                if direct[a[i]]:
                    free = np.flatnonzero(problem.free[a[i]])
                    system = bend[np.searchsorted(narrow, i), : free.size, : free.size]
                    system[np.diag_indices(free.size)] += _ridge(problem, a[i:i + 1], size[i:i + 1])[0, free]
                    direction[i, free] = -np.linalg.solve(system, grad[i, free])
            far = wide[~flat[wide]]
            if far.size:
                direction[far] = _conjugate_gradients(problem, evaluate, w[a[far]], a[far], grad[far], size[far], delta)
            a, now, direction = a[~flat], now[~flat], direction[~flat]
            if a.size == 0:
                break
            tries = w[a][:, None, :] + lengths[None, :, None] * direction[:, None, :]
            trial = evaluate(w[a], a, delta, None, direction)[0]
            trial = trial + _penalised(problem, tries.reshape(-1, p1), np.repeat(a, lengths.size)).reshape(a.size, -1)
            best = trial.argmin(axis=1)
            better = trial[np.arange(a.size), best] < now
            w[a[better]] = tries[better, best[better]]
            steps[a] += 1
            # No length improves the objective any more: the optimum to machine precision.
            done[a[~better]] = converged[a[~better]] = True
    return Fit(w, steps, converged, [[] for _ in range(m)])


def _ridge(problem: Problem, which: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Diagonal added to the curvature: the L2 penalty and a little more, that vanishes with the slope."""
    ridge = np.repeat(np.maximum(1e-10, 1e-3 * np.minimum(size, 1.0))[:, None], problem.free.shape[1], axis=1)
    ridge[:, :-1] += problem.l2[which][:, None]
    return ridge


CG_TOLERANCE = (1e-6, 1e-2)  # least and greatest relative residual: directions get exact as the slope vanishes


def _conjugate_gradients(problem, evaluate, w, which, grad, size, delta) -> np.ndarray:
    """Newton directions of several models by conjugate gradients, each to a relative residual of the size of its slope."""
    free, ridge = problem.free[which], _ridge(problem, which, size)
    found, residual = np.zeros_like(grad), -grad
    along = residual.copy()
    norm = (residual * residual).sum(axis=1)
    goal = np.clip(size, *CG_TOLERANCE) ** 2 * norm
    for _ in range(2 * grad.shape[1]):
        o = np.flatnonzero(norm > goal)
        if o.size == 0:
            break
        bent = evaluate(w[o], which[o], delta, False, along[o])[2] * free[o] + ridge[o] * along[o]
        step = norm[o] / (along[o] * bent).sum(axis=1)
        found[o] += step[:, None] * along[o]
        residual[o] -= step[:, None] * bent
        new = (residual[o] * residual[o]).sum(axis=1)
        along[o] = residual[o] + (new / norm[o])[:, None] * along[o]
        norm[o] = new
    return found


def _violation(problem: Problem, w: np.ndarray, grad: np.ndarray, which: np.ndarray) -> np.ndarray:
    """By how much each weight misses the condition of the optimum; ``grad`` includes the L2 penalty."""
    l1 = problem.l1[which][:, None]
    body, slope = w[:, :-1], grad[:, :-1]
    off = np.where(body != 0, np.abs(slope + l1 * np.sign(body)), np.maximum(np.abs(slope) - l1, 0.0))
    return np.column_stack([off, np.abs(grad[:, -1])]) * problem.free[which]


def _working_set(problem: Problem, model: int, w: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Columns of the next step: those with a weight, the intercept, and the weightless ones that miss their condition most."""
    p = w.size - 1
    kept = np.flatnonzero(w[:p])
    missing = np.flatnonzero((w[:p] == 0) & (off[:p] > 0))
    room = max(1, min(max(NEW_FEATURES, kept.size), DIRECT_FEATURES - kept.size))
    if missing.size > room:
        missing = missing[np.argsort(-off[missing], kind="stable")[:room]]
    columns = np.concatenate([kept, missing, [p]])
    return np.sort(columns[problem.free[model, columns] > 0])


def _sparse_step(system: np.ndarray, target: np.ndarray, l1: np.ndarray, u: np.ndarray, near: float) -> np.ndarray:
    """Least of u' system u / 2 - target' u + l1' |u|: coordinate descent, finished by a linear solve once the signs stand.

    Until they do, changes of slope below ``near`` end it: the next step starts from better slopes anyway.
    """
    u, diagonal = u.copy(), np.diag(system)
    product = system @ u
    scale = np.abs(target).max() + l1.max()
    for _ in range(SWEEPS):
        largest = 0.0
        for j in range(u.size):
            pull = target[j] - product[j] + diagonal[j] * u[j]
            new = (pull - min(max(pull, -l1[j]), l1[j])) / diagonal[j]
            if new != u[j]:
                product += system[:, j] * (new - u[j])
                largest = max(largest, abs(new - u[j]) * diagonal[j])
                u[j] = new
        on = np.flatnonzero(u)
        solved = np.zeros_like(u)
        solved[on] = np.linalg.solve(system[np.ix_(on, on)], target[on] - l1[on] * np.sign(u[on]))
        if np.all((np.sign(solved[on]) == np.sign(u[on])) | (l1[on] == 0)):
            left = np.abs(target - system @ solved)
            left[on] = 0.0
            if np.all(left <= l1 + 1e-14 * scale):
                return solved
        if largest <= near:
            break
    return u


def _sparse_newton(problem: Problem, evaluate: Evaluate) -> Fit:
    """Proximal Newton steps on working sets of features.

    A step takes two passes: one for all slopes and for the curvature among the working set, one for all step lengths
    together. The model is done when every feature, inside the set or not, meets its condition within ``tol``.
    """
    m, p1 = problem.free.shape
    w = np.zeros((m, p1))
    steps, done, wide = np.zeros(m, dtype=int), np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
    history: list[list[float]] = [[] for _ in range(m)]
    only_intercept = np.array([p1 - 1])
    sets = [only_intercept[problem.free[i, only_intercept] > 0] for i in range(m)]
    for _ in range(problem.max_iter + 1):
        a = np.flatnonzero(~done & ~wide)
        if a.size == 0:
            break
        columns = np.full((a.size, max(1, max(sets[i].size for i in a))), NO_COLUMN)
        for row, i in zip(columns, a):
            row[: sets[i].size] = sets[i]
        total, grad, bend = evaluate(w[a], a, 1.0, columns)
        grad[:, :-1] += problem.l2[a][:, None] * w[a][:, :-1]
        now = total + _penalised(problem, w[a], a)
        off = _violation(problem, w[a], grad, a)
        size = off.max(axis=1)
        done[a] = size <= problem.tol
        ridge = _ridge(problem, a, size)
        direction, inside = np.zeros((a.size, p1)), np.ones(a.size, dtype=bool)
        for r, i in enumerate(a):
            held = sets[i]
            if problem.record:
                history[i].append(float(now[r]))
            if done[i]:
                continue
            if held.size:
                k = held.size
                system = bend[r, :k, :k] + np.diag(ridge[r, held])
                target = system @ w[i, held] - grad[r, held]
                l1 = np.where(held == p1 - 1, 0.0, problem.l1[i])
                direction[r, held] = _sparse_step(system, target, l1, w[i, held], 0.01 * size[r]) - w[i, held]
            outside = np.ones(p1, dtype=bool)
            outside[held] = False
            inside[r] = not (off[r, outside] > problem.tol).any()
        going = ~done[a]
        a, now, direction, off, inside = a[going], now[going], direction[going], off[going], inside[going]
        ended = steps[a] >= problem.max_iter
        if a.size == 0 or ended.all():
            break
        tries = w[a][:, None, :] + LINE_LENGTHS[None, :, None] * direction[:, None, :]
        trial = evaluate(w[a], a, 1.0, None, direction)[0]
        trial = trial + _penalised(problem, tries.reshape(-1, p1), np.repeat(a, LINE_LENGTHS.size)).reshape(a.size, -1)
        best = trial.argmin(axis=1)
        better = trial[np.arange(a.size), best] < now
        w[a[better]] = tries[better, best[better]]
        steps[a] += 1
        # No length improves the objective and no feature waits outside: the optimum to machine precision.
        done[a[~better & inside]] = True
        for r, i in enumerate(a):
            sets[i] = _working_set(problem, i, w[i], off[r])
            wide[i] = np.count_nonzero(w[i]) > DIRECT_FEATURES or steps[i] >= SPARSE_STEPS
    rest = np.flatnonzero(wide & ~done)
    if rest.size:
        part, some = _only(problem, evaluate, rest)
        fit = _proximal(part, some, w[rest])
        w[rest], done[rest] = fit.weights, fit.converged
        steps[rest] += fit.steps
        for i, line in zip(rest, fit.history):
            history[i] += line
    return Fit(w, steps, done, history)
