"""The solver against optimality conditions, MLlib and a plain reference."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from peaklake.operators.solver import fit_linear, model_spec, score_models

N, P = 150, 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, P))
    y = (x @ rng.normal(size=P) + 1.5 * rng.normal(size=N) > 0.7).astype(int)
    rows = [("d", f"{i:03d}", "train", int(y[i]), x[i].tolist()) for i in range(N)]
    df = spark.createDataFrame(rows, "ds string, sample_id string, role string, y int, x array<double>").cache()
    return x, y, df


def models(spark, *specs, positions=None):
    out = None
    for name, kind, options in specs:
        pos = F.lit(None).cast("array<int>") if positions is None else F.array(*[F.lit(p) for p in positions])
        row = spark.range(1).select(F.lit("d").alias("ds"), F.lit(name).alias("model"), pos.alias("positions"), *model_spec(kind, **options))
        out = row if out is None else out.unionByName(row)
    return out


def fitted(spark, df, *specs, positions=None, **kw):
    rows = fit_linear(df, models(spark, *specs, positions=positions), ["ds"], **kw).collect()
    assert all(r.converged for r in rows)
    return {r.model: (np.array(r.coef), r.intercept, r) for r in rows}


ALL = [
    ("svm", "l1_svm", {"lam": 0.05}),
    ("net", "elastic_net", {"C": 0.1, "l1_ratio": 0.9}),
    ("log", "logistic", {"C": 1.0}),
    ("svc", "svc", {"C": 0.5}),
]


def test_distributed_steps_give_the_local_result(spark, data):
    _, _, df = data
    loose = [(n, k, {**o, "tol": 1e-4}) for n, k, o in ALL]
    here, there = fitted(spark, df, *loose), fitted(spark, df.repartition(3), *loose, max_local_values=1)
    for name in here:
        np.testing.assert_allclose(here[name][0], there[name][0], atol=1e-8)


def test_squared_hinge_optimality(spark, data):
    x, y, df = data
    w, b, _ = fitted(spark, df, ("m", "l1_svm", {"lam": 0.05, "tol": 1e-9}))["m"]
    s = 2 * y - 1
    gap = np.maximum(0, 1 - s * (x @ w + b))
    g = -2 / N * x.T @ (s * gap)
    assert abs(-2 / N * (s * gap).sum()) < 1e-6
    on = np.abs(w) > 0
    np.testing.assert_allclose(g[on], -0.05 * np.sign(w[on]), atol=1e-6)
    assert np.all(np.abs(g[~on]) <= 0.05 + 1e-6)


def balanced(y):
    return np.where(y == 1, N / (2 * y.sum()), N / (2 * (N - y.sum())))


def test_logistic_families_match_mllib(spark, data):
    x, y, df = data
    weighted = df.join(
        spark.createDataFrame([(f"{i:03d}", float(v)) for i, v in enumerate(balanced(y))], "sample_id string, sw double"), "sample_id"
    ).select(F.col("y").cast("double").alias("label"), "sw", array_to_vector("x").alias("features"))
    mine = fitted(spark, df, ("net", "elastic_net", {"C": 0.3, "l1_ratio": 0.7, "tol": 1e-9}), ("log", "logistic", {"C": 2.0}))
    for name, c, ratio in (("net", 0.3, 0.7), ("log", 2.0, 0.0)):
        theirs = LogisticRegression(
            elasticNetParam=ratio, regParam=1 / (c * N), standardization=False, weightCol="sw", tol=1e-12, maxIter=1000
        ).fit(weighted)
        np.testing.assert_allclose(mine[name][0], theirs.coefficients.toArray(), atol=1e-4)
        assert mine[name][1] == pytest.approx(theirs.intercept, abs=1e-4)


def test_svc_is_optimal_and_agrees_with_linear_svc(spark, data):
    x, y, df = data
    c, sw, s = 0.5, balanced(y), 2 * y - 1
    w, b, _ = fitted(spark, df, ("svc", "svc", {"C": c}))["svc"]
    margin = s * (x @ w + b)

    def objective(w, b):
        return 0.5 * w @ w + c * (sw * np.maximum(0, 1 - s * (x @ w + b))).sum()

    # Certificate: the slopes are a feasible point of the dual, whose value bounds the optimum from below.
    alpha = c * sw * np.clip((1 - margin) / 0.001, 0, 1)
    assert abs((alpha * s).sum()) < 1e-4
    pull = x.T @ (alpha * s)
    dual = alpha.sum() - 0.5 * pull @ pull
    assert objective(w, b) - dual <= 1e-4 * dual
    # LinearSVC stops further from the optimum; the two may differ only next to the boundary.
    weighted = df.join(
        spark.createDataFrame([(f"{i:03d}", float(v)) for i, v in enumerate(sw)], "sample_id string, sw double"), "sample_id"
    ).select(F.col("y").cast("double").alias("label"), "sw", array_to_vector("x").alias("features"))
    theirs = LinearSVC(regParam=1 / (c * N), standardization=False, weightCol="sw", tol=1e-9, maxIter=300).fit(weighted)
    assert objective(w, b) <= objective(theirs.coefficients.toArray(), theirs.intercept)
    f = x @ theirs.coefficients.toArray() + theirs.intercept
    differs = (x @ w + b >= 0) != (f >= 0)
    assert differs.mean() < 0.05 and np.all(np.abs((x @ w + b)[differs]) < 0.1)


def test_plain_steps_reach_the_same_optimum_and_record_history(spark, data):
    _, _, df = data
    fast = fitted(spark, df, ("m", "l1_svm", {"lam": 0.05, "tol": 1e-9}))["m"]
    slow = fitted(spark, df, ("m", "l1_svm", {"lam": 0.05, "accelerate": False, "tol": 1e-9, "record_history": True}))["m"]
    np.testing.assert_allclose(fast[0], slow[0], atol=1e-5)
    history = slow[2].history
    assert len(history) == slow[2].n_steps and all(a >= b - 1e-12 for a, b in zip(history, history[1:]))


def test_two_plain_steps_by_hand(spark, data):
    x, y, df = data
    step = 1 / (2 * (x ** 2).sum(axis=1).max())
    spec = ("m", "l1_svm", {"lam": 0.05, "accelerate": False, "step_size": step, "max_iter": 2})
    row = fit_linear(df, models(spark, spec), ["ds"]).first()
    w, b, s = np.zeros(P), 0.0, 2 * y - 1
    for _ in range(2):
        pull = -2 / N * s * np.maximum(0, 1 - s * (x @ w + b))
        w, b = w - step * x.T @ pull, b - step * pull.sum()
        w = np.sign(w) * np.maximum(np.abs(w) - step * 0.05, 0)
    np.testing.assert_allclose(row.coef, w, atol=1e-12)
    assert not row.converged and row.n_steps == 2


def test_positions_and_multiplicity(spark, data):
    _, _, df = data
    spec = ("m", "logistic", {"C": 1.0})
    only = fitted(spark, df, spec, positions=[1, 4])["m"][0]
    assert set(np.flatnonzero(only)) == {1, 4}
    part = df.withColumn("x", F.array(F.col("x")[1], F.col("x")[4]))
    np.testing.assert_allclose(fitted(spark, part, spec)["m"][0], only[[1, 4]], atol=1e-9)
    twice = df.withColumn("multiplicity", F.when(F.col("sample_id") < "050", 2).otherwise(1))
    copies = df.unionByName(df.where(F.col("sample_id") < "050"))
    np.testing.assert_allclose(fitted(spark, twice, spec)["m"][0], fitted(spark, copies, spec)["m"][0], atol=1e-8)
    assert fitted(spark, df, ("m", "l1_svm", {"lam": 0.05, "fit_intercept": False}))["m"][1] == 0.0


def test_scores_and_predictions_agree(spark, data):
    x, y, df = data
    fits = fit_linear(df, models(spark, ("log", "logistic", {"C": 1.0})), ["ds"])
    counts = score_models(df, fits, ["ds"]).first()
    pred = score_models(df, fits, ["ds"], counts=False).collect()
    assert len(pred) == N and sum(r.y == 1 and r.pred == 1 for r in pred) == counts.tp
    assert counts.tp + counts.fp + counts.fn + counts.tn == N


def wide_rows(spark, n, p, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = (x[:, :20] @ rng.normal(size=20) + rng.normal(size=n) > 0).astype(int)
    rows = [("d", f"{i:04d}", "train", int(y[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "ds string, sample_id string, role string, y int, x array<double>").cache()


def placed(spark, *sets):
    """One model for each (name, kind, number of leading features, options)."""
    out = None
    for name, kind, p, options in sets:
        row = spark.range(1).select(
            F.lit("d").alias("ds"), F.lit(name).alias("model"), F.sequence(F.lit(0), F.lit(p - 1)).alias("positions"), *model_spec(kind, **options)
        )
        out = row if out is None else out.unionByName(row)
    return out


@pytest.mark.parametrize("kind", ["svc", "logistic"])
def test_any_width_converges_and_ignores_its_neighbours(spark, kind):
    df = wide_rows(spark, 200, 1000)
    sets = [(str(p), kind, p, {"C": 0.5}) for p in (50, 200, 256, 257, 1000)]
    together = {r.model: r for r in fit_linear(df, placed(spark, *sets), ["ds"]).collect()}
    assert all(r.converged for r in together.values())
    for one in (sets[0], sets[3]):
        alone = fit_linear(df, placed(spark, one), ["ds"]).first()
        np.testing.assert_allclose(alone.coef, together[one[0]].coef, atol=1e-6)


def test_both_ways_of_a_newton_system_agree(spark, monkeypatch):
    from peaklake.operators import descent

    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=(90, 40)), np.ones(90)])
    y = np.where(x[:, :3].sum(axis=1) + rng.normal(size=90) > 0, 1.0, -1.0)
    problem = descent.Problem("hinge", np.zeros(2), np.array([0.05, 0.5]), np.ones((2, 41)), 1e-7, 200)
    evaluate = lambda w, which, delta, curvature, along=None: descent.batch_sums(
        x, y, np.full(90, 1 / 90), w, "hinge", delta, curvature, along
    )
    direct = descent.solve(problem, evaluate)
    monkeypatch.setattr(descent, "DIRECT_FEATURES", 0)
    free = descent.solve(problem, evaluate)
    assert direct.converged.all() and free.converged.all()
    np.testing.assert_allclose(direct.weights, free.weights, atol=1e-6)


def test_large_keys_at_default_tolerance(spark):
    df = wide_rows(spark, 60, 300)
    specs = placed(spark, ("log", "logistic", 300, {"C": 0.05}))
    here = fit_linear(df, specs, ["ds"]).first()
    there = fit_linear(df.coalesce(2), specs, ["ds"], max_local_values=1).first()
    assert here.converged and there.converged
    np.testing.assert_allclose(here.coef, there.coef, atol=1e-7)


def test_large_keys_take_the_steps_they_are_given(spark):
    df = wide_rows(spark, 40, 30)
    specs = placed(spark, ("svm", "l1_svm", 30, {"lam": 0.01, "accelerate": False, "tol": 1e-12, "max_iter": 520}))
    here = fit_linear(df, specs, ["ds"]).first()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    there = fit_linear(df.coalesce(1), specs, ["ds"], max_local_values=1).first()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert here.n_steps == there.n_steps == 520
    np.testing.assert_allclose(here.coef, there.coef, atol=1e-9)
