"""Replicates as columns of multiplicities: the same fits as from rows of their own, in one task and by jobs."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklake.config import BootstrapSelection, SparseModel
from peaklake.operators.metrics import selection_counts
from peaklake.operators.sampling import bootstrap_draws
from peaklake.operators.solver import fit_linear, model_spec, weights_table
from peaklake.plans import bootstrap as B
from peaklake.plans.dataset import prepare
from peaklake.plans.evaluate import full_only
from peaklake.plans.union import sparse_spec
from peaklake.workspace import Workspace
from tests.test_studies import FILTER, STUDY, make_star

SPECS = {
    "elastic_net": dict(C=0.3, l1_ratio=0.8, tol=1e-9), "l1_svm": dict(lam=0.02, tol=1e-9), "plain": dict(lam=0.02, tol=1e-5, accelerate=False),
    "logistic": dict(C=1.0), "svc": dict(C=1.0),
}


@pytest.mark.parametrize(("kind", "values"), [*[(k, 10**6) for k in SPECS], ("logistic", 1)])
def test_draws_equal_rows_of_their_own(spark, workspace, kind, values):
    rng = np.random.default_rng(4)
    n, draws = 40, 3
    x = rng.normal(size=(n, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)
    m = rng.integers(0, 3, (n, draws))
    m[7] = [0, 0, 5]
    x[7] *= 20  # the longest row, in one draw only
    spec = model_spec("l1_svm" if kind == "plain" else kind, **SPECS[kind])
    together = spark.createDataFrame([("k", int(y[i]), m[i].tolist(), x[i].tolist()) for i in range(n)], "key string, y int, multiplicity array<int>, x array<double>")
    alone = spark.createDataFrame([(d, int(y[i]), int(m[i, d]), x[i].tolist()) for i in range(n) for d in range(draws) if m[i, d]], "key int, y int, multiplicity int, x array<double>")
    one = spark.range(draws).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("model"), F.col("id").cast("int").alias("draw"), F.lit(None).cast("array<int>").alias("positions"), *spec)
    own = spark.range(draws).select(F.col("id").cast("int").alias("key"), F.lit("m").alias("model"), F.lit(None).cast("array<int>").alias("positions"), *spec)
    got = {int(r.model): r for r in fit_linear(workspace.stage(together, "t"), one, ["key"], values).collect()}
    want = {r.key: r for r in fit_linear(workspace.stage(alone, "a"), own, ["key"], values).collect()}
    for d in range(draws):
        np.testing.assert_allclose([*got[d].coef, got[d].intercept], [*want[d].coef, want[d].intercept], atol=2e-5)
        assert got[d].converged == want[d].converged


def test_draws_and_models_must_agree(spark):
    rows = spark.createDataFrame([(1, 0, [1.0])], "key int, y int, x array<double>")
    models = spark.range(1).select(F.lit(1).alias("key"), F.lit("m").alias("model"), F.lit(0).alias("draw"), F.lit(None).cast("array<int>").alias("positions"), *model_spec("svc"))
    with pytest.raises(ValueError, match="draw"):
        fit_linear(rows, models, ["key"])


def test_same_selections_and_rows_stored_once(spark):
    star = make_star(spark)
    config = BootstrapSelection(STUDY, SparseModel("elastic_net", C=0.1), FILTER, replicates=8)
    work = Workspace(spark, "draws")
    full = full_only(prepare(star, STUDY, FILTER, False, work.stage))
    fits = B.fit_replicates(full, config, work.stage)
    axis = full.axis.select("pair", "feature_ids")
    got = sorted(map(tuple, selection_counts(weights_table(fits, axis, ["pair"]), ["pair"], 1e-6).collect()))
    train = full.rows.where("role = 'train'")
    drawn = bootstrap_draws(train.select("pair", "sample_id", "y"), ["pair"], 8, STUDY.seed)
    rows = work.stage(drawn.join(train.select("pair", "sample_id", "x"), ["pair", "sample_id"]), "copies")
    models = rows.select("pair", "replicate").distinct().select("pair", "replicate", F.lit("sparse").alias("model"), F.lit(None).cast("array<int>").alias("positions"), *sparse_spec(config.model))
    each = fit_linear(rows, models, ["pair", "replicate"])
    want = sorted(map(tuple, selection_counts(weights_table(each, axis, ["pair"]), ["pair"], 1e-6).collect()))
    assert got == want
    folder = work.path.removeprefix("file:")
    stored = [f for f in os.listdir(folder) if f.endswith("drawn-rows")]
    assert len(stored) == 1 and spark.read.parquet(f"{work.path}/{stored[0]}").count() <= train.count()
