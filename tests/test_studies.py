"""Whole studies on a small made study with a known signal."""

from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklake.config import (
    BootstrapFinal, BootstrapSelection, MissingnessFilter, Preprocess, Resampling, SparseModel, Study, UnionFinal,
    UnionSelection,
)
from peaklake.operators.matrix import Matrix
from peaklake.operators.solver import model_spec
from peaklake.plans import bootstrap as B
from peaklake.plans import union as U
from peaklake.plans.dataset import prepare
from peaklake.plans.evaluate import cross_validate, fit_sets, folds_only, full_only
from peaklake.sources.results import read_selected_features
from peaklake.sources.star import Star, write_star_schema

PAIRS = (("control", "activated"), ("control", "incident"))
SIGNAL = {"activated": (1, 2), "incident": (3,)}


def make_star(spark, seed=0):
    rng = np.random.default_rng(seed)
    samples, cells = [], []
    for c, n in (("control", 40), ("activated", 30), ("incident", 30)):
        for i in range(n):
            sid = f"{c[:2]}{i:03d}"
            samples.append((sid, c, "+", 300.0, i % 5 == 0))
            for f in range(1, 9):
                if rng.random() < 0.1:
                    continue
                shift = 2.5 if f in SIGNAL.get(c, ()) else 0.0
                cells.append((sid, f, float(np.exp2(10 + rng.normal() + shift)) * 300.0 * 50.0))
            cells.append((sid, 9, 50.0))
    return Star(
        spark.createDataFrame(samples, "sample_id string, condition string, symptomatic string, mean_osmolality double, test_split boolean"),
        spark.createDataFrame([(f, f == 9) for f in range(1, 10)], "feature_id bigint, internal boolean"),
        spark.createDataFrame(cells, "sample_id string, feature_id bigint, area double"),
    )


@pytest.fixture(scope="module")
def star(spark):
    made = make_star(spark)
    return Star(*[t.cache() for t in made])


STUDY = Study("", PAIRS, preprocess=Preprocess(internal_standard_id=9), n_folds=3)
FILTER = MissingnessFilter(0.2)


def bacc(y, pred):
    return np.mean([(pred[y == c] == c).mean() for c in (0, 1)])


def test_cross_validation_equals_scoring_by_hand(spark, star, workspace):
    matrix = prepare(star, STUDY, FILTER, False, workspace.stage)
    sets = full_only(matrix).positions().where("feature_id <= 4").select("pair", F.lit("s").alias("set_id"), "feature_id")
    fits, _, means = cross_validate(
        folds_only(matrix), full_only(matrix).axis, sets, "logistic", (0.1, 1.0), Resampling(), 42, 3, workspace.stage
    )
    rows = matrix.rows.toPandas()
    by_hand = {}
    for f in fits.collect():
        part = rows[(rows["pair"] == f.pair) & (rows["view"] == f.view)]
        x, y = np.vstack(part["x"]), part["y"].to_numpy()
        assert np.count_nonzero(f.coef) == f.n_features == 4
        val = (part["role"] == "val").to_numpy()
        tr = ~val
        # Standardised on the train rows of the fold alone.
        np.testing.assert_allclose(x[tr].mean(axis=0), 0, atol=1e-9)
        pred = (x @ np.array(f.coef) + f.intercept >= 0).astype(int)
        by_hand.setdefault((f.pair, f.C), []).append((bacc(y[tr], pred[tr]), bacc(y[val], pred[val])))
    for r in means.collect():
        train, val = np.mean(by_hand[r.pair, r.C], axis=0)
        assert (r.train_score, r.val_score) == pytest.approx((train, val))
        assert len(by_hand[r.pair, r.C]) == 3


def test_validation_values_do_not_leak(spark, star, workspace):
    base = prepare(star, STUDY, None, True, workspace.stage)
    noisy = star.abundances.join(star.samples.where("test_split").select("sample_id", F.lit(True).alias("t")), "sample_id", "left")
    noisy = noisy.withColumn("area", F.when(F.col("t"), F.col("area") * 7 + 1).otherwise(F.col("area"))).drop("t")
    other = prepare(star._replace(abundances=noisy), STUDY, None, True, workspace.stage)
    keys = ["pair", "view", "role", "sample_id"]
    train = lambda m: {tuple(r[k] for k in keys): r.x for r in m.rows.where("role = 'train'").collect()}
    a, b = train(base), train(other)
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_fits_are_the_same_with_shuffled_input(spark, star, workspace):
    shuffled = star._replace(abundances=star.abundances.repartition(7).orderBy(F.rand(1)))
    a = prepare(star, STUDY, FILTER, False, workspace.stage).rows.collect()
    b = prepare(shuffled, STUDY, FILTER, False, workspace.stage).rows.collect()
    side = lambda rows: {(r.pair, r.view, r.sample_id): r for r in rows}
    a, b = side(a), side(b)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].role == b[k].role
        np.testing.assert_allclose(a[k].x, b[k].x, atol=1e-9)


def selection(**changes):
    config = UnionSelection(STUDY, SparseModel("l1_svm", lam=0.25), FILTER, Resampling(True, smote=True, smote_k=3, smote_m=6),
                            threshold=0.75, max_iterations=4)
    return dataclasses.replace(config, **changes)


def test_union_selection_finds_the_signal_and_stops(spark, star, workspace):
    selected, curve = U.union_selection(star, selection(), workspace.stage)
    found, heaviest = {}, {}
    for r in selected.orderBy(F.abs("weight")).collect():
        found.setdefault((r.compared_conditions, r.iteration), set()).add(r.feature_id)
        heaviest[r.compared_conditions, r.iteration] = r.feature_id
    assert heaviest["control_vs_activated", 1] in SIGNAL["activated"]
    assert heaviest["control_vs_incident", 1] in SIGNAL["incident"]
    scores = {(r.compared_conditions, r.iteration): r.balanced_accuracy for r in curve.collect()}
    # A failing iteration is in the curve, not in the selection.
    for pair in ("control_vs_activated", "control_vs_incident"):
        last = max(i for p, i in scores if p == pair)
        passed = [i for p, i in found if p == pair]
        assert all(scores[pair, i] >= 0.75 for i in passed) and last <= max(passed) + 1
        seen = [f for (p, i), fs in found.items() if p == pair for f in fs]
        assert len(seen) == len(set(seen))  # a feature is selected once


def test_union_study_writes_and_reads(spark, star, tmp_path):
    db, out = str(tmp_path / "db"), str(tmp_path / "out")
    write_star_schema(star, db)
    study = dataclasses.replace(STUDY, db_root=db, out_dir=out, run_id="r1")
    chosen = U.run_union_feature_selection(spark, selection(study=study, resampling=Resampling()))
    final = UnionFinal(study, "svc", missingness=FILTER)
    results = U.run_final_classifiers(spark, final, f"{out}/selected_features_union_csv/run_id=r1").collect()
    pair = [r for r in results if r.condition_pair == "control_vs_activated"]
    names = [r.model for r in pair]
    n_iterations = chosen.where("compared_conditions = 'control_vs_activated'").select("iteration").distinct().count()
    assert names == [f"iteration {i}" for i in range(1, n_iterations + 1)] + ["union", "ensemble"]
    assert pair[-1].n_features == pair[-2].n_features and pair[-1].best_C is None
    assert all(r.test_bacc > 0.7 for r in pair) and pair[0].best_C in final.C_grid
    assert spark.read.json(f"{out}/config_UnionFinal").first().run_id is not None
    assert read_selected_features(spark, f"{out}/selected_features_union_csv/run_id=r1").count() == chosen.count()


def test_unusable_sets_give_empty_rows(spark, star, workspace):
    selected = spark.createDataFrame(
        [("control_vs_incident", 777, 1), ("control_vs_incident", 3, 2)], "compared_conditions string, feature_id bigint, iteration int"
    )
    final = UnionFinal(STUDY, "logistic", C_grid=(1.0,), missingness=FILTER)
    rows = {r.model: r for r in U.final_classifiers(star, selected, final, workspace.stage).collect()}
    assert rows["iteration 1"].n_features == 0 and rows["iteration 1"].test_bacc is None and rows["iteration 1"].best_C is None
    # The only voter decides the vote.
    assert rows["ensemble"].test_bacc == rows["iteration 2"].test_bacc == rows["union"].test_bacc


def test_bootstrap_study(spark, star, workspace):
    config = BootstrapSelection(STUDY, SparseModel("elastic_net", C=0.1), FILTER, replicates=6)
    selected, grid = B.stability_selection(star, config, workspace.stage)
    counts = {(r.condition_pair, r.feature_id): r.n_selections for r in selected.collect()}
    assert min(counts["control_vs_activated", 1], counts["control_vs_incident", 3]) > 3  # more than half
    most = {p: max(n for (q, _), n in counts.items() if q == p) for p, _ in counts}
    best = {r.condition_pair: r.min_selections for r in grid.groupBy("condition_pair").agg(F.max("min_selections").alias("min_selections")).collect()}
    assert best == most and max(most.values()) <= 6
    final = B.final_classification(star, selected, BootstrapFinal(STUDY, "logistic", (0.1, 1.0)), workspace.stage).collect()
    assert [(r.condition_pair, r.min_selections) for r in final] == [(p, k) for p in sorted(best) for k in range(1, best[p] + 1)]
    assert all(r.test_bacc > 0.7 and r.mean_val_bacc > 0.7 for r in final)
    bare = B.final_classification(star, selected, BootstrapFinal(STUDY, "logistic", (1.0,), fit_final=False), workspace.stage)
    assert all(r.test_bacc is None and r.mean_val_bacc is not None for r in bare.collect())


def test_settings_are_named_and_checked():
    with pytest.raises(TypeError):
        BootstrapFinal(STUDY, "logistic", (1.0,), False)
    for wrong in ({"max_iter": False}, {"max_iter": 0}, {"max_iter": 2.5}, {"tol": 0.0}, {"tol": True}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            BootstrapFinal(STUDY, **wrong)
        with pytest.raises(ValueError, match=next(iter(wrong))):
            model_spec("svc", **wrong)


def test_set_without_a_feature_scores_zero(spark, star, workspace):
    matrix = folds_only(prepare(star, STUDY, FILTER, False, workspace.stage))
    axis = matrix.axis.select("pair", "feature_ids").distinct()
    sets = spark.createDataFrame([("control_vs_incident", "none", 777), ("control_vs_incident", "one", 3)], "pair string, set_id string, feature_id bigint")
    _, _, means = cross_validate(matrix, axis, sets, "logistic", (0.1, 1.0), Resampling(), 42, 3, workspace.stage)
    got = {(r.set_id, r.C): (r.train_score, r.val_score) for r in means.collect()}
    assert got["none", 0.1] == got["none", 1.0] == (0.0, 0.0) and got["one", 1.0][1] > 0.5


def test_sets_with_synthetic_rows_are_fitted_on_their_own_rows(spark, star, workspace):
    matrix = full_only(prepare(star, STUDY, FILTER, False, workspace.stage))
    sets = matrix.positions().where("feature_id <= 2").select(
        "pair", F.concat(F.lit("f"), F.col("feature_id")).alias("set_id"), "feature_id"
    )
    fits = fit_sets(
        matrix, sets, model_spec("logistic", C=F.col("C")), Resampling(smote=True, smote_k=3, smote_m=6), 42, workspace.stage, (1.0,)
    ).collect()
    assert len(fits) == 4
    for f in fits:
        axis = {r.pos for r in matrix.positions().where(f"feature_id = {f.set_id[1:]}").where(F.col("pair") == f.pair).collect()}
        assert set(np.flatnonzero(f.coef)) == axis
    assert isinstance(matrix, Matrix)
