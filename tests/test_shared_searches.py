"""Searches and fits that several keys share: the draws of a bootstrap, and sets of the same features."""

from __future__ import annotations

import numpy as np

from peaklake.config import Resampling
from peaklake.operators import neighbors as N
from peaklake.operators.matrix import Matrix
from peaklake.operators.solver import model_spec
from peaklake.plans import evaluate
from peaklake.workspace import Workspace
from pyspark.sql import functions as F


def made_rows(n: int, p: int = 3, seed: int = 1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, p)), 1)
    x[n // 2] = x[0]  # equal rows tie
    return [("a", f"{i:03d}", int(i % 5 < 2), [float(v) for v in row]) for i, row in enumerate(x)]


def copies_of(rows, draws: int, seed: int = 2):
    rng = np.random.default_rng(seed)
    out = []
    for r in range(draws):
        times = np.bincount(rng.integers(0, len(rows), len(rows)), minlength=len(rows))
        out += [(pair, r, f"{i}#{c + 1}", y, x) for (pair, i, y, x), n in zip(rows, times) for c in range(n)]
    return out


COPIES = "pair string, replicate int, row_id string, y int, x array<double>"


def test_draws_share_one_list_of_neighbours(spark, tmp_path, monkeypatch):
    rows = made_rows(60)
    base = spark.createDataFrame(rows, "pair string, row_id string, y int, x array<double>")
    copies = spark.createDataFrame(copies_of(rows, 4), COPIES)
    stage = Workspace(spark, "shared").stage
    keys = ["pair", "replicate"]
    read = lambda df: sorted((r.replicate, r.row_id, r.y, tuple(round(v, 9) for v in r.x)) for r in df.collect())
    blocks = read(N.borderline_smote(copies, keys, 3, 6, block_rows=16, stage=stage))
    plain = read(N.borderline_smote(copies, keys, 3, 6, stage=stage))
    shared = read(N.borderline_smote(copies, keys, 3, 6, stage=stage, drawn=base))
    assert blocks and plain == blocks and shared == blocks
    monkeypatch.setattr(N, "DRAWN_LISTS", (1, 0))  # too short for some: these are sought among the copies
    assert read(N.borderline_smote(copies, keys, 3, 6, stage=stage, drawn=base)) == blocks
    monkeypatch.setattr(N, "DRAWN_VALUES", 1)  # too large for a task
    assert read(N.borderline_smote(copies, keys, 3, 6, stage=stage, drawn=base)) == blocks


def test_repeated_rows_are_told_from_whole_lists(spark):
    rows = [(pair, 0, i, y, x) for pair, i, y, x in made_rows(60)]
    copies = spark.createDataFrame(rows + rows[:7], COPIES)
    stage = Workspace(spark, "shared").stage
    read = lambda df: sorted((r.row_id, tuple(round(v, 9) for v in r.x)) for r in df.collect())
    keys = ["pair", "replicate"]
    assert read(N.borderline_smote(copies, keys, 3, 6, stage=stage)) == read(N.borderline_smote(copies, keys, 3, 6, block_rows=200_000, stage=stage))


def test_sets_of_the_same_features_are_searched_and_fitted_once(spark, monkeypatch):
    rows = [(pair, -1, "train", i, y, x) for pair, i, y, x in made_rows(60)]
    keyed = spark.createDataFrame(rows, "pair string, view int, role string, sample_id string, y int, x array<double>")
    axis = spark.createDataFrame([("a", -1, [1, 2, 3])], "pair string, view int, feature_ids array<bigint>")
    matrix = Matrix(keyed, axis, ("pair", "view"))
    sets = [("a", s, f) for s, fs in (("one", (1, 2)), ("two", (1, 2)), ("all", (1, 2, 3))) for f in fs]
    sets = spark.createDataFrame(sets, "pair string, set_id string, feature_id bigint")
    spec = model_spec("logistic", C=F.col("C"))
    stage = Workspace(spark, "shared").stage
    fitted, searched = [], []
    fit, search = evaluate.fit_linear, N.danger_and_kin
    monkeypatch.setattr(evaluate, "fit_linear", lambda r, models, *a: fitted.append(models.count()) or fit(r, models, *a))
    monkeypatch.setattr(N, "danger_and_kin", lambda m, r, *a: searched.append(r.select("set_id").distinct().count()) or search(m, r, *a))
    found = {(r.set_id, r.C): r for r in evaluate.fit_sets(matrix, sets, spec, Resampling(), 42, stage, (0.1, 1.0)).collect()}
    assert fitted == [4] and len(found) == 6
    assert found["one", 1.0].coef == found["two", 1.0].coef != found["all", 1.0].coef
    assert found["two", 0.1].n_features == 2 and found["two", 0.1].model == "two|0.1"
    balance = Resampling(smote=True, smote_k=3, smote_m=6)
    apart = evaluate.fit_sets(matrix, sets.where("set_id = 'two'"), spec, balance, 42, stage).first()
    both = {r.set_id: r for r in evaluate.fit_sets(matrix, sets, spec, balance, 42, stage).collect()}
    assert searched == [1, 2] and len(both) == 3  # the draws of a set stay its own
    assert np.allclose(both["two"].coef, apart.coef) and both["one"].coef != both["two"].coef


def test_lists_of_draws_against_all_copies():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 2)), np.arange(40) % 2
    times = rng.poisson(1.0, 40)
    own = np.flatnonzero(times > 0)
    _, place = N.Tiles(x).nearest(x[own], 24)
    others, known = N.walk(own, y[own], times[own], place, y, times, 5)
    assert known.all()
    for i, got in zip(own, others):
        every = np.repeat(np.arange(40), times)
        every = np.delete(every, np.flatnonzero(every == i)[0])
        near = every[np.argsort(((x[every] - x[i]) ** 2).sum(axis=1), kind="stable")][:5]
        assert got == (y[near] != y[i]).sum()


def test_few_copies_of_many_rows_are_shuffled(spark):
    rows = spark.range(287_000).select(F.lit("a").alias("pair"), F.array_repeat(F.lit(0.0), 24).alias("x"))
    size = N._sizes(rows, rows, ["pair"], None).first()
    assert size._dgroups + size._qleast <= 4


def test_complete_rows_are_screened_without_masks():
    x = np.random.default_rng(6).normal(size=(6_000, 5))
    tiles = N.Tiles(x)
    dist, place = tiles.nearest(x[:50], 4)
    room = tiles.room[0]
    tiles.nearest(x[50:100], 4)
    assert tiles.sides[True].shape[0] == 7 and tiles.room[0] is room and list(tiles.sides) == [True]
    brute = ((x[:50, None] - x[None]) ** 2).sum(axis=2)
    assert (place == np.argsort(brute, axis=1, kind="stable")[:, :4]).all() and np.allclose(dist, np.sort(brute, axis=1)[:, :4])
