"""Counting neighbours by class in balls: verdicts against all distances, and the same rows in danger with fewer of them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklake.operators import balls
from peaklake.operators.boxes import gap_distances
from peaklake.operators.neighbors import _in_danger, borderline_smote, danger_and_kin, nearest_rows


def others_nearest(x, y, m):
    """How many of the m nearest other rows are of the other class, ties by number."""
    dist = np.round(((x[:, None] - x) ** 2).sum(axis=2), 9)
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1, kind="stable")[:, :m]
    return (y[near] != y[:, None]).sum(axis=1)


@pytest.mark.parametrize("seed", range(6))
def test_verdicts_agree_with_all_distances(seed):
    rng = np.random.default_rng(seed)
    n, groups = 400, 8
    x = rng.normal(size=(groups, 4))[np.arange(n) % groups] * (1 + 4 * seed) + rng.normal(size=(n, 4))
    y = ((np.arange(n) % groups < 3) ^ (rng.random(n) < 0.03 * (5 - seed))).astype(int)
    x[:20] = x[0]  # rows alike
    pivots = x[rng.permutation(n)[:30]]
    apart = np.sqrt(gap_distances(pivots)(x) * 4)
    cell = apart.argmin(axis=1)
    cells = np.unique(cell)
    parts = [np.array([f(cell == c) for c in cells]) for f in (lambda s: apart[s].min(axis=1).max(), lambda s: s.sum(), lambda s: y[s].sum())]
    found = balls.settle(x, y, pivots, cells, *parts, 8)
    c = others_nearest(x, y, 8)
    danger = (2 * c >= 8) & (c < 8)
    assert danger[found == balls.DANGER].all() and not danger[found == balls.SAFE].any()
    if seed == 5:
        assert (found == balls.OPEN).mean() < 0.2


def table(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    centre = 30 * rng.normal(size=(10, 5))
    x = centre[np.arange(n) % 10] + rng.normal(size=(n, 5))
    y = (np.arange(n) % 10 < 3).astype(int)
    y[np.arange(n) % 10 == 9] = rng.random((np.arange(n) % 10 == 9).sum()) < 0.4  # one mixed cluster
    rows = [(key, f"{i:04d}", int(y[i]), x[i].tolist()) for key, part in (("big", n), ("few", 30)) for i in range(part)]
    return x, y, spark.createDataFrame(rows, "pair string, row_id string, y int, x array<double>")


def test_same_rows_in_danger_with_fewer_searches(spark, workspace):
    x, y, df = table(spark)
    minority, searched = df.where("y = 1"), []

    def stage(frame, name):
        out = workspace.stage(frame, name)
        if name == "smote-verdicts":
            searched.append(out.where(F.col("verdict") == balls.OPEN).count())
        return out

    danger, kin = danger_and_kin(minority, df, ["pair"], 4, 6, 60, stage)
    got = sorted(map(tuple, danger.select("pair", "row_id").collect()))
    assert got == sorted(map(tuple, _in_danger(nearest_rows(minority, df, ["pair"], 6), ["pair"], 6).collect()))
    c = others_nearest(x, y, 6)
    want = [f"{i:04d}" for i in np.flatnonzero((y == 1) & (2 * c >= 6) & (c < 6))]
    assert [r for p, r in got if p == "big"] == want and want
    assert searched and searched[0] < 0.5 * y.sum()
    listed = {(r.pair, r.row_id, r._k): r.kin_id for r in kin.collect()}
    whole = {(r.pair, r.row_id, r["rank"]): r.donor_id for r in nearest_rows(minority, df, ["pair"], 6, 4).where("kind = 'kin'").collect()}
    for pair, row in got:
        assert [listed[pair, row, k] for k in range(1, 5)] == [whole[pair, row, k] for k in range(1, 5)]


def test_synthetic_rows_do_not_depend_on_the_way(spark, workspace):
    _, _, df = table(spark, 400)
    one, many = (borderline_smote(df, ["pair"], 4, 6, block_rows=b, stage=workspace.stage).collect() for b in (10_000, 50))
    assert sorted((r.pair, r.row_id, *np.round(r.x, 9)) for r in one) == sorted((r.pair, r.row_id, *np.round(r.x, 9)) for r in many) and one
