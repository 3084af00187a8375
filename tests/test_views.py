"""One neighbour search for all views of a sample gives each view its own neighbours."""

from __future__ import annotations

import numpy as np
import pytest

from peaklake.operators import neighbors as N
from peaklake.operators import views as V
from peaklake.operators.matrix import Matrix

P, FOLDS, K = 6, 3, 4


def brute(q: np.ndarray, d: np.ndarray, pos: int, trained: np.ndarray) -> list[tuple[int, float]]:
    """The K nearest trained donors that have the feature, by (rounded distance, place)."""
    found = []
    for j in np.flatnonzero(trained & ~np.isnan(d[:, pos])):
        both = ~np.isnan(q) & ~np.isnan(d[j])
        if both.any():
            found.append((round(P / both.sum() * ((q - d[j])[both] ** 2).sum(), N.DISTANCE_DIGITS), j))
    return [(j, far) for far, j in sorted(found)[:K]]


def made(rng, n: int, shift: float):
    """(values of the first view with gaps, changed features, what the views have there, which donors each view may take)."""
    base = rng.normal(size=(n, P)).round(1)  # rounded, so that some distances are equal
    base[rng.random((n, P)) < 0.25] = np.nan
    changed = [(1, 0), (1, 3), (3, 5)]
    moved = np.stack([base[:, c] + shift * rng.random(n) ** 8 for _, c in changed], axis=1)
    fold = rng.integers(0, FOLDS, n)
    trained = np.stack([np.ones(n, bool), *[fold != f for f in range(FOLDS)]])
    return np.hstack([base, moved]), changed, trained


@pytest.mark.parametrize("shift", [0.01, 0.5, 50.0])
def test_every_view_gets_its_own_neighbours(shift, monkeypatch):
    monkeypatch.setattr(V, "APART", 5)
    packed, changed, trained = made(np.random.default_rng(3), 400, shift)
    side = V.Side(packed, changed)
    asks = np.ones((FOLDS + 1, len(packed)), bool)
    got = {}
    for v, pos, row, place, dist in V.ViewSearch(side, trained, K).run(side, asks):
        for p, r, j, far in zip(np.broadcast_to(pos, row.shape), row, place, dist):
            got.setdefault((v, r, p), []).append((j, round(far, N.DISTANCE_DIGITS)))
    for v in range(FOLDS + 1):
        values = side.rows(v)
        for r in range(0, len(values), 7):
            for pos in np.flatnonzero(np.isnan(values[r])):
                want = brute(values[r], values, pos, trained[v])
                have = got.get((v, r, pos), [])
                assert [j for j, _ in have] == [j for j, _ in want]
                np.testing.assert_allclose([far for _, far in have], [far for _, far in want], atol=1e-8)


def view_rows(rng, n: int, repeat: bool = False, lacking: bool = False):
    packed, changed, trained = made(rng, n, 0.3)
    side, rows = V.Side(packed, changed), []
    plain = lambda x: [None if np.isnan(e) else float(e) for e in x]
    for v in range(FOLDS + 1):
        values = side.rows(v)
        for i in range(n):
            name = f"{(i // 2 if repeat else i):04d}"
            x = plain(values[i])
            if lacking and v == 2 and i == 5:
                x = [1.0] * P  # no gaps in this view alone
            rows.append(("a" if i % 2 else "b", v - 1, "train" if trained[v, i] else "val", name, x))
    return rows


@pytest.mark.parametrize("odd", [{}, {"repeat": True}, {"lacking": True}])
def test_views_are_filled_as_if_searched_one_by_one(spark, workspace, odd):
    rows = view_rows(np.random.default_rng(5), 240, **odd)
    df = workspace.stage(spark.createDataFrame(rows, "pair string, view int, role string, sample_id string, x array<double>"), "rows")
    axis = df.select("pair", "view").distinct().selectExpr("pair", "view", f"sequence(1L, {P}L) AS feature_ids")
    keys = ["pair", "view"]
    matrix = Matrix(df, axis, tuple(keys))
    got = V.gap_fills(matrix, K, None, workspace.stage, views=True)
    near = N.gap_donors(df.where("exists(x, v -> v IS NULL)"), df.where("role = 'train'"), keys, K, None, workspace.stage)
    want = N.merged_fills(near, keys, K)
    as_rows = lambda d: sorted((r["pair"], r["view"], r["sample_id"], tuple((f["pos"], round(f["value"], 9)) for f in r["_fills"])) for r in d.collect())
    assert as_rows(got) == as_rows(want)
    plain = V.gap_fills(matrix, K, None, workspace.stage)
    assert as_rows(plain) == as_rows(want)


def test_samples_meet_once_for_all_views(spark, workspace, monkeypatch):
    """The search sees a sample once, not once for every view."""
    rows = view_rows(np.random.default_rng(7), 120)
    df = workspace.stage(spark.createDataFrame(rows, "pair string, view int, role string, sample_id string, x array<double>"), "rows")
    axis = df.select("pair", "view").distinct().selectExpr("pair", "view", f"sequence(1L, {P}L) AS feature_ids")
    seen = []
    sizes = N._sizes
    for module in (N, V):
        monkeypatch.setattr(module, "_sizes", lambda q, d, keys, rows: seen.append((q.count(), d.count())) or sizes(q, d, keys, rows))
    N.knn_impute(Matrix(df, axis, ("pair", "view")), K, stage=workspace.stage, views=True).rows.count()
    assert seen == [(df.where("exists(x, v -> v IS NULL)").select("pair", "sample_id").distinct().count(), 120)]


def test_few_groups_of_rows_get_partitions_of_their_own(spark, workspace, monkeypatch):
    """48 groups in 8 partitions left the largest with 1.6 times the average."""
    found, parts = [], []
    met = N._Search._met
    monkeypatch.setattr(N._Search, "_met", lambda self, q, d: found.append(self.groups) or met(self, q, d))
    cogroup = N.cogroup_apply
    monkeypatch.setattr(N, "cogroup_apply", lambda q, *more: parts.append(q.rdd.getNumPartitions()) or cogroup(q, *more))
    rng = np.random.default_rng(2)
    rows = [(f"{i % 5}", f"{i:05d}", int(rng.random() < 0.5), rng.normal(size=3).tolist()) for i in range(100)]
    df = workspace.stage(spark.createDataFrame(rows, "pair string, row_id string, y int, x array<double>"), "rows")
    assert N.nearest_rows(df, df, ["pair"], 2, stage=workspace.stage).count() == 200
    assert found == [5] and parts == [10]
