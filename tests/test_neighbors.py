"""Neighbour search and oversampling against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklake.operators.matrix import Matrix
from peaklake.operators.neighbors import borderline_smote, knn_impute, nearest_rows, smallest


def gapped(seed=0, n=60, p=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[rng.random((n, p)) < 0.25] = np.nan
    x[:3] = np.nan
    x[0, 0], x[1, 1] = 1.0, 2.0  # rows with one value only; row 2 has none
    x[:, p - 1] = np.nan
    x[5, p - 1] = 3.0  # a feature with a single donor
    return x


def brute(x, train, k):
    p, out = x.shape[1], x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        cand = []
        for t in np.flatnonzero(train):
            both = ~np.isnan(x[i]) & ~np.isnan(x[t])
            if np.isnan(x[t, j]) or not both.any():
                continue
            cand.append((round(p / both.sum() * ((x[i, both] - x[t, both]) ** 2).sum(), 9), t))
        near = sorted(cand)[:k]
        out[i, j] = np.mean([x[t, j] for _, t in near]) if near else np.nanmean(x[train, j])
    return out


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_knn_impute_equals_brute_force(spark, block_rows):
    x = gapped()
    train = np.arange(len(x)) % 4 != 3
    rows = [("p", f"{i:03d}", "train" if train[i] else "val", [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "pair string, sample_id string, role string, x array<double>")
    axis = spark.createDataFrame([("p", list(range(7)))], "pair string, feature_ids array<bigint>")
    out = knn_impute(Matrix(df, axis, ("pair",)), 4, block_rows).rows.orderBy("sample_id").collect()
    np.testing.assert_allclose(np.array([r.x for r in out]), brute(x, train, 4), atol=1e-9)


def test_ties_go_to_the_earlier_column():
    dist = np.array([[1.0, 0.5, 1.0, 1.0, np.inf], [np.inf] * 5])
    row, col = smallest(dist, 2)
    assert list(row) == [0, 0] and sorted(col) == [0, 1]


def clusters(spark, n_min=12, n_maj=40):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0.6, 1.0, size=(n_min, 3)), rng.normal(-0.6, 1.0, size=(n_maj, 3))])
    rows = [("p", f"{i:03d}", int(i < n_min), x[i].tolist()) for i in range(len(x))]
    return x, spark.createDataFrame(rows, "pair string, row_id string, y int, x array<double>")


@pytest.mark.parametrize("block_rows", [9, 1000])
def test_nearest_rows_equals_brute_force(spark, block_rows):
    x, df = clusters(spark)
    got = {(r.row_id, r["rank"]): r.donor_id for r in nearest_rows(df, df, ["pair"], 5, 0, block_rows).collect()}
    for i in range(len(x)):
        dist = ((x[i] - x) ** 2).sum(axis=1)
        dist[i] = np.inf
        for rank, j in enumerate(np.argsort(dist)[:5], 1):
            assert got[f"{i:03d}", rank] == f"{j:03d}"


def test_smote_geometry_and_counts(spark, workspace):
    x, df = clusters(spark)
    made = borderline_smote(df, ["pair"], k=3, m=6, stage=workspace.stage).collect()
    assert len(made) == 28 and all(r.y == 1 for r in made) and len({r.row_id for r in made}) == 28
    minority = x[:12]
    for r in made:  # every new row lies on a segment between two minority rows
        point = np.array(r.x)
        ok = False
        for a in minority:
            for b in minority:
                span = b - a
                length = span @ span
                if length == 0:
                    continue
                t = (point - a) @ span / length
                ok |= -1e-9 <= t <= 1 + 1e-9 and np.abs(a + t * span - point).max() < 1e-9
        assert ok
    again = borderline_smote(df.repartition(5), ["pair"], k=3, m=6, block_rows=10).collect()
    assert {r.row_id: r.x for r in again}.keys() == {r.row_id: r.x for r in made}.keys()
    for r in again:
        np.testing.assert_allclose(r.x, {s.row_id: s.x for s in made}[r.row_id], atol=1e-12)


def test_smote_strategies_and_guards(spark):
    _, df = clusters(spark)
    assert borderline_smote(df, ["pair"], 3, 6, strategy=0.5).count() == 8
    assert borderline_smote(df, ["pair"], 3, 6, strategy={1: 15}).count() == 3
    with pytest.raises(Exception, match="too few rows"):
        borderline_smote(df, ["pair"], 12, 6).collect()
    far = df.withColumn("x", F.when(F.col("y") == 1, F.transform("x", lambda v: v + 100.0)).otherwise(F.col("x")))
    assert borderline_smote(far, ["pair"], 3, 6).count() == 0  # nothing in danger
