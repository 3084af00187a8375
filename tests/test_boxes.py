"""Blocks of near rows: bounds, layout, and results and work of searches that leave blocks out."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peaklake.operators import boxes
from peaklake.operators.matrix import Matrix
from peaklake.operators.neighbors import Donors, knn_impute, nearest_donor_values, nearest_rows
from peaklake.workspace import Workspace
from tests.test_neighbors import brute


def box(x):
    have = (~np.isnan(x)).sum(axis=0)
    low = [np.nanmin(c) if n else np.nan for c, n in zip(x.T, have, strict=True)]
    high = [np.nanmax(c) if n else np.nan for c, n in zip(x.T, have, strict=True)]
    return boxes.Boxes(np.array([low]), np.array([high]), np.array([have], float), np.array([float(len(x))]), np.array([int(np.isnan(x).sum(axis=1).max())]))


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9])
def test_no_row_is_nearer_than_the_bound_of_its_box(share):
    rng = np.random.default_rng(int(share * 10))
    for _ in range(60):
        x, q = rng.normal(size=(rng.integers(1, 12), 6)), 2 * rng.normal(size=(5, 6))
        for side in (x, q):
            side[rng.random(side.shape) < share] = np.nan
        bound = box(x).bounds(q)[:, 0]
        dist = Donors(x).distances(q).min(axis=1)
        assert (bound <= dist + 1e-9).all()
        assert np.isinf(dist[np.isinf(bound)]).all()


def test_the_bound_is_the_distance_of_a_box_of_one_row():
    x, q = np.array([[1.0, np.nan, 3.0]]), np.array([[2.0, 5.0, np.nan], [np.nan, 1.0, np.nan], [0.0, 0.0, 0.0]])
    np.testing.assert_allclose(box(x).bounds(q)[:, 0], Donors(x).distances(q)[:, 0])


def lumps(n, groups, p=6, gaps=0.1, seed=3):
    rng = np.random.default_rng(seed)
    x = 50 * rng.normal(size=(groups, p))[np.arange(n) % groups] + rng.normal(size=(n, p))
    x[rng.random(x.shape) < gaps] = np.nan
    return x


def table(spark, x, key="p"):
    rows = [(key, f"{i:05d}", "train" if i % 5 else "val", [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "pair string, sample_id string, role string, x array<double>")


def test_blocks_have_the_wanted_size_and_cover_all_rows(spark, workspace):
    x = lumps(900, 9)
    x[:300] = x[0]  # one cell with a third of the rows
    df = table(spark, x).select("pair", "sample_id", "x")
    sizes = spark.createDataFrame([("p", 50.0, 10.0)], "pair string, _per_block double, _per_query_block double")
    d, q = boxes.near_blocks(df, df.where("sample_id < '00400'"), sizes, ["pair"], "sample_id", workspace.stage)
    for side, name, most, total in ((d, "dblock", 50, 900), (q, "qblock", 10, 400)):
        found = pd.Series([r[name] for r in side.collect()]).value_counts()
        assert found.sum() == total and found.max() <= 2 * most


@pytest.mark.parametrize("gaps", [0.05, 0.5])
def test_imputation_by_bounds_equals_brute_force(spark, workspace, gaps):
    x = lumps(240, 6, gaps=gaps, seed=int(10 * gaps))
    x[7], x[8], x[9] = np.nan, x[10], x[10]  # nothing known, and rows alike
    x[:, 5] = np.nan
    x[11, 5] = 2.0  # one donor only
    train = np.arange(240) % 5 != 0
    two = table(spark, x).unionByName(table(spark, x[:12], "few"))  # a key of one block beside it
    axis = spark.createDataFrame([(k, list(range(6))) for k in ("p", "few")], "pair string, feature_ids array<bigint>")
    out = knn_impute(Matrix(two, axis, ("pair",)), 4, 20, workspace.stage).rows.orderBy("sample_id").collect()
    np.testing.assert_allclose(np.array([r.x for r in out if r.pair == "p"]), brute(x, train, 4), atol=1e-7)
    assert len(out) == 252


def staged(work, name):
    folder = work.path.removeprefix("file:")
    return [work.spark.read.parquet(f"{work.path}/{f}") for f in sorted(os.listdir(folder)) if f.endswith(name)]


def visits(spark, x, block_rows):
    """Pairs of blocks that met, and all that could."""
    work = Workspace(spark, "visits")
    df = table(spark, x)
    queries = df.where(F.exists("x", lambda v: v.isNull()))
    nearest_donor_values(queries, df.where("role = 'train'"), ["pair"], 4, block_rows, work.stage).count()
    group = ["pair", "qblock", "dblock"]
    met = sum(t.select(*group).distinct().count() for name in ("first-visits", "more-visits") for t in staged(work, name))
    count = [staged(work, f"ordered-{side}")[0].select(side).distinct().count() for side in ("qblock", "dblock")]
    return met, count[0] * count[1]


def test_met_pairs_of_blocks_grow_slower_than_all_pairs_on_clustered_data(spark):
    """Four times the rows in four times the clusters."""
    (few, all_few), (more, all_more) = (visits(spark, lumps(n, n // 100, gaps=0.03), 100) for n in (500, 2000))
    assert all_more > 10 * all_few and more < 0.6 * all_more
    assert more / few < 0.8 * all_more / all_few, (few, all_few, more, all_more)


@pytest.mark.parametrize("block_rows", [15, 60])
def test_nearest_rows_by_bounds_equals_brute_force(spark, workspace, block_rows):
    x = lumps(300, 10, gaps=0.0)
    x[40:60] = x[40]  # ties
    y = (np.arange(300) % 7 == 0).astype(int)
    df = spark.createDataFrame([("p", f"{i:04d}", int(y[i]), x[i].tolist()) for i in range(300)], "pair string, row_id string, y int, x array<double>")
    got = {(r.row_id, r.kind, r["rank"]): r.donor_id for r in nearest_rows(df.where("y = 1"), df, ["pair"], 6, 4, block_rows, workspace.stage).collect()}
    for i in np.flatnonzero(y):
        dist = np.round(((x[i] - x) ** 2).sum(axis=1), 9)
        dist[i] = np.inf
        order = np.lexsort((np.arange(300), dist))
        kin = [j for j in order if y[j] == y[i] and j != i]
        assert [got[f"{i:04d}", "all", r] for r in range(1, 7)] == [f"{j:04d}" for j in order[:6]]
        assert [got[f"{i:04d}", "kin", r] for r in range(1, 5)] == [f"{j:04d}" for j in kin[:4]]


def test_blocks_of_queries_share_pages(spark, workspace):
    """Every page of boxes went to every block of queries, and every query to a page of 64 boxes: both grew with the square of the rows."""
    rng = np.random.default_rng(8)
    rows = workspace.stage(spark.createDataFrame([("a", f"{i:05d}", f"{i % 300}", rng.normal(size=4).tolist()) for i in range(1_500)], "pair string, sample_id string, qblock string, x array<double>"), "rows")
    described = workspace.stage(boxes.boxes_of(rows.withColumnRenamed("qblock", "dblock"), ["pair"], "dblock"), "boxes")
    many, paged = boxes._paged(rows, described, ["pair"])
    assert (many.count(), paged.count()) == (1_500, 300)
    asked = rows.selectExpr("*", "array('7') AS seen", "array(named_struct('slot', 1, 'tau', CAST(0.5 AS DOUBLE))) AS wants")
    got = boxes.boxes_within(asked, described, ["pair"], "sample_id", by_block=True).select("qblock", "dblock").collect()
    each = boxes.boxes_within(asked, described, ["pair"], "sample_id").select("qblock", "dblock").distinct().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, each)) and got
    assert not any(r["dblock"] == "7" for r in got)
