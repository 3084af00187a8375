"""Nearest rows by tiles, and searches whose groups of queries and donors all meet."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklake.operators import neighbors as N
from tests.test_boxes import lumps, table


@pytest.mark.parametrize("share", [0.0, 0.2, 0.9])
def test_tiles_list_the_nearest_rows_in_order(monkeypatch, share):
    monkeypatch.setattr(N, "TILE_ROWS", 16)
    rng = np.random.default_rng(int(10 * share))
    for far in (0.0, 1e6):  # a common offset costs single precision its digits
        x, q = far + np.round(rng.normal(size=(150, 5)), 1), far + np.round(rng.normal(size=(20, 5)), 1)
        for side in (x, q):
            side[rng.random(side.shape) < share] = np.nan
        x[70:110] = x[3]  # more equal rows than are asked for
        tiles = N.Tiles(x)
        for among in (None, np.arange(0, 150, 3)):
            dist, place = tiles.nearest(q, 6, among)
            for i in range(len(q)):
                both = ~np.isnan(x) & ~np.isnan(q[i])
                common = both.sum(axis=1)
                want = 5 * np.where(both, x - q[i], 0.0).__pow__(2).sum(axis=1) / np.maximum(common, 1)
                want = np.round(np.where(common > 0, want, np.inf), N.DISTANCE_DIGITS)
                listed = [j for j in np.lexsort((np.arange(150), want)) if np.isfinite(want[j]) and (among is None or j % 3 == 0)][:6]
                assert place[i][place[i] >= 0].tolist() == listed
                np.testing.assert_allclose(dist[i][: len(listed)], want[listed], atol=1e-8)


def test_a_group_of_donors_fills_a_task(spark):
    """20,000 rows of 24 features are one group, and cross a shuffle at most once for each of 8 groups of queries."""
    rows = spark.range(20_000).select(F.lit("p").alias("pair"), F.sequence(F.lit(1), F.lit(24)).cast("array<double>").alias("x"))
    sizes = N._sizes(rows, rows, ["pair"], None).first()
    assert (sizes["_dgroups"], sizes["_qgroups"], sizes["_dblocks"]) == (1, 8, 1)


def test_groups_that_all_meet_give_what_one_group_gives(spark, workspace, monkeypatch):
    df = table(spark, lumps(240, 6, gaps=0.3)).select("pair", "sample_id", "x")
    found = []
    for rows in (100_000, 30):
        monkeypatch.setattr(N, "DONOR_ROWS", (1, rows))
        found.append(sorted(map(tuple, N.nearest_donor_values(df, df, ["pair"], 4, None, workspace.stage).collect())))
    assert found[0] == found[1] and len(found[0]) > 240


def test_many_keys_share_the_groups_of_queries(spark, workspace):
    """Forty keys of 20 rows asked in groups of one row: three groups each, so that donors are sent three times, and the same rows found."""
    df = table(spark, lumps(240, 6, gaps=0.3)).select("pair", "sample_id", "x")
    many = df.withColumn("pair", F.concat_ws("|", "pair", F.pmod(F.xxhash64("sample_id"), F.lit(40))))
    run = N._Search(many, many, ["pair"], "sample_id", None, None, workspace.stage)
    sent = {}
    run._met = lambda queries, donors: sent.update(rows=donors.groupBy("pair").agg(F.countDistinct("qgroup").alias("n")).agg(F.max("n")).first()[0])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(N, "LEAST_QUERIES", 1)
        run.run(None, None)
        assert 1 <= sent["rows"] <= 3


def test_a_query_leaves_a_group_as_one_row(spark, workspace):
    """The donors of all its gaps come in arrays, and the mean of the first k of each gap fills it."""
    from peaklake.functions.vectors import has_gap

    df = table(spark, lumps(240, 6, gaps=0.3)).select("pair", "sample_id", "x")
    asking = df.where(has_gap(F.col("x")))
    near = N.gap_donors(asking, df, ["pair"], 4, None, workspace.stage)
    assert near.count() == near.select("pair", "sample_id").distinct().count() <= asking.count()
    merged = near.unionByName(near).groupBy("pair", "sample_id").agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip(*N.NEAR)))).alias("n"))
    doubled = merged.select("pair", "sample_id", F.inline(N._fills(F.col("n"), 8))).collect()
    listed = N.nearest_donor_values(asking, df, ["pair"], 4, None, workspace.stage)
    want = {(r[0], r[1], r[2]): r[3] for r in listed.groupBy("pair", "sample_id", "pos").agg(F.avg("value")).collect()}
    assert {(r[0], r[1], r[2]) for r in doubled} == set(want) and len(doubled) == len(want) > 60
    for r in doubled:  # every donor twice, and twice as many of them
        assert r[3] == pytest.approx(want[r[0], r[1], r[2]])


def test_rows_of_short_lists_are_searched_together(monkeypatch):
    """Rows with gaps in common are near each other: their lists are lengthened at once, not one search for each feature."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random((2_000, 12)) < rng.choice([0.05, 0.75], size=(2_000, 1)), np.nan, rng.normal(size=(2_000, 12)))
    q = x[np.isnan(x).any(axis=1)][:200]
    tiles, calls, nearest = N.Tiles(x), [], N.Tiles.nearest
    monkeypatch.setattr(N.Tiles, "nearest", lambda *a: calls.append(len(a[1])) or nearest(*a))
    found = N.nearest_with_gaps(tiles, q, 4)
    assert len(calls) == 2 and 0 < calls[1] < 200
    monkeypatch.undo()
    got = {}
    for pos, row, place, dist in found:
        for one in zip(pos.tolist(), row.tolist(), place.tolist()):
            got.setdefault(one[:2], []).append(one[2])
    for i, j in zip(*np.nonzero(np.isnan(q))):
        having = np.flatnonzero(~np.isnan(x[:, j]))
        place = nearest(tiles, q[i:i + 1], 4, having)[1][0]
        assert got.get((j, i), []) == place[place >= 0].tolist()
