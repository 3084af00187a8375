"""Operator 13: the curve, the bounds, whole results against brute force, and blocks that are not read."""

from __future__ import annotations

import math

import numpy as np
import pytest

from peaklake.llm import hard_negatives as hn
from pyspark.sql import functions as F


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_the_curve_steps_to_a_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hn.hilbert_keys(cells, bits)
    order = sorted(range(len(cells)), key=lambda i: keys[i].tobytes())
    assert len({k.tobytes() for k in keys}) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_for_every_row_of_the_box():
    draw = np.random.default_rng(1)
    a, b = draw.integers(-300, 300, (40, 7)), draw.integers(-200, 250, (90, 7))
    low, high = hn.bounds(a, b.min(axis=0)[None].astype(np.int64), b.max(axis=0)[None].astype(np.int64))
    scores = hn.products(a, b)
    assert (scores >= low).all() and (scores <= high).all()


def test_products_are_exact_beyond_doubles():
    a = np.array([[(1 << 28) - 1, 3], [-(1 << 28) + 1, 1]], np.int32)
    assert hn.products(a, a).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in a] for x in a]


def brute(rows, rule, anchor):
    whole = []
    for r, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(rule.scale * x) >= hn.LIMIT for x in v):
            continue
        whole.append((r, i, [math.floor(rule.scale * x) for x in v], label))
    out = []
    for r, i, v, label in whole:
        if not anchor(i):
            continue
        scores = [(-sum(p * q for p, q in zip(v, w)), j, m) for s, j, w, m in whole if s != r]
        positives = sorted((s, j) for s, j, m in scores if m == label)[: rule.positives]
        for ps, pid in positives:
            found = sorted((s, j) for s, j, m in scores if m != label and rule.low * -ps <= -100 * s <= rule.high * -ps)
            out += [(i, pid, k + 1, j, -ps, -s) for k, (s, j) in enumerate(found[: rule.negatives])]
    return sorted(out)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int"
    clash = {c: F.lit(1) for c in ("id", "v", "key", "block", "grp", "rank", "anchor")}
    return spark.createDataFrame(rows, schema).repartition(4).withColumns(clash)


def edge_rows():
    draw = np.random.default_rng(5)
    rows = [(int(i), draw.integers(-4, 5, 6).astype(float).tolist(), int(draw.integers(0, 3))) for i in range(300)]  # many equal scores
    rows += rows[:40] + [(50, None, 1), (None, [1.0] * 6, 1), (100, [1.0] * 6, None), (150, [1.0, None] + [1.0] * 4, 1), (200, [math.nan] * 6, 0), (250, [math.inf] * 6, 0)]
    rows += [(0, [0.0] * 6, 2), (50, [], 1), (350, [2.0, 1.0], 0), (400, [1e30] * 6, 1), (450, [3.0] * 6, 77)]
    return rows + [(500 + i, [1.0, 2.0, 3.0, 1.0, 0.0, 1.0], 1) for i in range(60)]  # one very common vector


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "group_rows": 4, "page_zones": 3}, {"block_rows": 7, "group_rows": 3, "page_zones": 1, "scale": 3, "positives": 2, "low": 10, "high": 100}])
def test_whole_result(spark, sizes):
    rule, rows = hn.Rule(**sizes), edge_rows()
    got = hn.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0, rule)
    assert sorted(map(tuple, got.collect())) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows], rule, lambda i: i % 50 == 0)


def test_blocks_that_cannot_matter_are_not_read(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 1, (40, 12))
    rows = [(i, (centres[i % 40] + draw.normal(0, 0.01, 12)).tolist(), i % 20) for i in range(4000)]
    rule = hn.Rule(block_rows=50, group_rows=50)
    miner = hn.Miner(vectors(spark, rows), F.col("vec_id") % 50 == 0, rule)
    positives = miner.positives()
    got = miner.negatives(positives).collect()
    assert sorted(map(tuple, got)) == brute([(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows], rule, lambda i: i % 50 == 0)
    read = {p: spark.read.parquet(f"{miner.work.path}/{p}").count() for p in _tables(miner.work.path) if p.endswith("-pairs")}
    everything = miner.groups.count() * miner.blocks.count()
    assert everything >= 160 and all(n < 0.5 * everything for n in read.values()), (read, everything)


def _tables(path):
    import os

    return sorted(os.listdir(path.removeprefix("file:")))


def test_one_label_and_no_rows(spark):
    rows = [(i, [1.0, float(i)], 3) for i in range(120)]
    assert hn.mine(vectors(spark, rows), F.col("vec_id") % 50 == 0).count() == 0
    assert hn.mine(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert hn.mine(vectors(spark, [(1, None, 1)]), F.col("vec_id") % 50 == 0).count() == 0
