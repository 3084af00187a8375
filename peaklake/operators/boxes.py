"""Blocks of near rows, and which of them a nearest-neighbour search can leave out.

Rows, which may have gaps, are cut into cells around pivots, in two steps, and cells into blocks of bounded size. A block is described by its box: for each feature the least and greatest value and how many rows have it, and
the most gaps of a row. From a box follows a lower bound of the gap-aware distance of a query to every row inside, so a
query reads a block only if the bound does not exceed the distance of the neighbours it has found already.

Nothing is gathered: of the pivots there are at most ``MOST_PIVOTS`` in a step, cells are counted by grouped sums, and bounds
are formed for (blocks of queries, page of boxes).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

from peaklake.operators.cogroup import cogroup_apply
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_PIVOTS = 512  # of a key, and of one of its areas
CHUNK_ROWS = 8_192  # rows that meet the pivots at once
PAGE_BOXES, PAGE_VALUES = 2_048, 4_000_000  # of a page: most boxes, and most numbers of theirs
BOUND_ROWS = 1_024  # queries whose bounds are formed at once
FIRST_BOXES = 4  # blocks that a query visits before it asks which others are near enough
SLACK = 1e-7  # distances are sums of differences; bounds give way by more than their rounding

Stage = Callable[[DataFrame, str], DataFrame]


def choose_pivots(rows: DataFrame, keys: Sequence[str], id_col: str, wanted: Column, salt: str) -> DataFrame:
    """keys..., pivots: at most ``wanted`` (at most ``MOST_PIVOTS``) rows of each key, as arrays.

    ``rows`` has the size of its key as ``_nk``. About four times as many candidates are taken by a hash of their id; half of
    the pivots are the first of these, the others are those farthest from all pivots before.
    """
    keys = list(keys)
    draw = F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 40)) / (1 << 40)
    some = rows.withColumn("_m", F.least(wanted, F.lit(MOST_PIVOTS))).withColumn("_u", draw).where(F.col("_u") * F.col("_nk") < 4 * F.col("_m"))
    kind = T.StructField("pivots", T.ArrayType(T.ArrayType(T.DoubleType())))
    schema = T.StructType([*[rows.schema[c] for c in keys], kind])

    def spread(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["_u", id_col])
        points = np.vstack([np.asarray(r, dtype=np.float64) for r in found["x"]])
        far, m = gap_distances(points), min(int(found["_m"].iloc[0]), len(points))
        chosen = list(range(max(1, m // 2)))
        near = far(points[chosen]).min(axis=0)
        while len(chosen) < m:
            near[chosen] = -1.0
            chosen.append(int(np.where(np.isfinite(near), near, -1.0).argmax()))
            near = np.minimum(near, far(points[chosen[-1:]])[0])
        return pd.DataFrame([(*key, [found["x"].iloc[i] for i in chosen])], columns=schema.names)

    return some.select(*keys, id_col, "x", "_m", "_u").groupBy(*keys).applyInPandas(spread, schema)


def nearest_pivot(rows: DataFrame, pivots: DataFrame, keys: Sequence[str], id_col: str, name: str, distance: str | None = None) -> DataFrame:
    """``rows`` with the number of their nearest pivot under ``name``; 0 for keys without pivots and rows without a common feature.

    The distance to it, by the features that both have, is added under ``distance``; infinite without a pivot.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("_chunks"))
    left = rows.join(counts, keys).withColumn("_chunk", F.pmod(F.xxhash64(id_col), "_chunks").cast("int")).drop("_chunks")
    right = pivots.join(counts, keys).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    more = [T.StructField(name, T.IntegerType())] + ([T.StructField(distance, T.DoubleType())] if distance else [])
    schema = T.StructType([*[f for f in rows.schema if f.name != name], *more])

    def assign(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=schema.names)
        cell, far = np.zeros(len(rows), np.int32), np.full(len(rows), np.inf)
        if len(found):
            points = np.vstack([np.asarray(r, dtype=np.float64) for r in found["pivots"].iloc[0]])
            apart = gap_distances(points)(np.vstack([np.asarray(r, dtype=np.float64) for r in rows["x"]]))
            cell[:] = apart.argmin(axis=1)
            far = np.sqrt(points.shape[1] * apart.min(axis=1))
        return rows.assign(**{name: cell}, **({distance: far} if distance else {}))[schema.names]

    return cogroup_apply(left, right, [*keys, "_chunk"], assign, schema)


def gap_distances(points: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """p / common * sum of squared differences to each of the points; inf without a common feature."""
    has = ~np.isnan(points)
    flat, has = np.where(has, points, 0.0), has.astype(np.float64)

    def distances(x: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(x)
        own, seen = np.where(seen, x, 0.0), seen.astype(np.float64)
        common = seen @ has.T
        total = (own * own) @ has.T - 2.0 * own @ flat.T + seen @ (flat * flat).T
        return np.where(common > 0, np.maximum(total, 0.0) / np.maximum(common, 1.0), np.inf)

    return distances


def near_blocks(
    donors: DataFrame, queries: DataFrame, sizes: DataFrame, keys: Sequence[str], id_col: str, stage: Stage
) -> tuple[DataFrame, DataFrame]:
    """Both sides in blocks of near rows: donors with ``dblock``, queries with ``qblock``.

    Rows go to the nearest of a few pivots of their key, and there to the nearest of that cell's own: as many cells as the
    donors fill blocks. Rows with like numbers of gaps go together, so that a few rows with many gaps do not
    loosen the bounds of the others. A full cell is spread over several blocks by a hash.
    """
    keys = list(keys)
    sizes = sizes.select(*keys, "_per_block", "_per_query_block")
    counted = donors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nk")).join(sizes, keys)
    first = stage(choose_pivots(donors.join(counted, keys), keys, id_col, F.ceil(F.sqrt(F.col("_nk") / F.col("_per_block"))), "first"), "pivots")
    d = stage(nearest_pivot(donors, first, keys, id_col, "_area"), "areas")
    areas = [*keys, "_area"]
    inside = stage(d.groupBy(*areas).agg(F.count(F.lit(1)).alias("_nk")).join(sizes, keys), "area-sizes")
    second = stage(choose_pivots(d.join(inside, areas), areas, id_col, F.ceil(F.col("_nk") / F.col("_per_block")), "second"), "pivots")
    out = []
    for side, rows, per in (("dblock", d, "_per_block"), ("qblock", nearest_pivot(queries, first, keys, id_col, "_area"), "_per_query_block")):
        gaps = F.size(F.filter("x", lambda v: v.isNull()))
        placed = nearest_pivot(rows, second, areas, id_col, "_cell").withColumn("_gaps", F.floor(4 * gaps / F.size("x")).cast("int"))
        placed = stage(placed, f"cells-{side}")
        cells = [*areas, "_cell", "_gaps"]
        full = placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).join(sizes, keys)
        full = full.select(*cells, F.ceil(F.col("_n") / F.col(per)).alias("_parts"))
        part = F.pmod(F.xxhash64(id_col, F.lit(side)), "_parts")
        named = F.concat_ws("-", "_area", "_cell", "_gaps", part).alias(side)
        out.append(stage(placed.join(full, cells).select(*rows.drop("_area").columns, named), f"ordered-{side}"))
    return out[0], out[1]


def boxes_of(blocks: DataFrame, keys: Sequence[str], block: str, serves: Column | None = None) -> DataFrame:
    """keys..., block, low, high, have (per feature), n, worst (most gaps of a row), serves: what a query may want of the block.

    ``serves`` is an aggregate that gives an array of counts; without it, the rows that have each feature.
    """
    keys = [*keys, block]
    values = blocks.select(*keys, F.posexplode("x").alias("pos", "v"))
    stats = values.groupBy(*keys, "pos").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("have"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "low", "high", "have")))
    stats = stats.groupBy(*keys).agg(listed.alias("f"))
    gaps = F.size(F.filter("x", lambda v: v.isNull()))
    whole = [F.count(F.lit(1)).alias("n"), F.max(gaps).alias("worst")]
    if serves is not None:
        whole.append(serves.alias("serves"))
    sizes = blocks.groupBy(*keys).agg(*whole)
    out = stats.join(sizes, keys)
    asked = F.col("f.have") if serves is None else F.col("serves")
    return out.select(*keys, F.col("f.low").alias("low"), F.col("f.high").alias("high"), F.col("f.have").alias("have"), "n", "worst", asked.alias("serves"))


@dataclass
class Boxes:
    """A page of boxes as arrays."""

    low: np.ndarray
    high: np.ndarray
    have: np.ndarray
    n: np.ndarray
    worst: np.ndarray

    @staticmethod
    def of(frame: pd.DataFrame) -> Boxes:
        stacked = [np.vstack([np.asarray(r, dtype=np.float64) for r in frame[c]]) for c in ("low", "high", "have")]
        return Boxes(*stacked, frame["n"].to_numpy(np.float64), frame["worst"].to_numpy(np.int64))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of box b has a smaller distance p / common * sum of squared differences to query i than [i, b]."""
        out = np.empty((len(queries), len(self.n)))
        present = ~np.isnan(queries)
        p = queries.shape[1]
        for b in range(len(self.n)):
            some = self.have[b] > 0
            with np.errstate(invalid="ignore"):
                gap = np.maximum(np.maximum(self.low[b] - queries, queries - self.high[b]), 0.0)
            squares = np.where(present & some, gap, 0.0) ** 2
            sure = present & (self.have[b] == self.n[b])
            unsure = present & some & ~sure
            total, count, open_ = (squares * sure).sum(axis=1), sure.sum(axis=1), unsure.sum(axis=1)
            # a row lacks at most so many of the features that others of the block have
            lacking = int(self.worst[b] - (~some).sum())
            if lacking <= 0 or not unsure.any():
                total, count = total + (squares * unsure).sum(axis=1), count + open_
                out[:, b] = np.where(count > 0, p * total / np.maximum(count, 1), np.inf)
                continue
            # the least mean over the sure features and t of the others is that over the t smallest
            rising = np.sort(np.where(unsure, squares, np.inf), axis=1)
            sums = np.concatenate([np.zeros((len(queries), 1)), np.cumsum(np.where(np.isfinite(rising), rising, 0.0), axis=1)], axis=1)
            t = np.arange(p + 1)
            of = count[:, None] + t
            allowed = (t <= open_[:, None]) & (t >= (open_ - lacking)[:, None]) & (of > 0)
            means = np.where(allowed, (total[:, None] + sums) / np.maximum(of, 1), np.inf)
            out[:, b] = p * means.min(axis=1)
        return out

    def from_middle(self, queries: np.ndarray) -> np.ndarray:
        """Mean squared distance to the middle of each box, for telling boxes of equal bounds apart."""
        middle = (self.low + self.high) / 2
        out = np.empty((len(queries), len(self.n)))
        for b in range(len(self.n)):
            far = (queries - middle[b]) ** 2
            seen = ~np.isnan(far)
            out[:, b] = np.where(seen, far, 0.0).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
        return out


def _paged(queries: DataFrame, boxes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Queries once for each page of the boxes of their key, and every page once for each chunk of queries: whole blocks that go together as ``_chunk``."""
    per_page = F.least(F.lit(PAGE_BOXES), F.greatest(F.lit(1), F.floor(PAGE_VALUES / (3 * F.max(F.size("low"))))))
    pages = boxes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_page).cast("int").alias("_pages"))
    chunks = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("_chunks"))
    sizes = pages.join(chunks, keys)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    many = queries.join(sizes, keys).withColumn("_chunk", place("qblock", "_chunks")).withColumn("_page", every("_pages"))
    paged = boxes.join(sizes, keys).withColumn("_page", place("dblock", "_pages")).withColumn("_chunk", every("_chunks"))
    return many.drop("_pages", "_chunks"), paged.drop("_pages", "_chunks")


def _schema(queries: DataFrame, keys: Sequence[str], id_col: str, *more: T.StructField) -> T.StructType:
    return T.StructType([*[queries.schema[c] for c in (*keys, "qblock", id_col)], T.StructField("dblock", T.StringType()), *more])


def nearest_boxes(queries: DataFrame, boxes: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """keys..., qblock, id, dblock: for each query the ``FIRST_BOXES`` blocks of smallest bound, of equal ones those with the nearest middle."""
    keys = list(keys)
    many, paged = _paged(queries.select(*keys, "qblock", id_col, "x"), boxes, keys)
    number = [T.StructField(c, T.DoubleType()) for c in ("bound", "middle")]
    schema = _schema(queries, keys, id_col, *number)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=schema.names)
        x, page = np.vstack([np.asarray(r, dtype=np.float64) for r in left["x"]]), Boxes.of(right)
        found = []
        for start in range(0, len(x), BOUND_ROWS):
            bound, middle = page.bounds(x[start:start + BOUND_ROWS]), page.from_middle(x[start:start + BOUND_ROWS])
            col = np.lexsort((middle, bound))[:, :FIRST_BOXES]
            row = np.repeat(np.arange(len(col)), col.shape[1])
            col = col.ravel()
            found.append((start + row, col, bound[row, col], middle[row, col]))
        row, col, bound, middle = (np.concatenate(part) for part in zip(*found))
        out = left[[*keys, "qblock", id_col]].iloc[row].reset_index(drop=True)
        out = out.assign(dblock=right["dblock"].to_numpy()[col], bound=bound, middle=middle)
        return out[schema.names]

    found = cogroup_apply(many, paged, [*keys, "_chunk", "_page"], best, schema)
    rank = Window.partitionBy(*keys, id_col).orderBy("bound", "middle", "dblock")
    return found.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= FIRST_BOXES).select(*keys, "qblock", id_col, "dblock")


def boxes_within(queries: DataFrame, boxes: DataFrame, keys: Sequence[str], id_col: str, by_block: bool = False) -> DataFrame:
    """keys..., qblock, id, dblock: the blocks that may hold something a query wants, other than those it has ``seen``.

    ``queries`` has ``seen``, an array of blocks, and ``wants``, an array of (slot, tau): a block matters if it serves the slot at all and its bound is at most
    tau. With ``by_block`` a block that matters to any row of a block of queries is listed once for that block, without ids.
    """
    keys = list(keys)
    many, paged = _paged(queries.select(*keys, "qblock", id_col, "x", "seen", "wants"), boxes, keys)
    schema = _schema(queries, keys, id_col)
    if by_block:
        schema = T.StructType([f for f in schema if f.name != id_col])

    def needed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=schema.names)
        left = left.sort_values("qblock", kind="stable").reset_index(drop=True)
        page, blocks = Boxes.of(right), right["dblock"].to_numpy()
        serves = np.vstack([np.asarray(r) for r in right["serves"]]) > 0
        rows, cols = [], []
        for start in range(0, len(left), BOUND_ROWS):
            part = left.iloc[start:start + BOUND_ROWS]
            x = np.vstack([np.asarray(r, dtype=np.float64) for r in part["x"]])
            tau = np.full((len(x), serves.shape[1]), -np.inf)
            for i, wants in enumerate(part["wants"]):
                for want in wants:
                    tau[i, want["slot"]] = want["tau"]
            reach = np.stack([np.where(s, tau, -np.inf).max(axis=1) for s in serves], axis=1)
            with np.errstate(invalid="ignore"):
                near = page.bounds(x) <= reach + SLACK * np.maximum(1.0, reach)
            first = np.arange(len(x))
            if by_block:
                first = np.unique(part["qblock"].to_numpy().astype(str), return_index=True)[1]
            for i, seen in enumerate(part["seen"]):
                near[i] &= ~np.isin(blocks, seen)
            row, col = np.nonzero(np.logical_or.reduceat(near, np.sort(first), axis=0) if by_block else near)
            rows.append(start + np.sort(first)[row])
            cols.append(col)
        row, col = np.concatenate(rows), np.concatenate(cols)
        if by_block:  # a block may go on in the next rows
            of_block = np.unique(left["qblock"].to_numpy().astype(str), return_index=True, return_inverse=True)
            row, col = np.divmod(np.unique(of_block[1][of_block[2]][row] * len(blocks) + col), len(blocks))
        out = left[[*keys, "qblock", id_col]].iloc[row].reset_index(drop=True).assign(dblock=blocks[col])
        return out[schema.names]

    return cogroup_apply(many, paged, [*keys, "_chunk", "_page"], needed, schema)
