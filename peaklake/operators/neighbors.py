"""Exact nearest neighbours in blocks: imputation and border oversampling.

Both operators are defined over all (query, donor) distances. A task gets one group of queries and one of donors, goes
through the distances in tiles and lets out only the group's best k per query, which a second step merges. A tile is
screened by matrix products in single precision with a margin for their rounding; what may be near enough is measured in
double precision. No pair of rows ever becomes a row of a table and no key is gathered in a task. Keys of few groups of donors let
all groups meet; where a key has many, or blocks of a given size are wanted, blocks hold near rows and only those
meet whose lower bound leaves a chance (``boxes``); every donor that could be among the nearest is considered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from peaklake.operators import balls, boxes
from peaklake.functions.hashing import draw_int, draw_key, draw_unit
from peaklake.functions.vectors import dense, has_gap
from peaklake.operators.cogroup import cogroup_apply
from peaklake.operators.columns import column_stats, pack, train_rows
from peaklake.operators.matrix import Matrix
from peaklake.operators.ranking import hash_rank
from peaklake.operators.sampling import class_counts, random_under_sample
from peaklake.workspace import Workspace
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_VALUES = 8_000_000  # rows x features of a group of donors: 64 MB. Every group of one side is shuffled once for each of the other
DONOR_ROWS = (256, 393_216)  # bounds of the rows of a group of donors
QUERY_ROWS = 131_072  # most rows of a group of queries, whose answers are held together
QUERY_PARTS, LEAST_QUERIES = 8, 1_024  # a key has so many groups of queries, which keeps all cores busy on few keys, unless they get smaller
GROUPS = 96  # and with many keys only so many of all keys together: every group reads all donors of its key
MOST_PARTS = 1_024  # of a search
GRID_BLOCKS = 16  # up to so many groups of donors all groups of a key meet; bounds between more of them pay for the layout
SLICE_ROWS = 256  # queries of a group that are handled at once
TILE_ROWS = 4_096  # donors that meet them at once, but fewer in the first tiles: those of the very first are all measured
FIRST_ROWS = 512
LISTED = (8, 64)  # times k rows of a short and a long list
NEAR = ("pos", "dist", "donor_id", "value")  # what is known of a gap's donor, in the order of choice
DISTANCE_DIGITS = 9  # distances are compared after rounding, so equal rows tie whatever the block layout


def as_is(df: DataFrame, name: str) -> DataFrame:
    """No staging: for callers that run a single small search."""
    return df


def _stack(rows: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(r, dtype=np.float64) for r in rows])


class Donors:
    """One block of donors, ready for distances to slices of queries."""

    def __init__(self, donors: np.ndarray):
        present = ~np.isnan(donors)
        # Moving both sides by the same vector changes no difference and keeps the sums small.
        self.shift = np.nansum(donors, axis=0) / np.maximum(present.sum(axis=0), 1)
        self.complete = bool(present.all())
        moved = np.where(present, donors - self.shift, 0.0)
        self.x, self.squares, self.mask = moved.T.copy(), (moved * moved).T.copy(), present.T.astype(np.float64)
        self.norms = self.squares.sum(axis=0)

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """p / common * sum of squared differences over the features present in both; inf without a common one."""
        present = ~np.isnan(queries)
        q = np.where(present, queries - self.shift, 0.0)
        if self.complete and present.all():
            return np.maximum((q * q).sum(axis=1)[:, None] - 2.0 * (q @ self.x) + self.norms, 0.0)
        mask = present.astype(np.float64)
        common = mask @ self.mask
        total = (q * q) @ self.mask - 2.0 * (q @ self.x) + mask @ self.squares
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = queries.shape[1] * np.maximum(total, 0.0) / common
        return np.where(common > 0, dist, np.inf)


def ranked(dist: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k smallest distances of every row in order; equal rounded distances keep the column order."""
    n = dist.shape[1]
    if n <= k:
        return np.argsort(np.round(dist, DISTANCE_DIGITS), axis=1, kind="stable")
    cut = np.sort(np.argpartition(dist, k - 1, axis=1)[:, :k], axis=1)
    near = np.take_along_axis(dist, cut, axis=1)
    order = np.argsort(np.round(near, DISTANCE_DIGITS), axis=1, kind="stable")
    out = np.take_along_axis(cut, order, axis=1)
    # Where more columns than k reach the last distance, the partition chose among them at will: look further there.
    bound = near.max(axis=1) + 10.0 ** -DISTANCE_DIGITS
    tied = np.flatnonzero((dist <= bound[:, None]).sum(axis=1) > k)
    if tied.size:
        out[tied] = ranked(dist[tied], 4 * k)[:, :k]
    return out


def smallest(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite distances of every row."""
    cols = ranked(dist, k)
    row, col = np.repeat(np.arange(len(dist)), cols.shape[1]), cols.ravel()
    finite = np.isfinite(dist[row, col])
    return row[finite], col[finite]


def gap_neighbours(gaps: np.ndarray, present: np.ndarray, dist: np.ndarray, k: int):
    """(position, row, column) of the k nearest donors that have the feature, for every gap of the queries.

    The nearest donors of a row are ranked once; a gap takes the first k of them that have its feature. Gaps for
    which that short list is not enough are searched among all donors.
    """
    short = ranked(dist, 8 * k)
    reachable = np.isfinite(np.take_along_axis(dist, short, axis=1))
    found = []
    for pos in np.flatnonzero(gaps.any(axis=0)):
        asking = np.flatnonzero(gaps[:, pos])
        usable = present[:, pos][short[asking]] & reachable[asking]
        count = usable.cumsum(axis=1)
        enough = (count[:, -1] >= k) | (short.shape[1] == dist.shape[1])
        row, place = np.nonzero(usable & (count <= k) & enough[:, None])
        found.append((np.full(len(row), pos), asking[row], short[asking[row], place]))
        rest, having = asking[~enough], np.flatnonzero(present[:, pos])
        if rest.size and having.size:
            row, col = smallest(dist[np.ix_(rest, having)], k)
            found.append((np.full(len(row), pos), rest[row], having[col]))
    return found


class Tiles:
    """A group of donors, in the order of their ids, for the nearest ones of many queries.

    ``nearest`` goes through the donors in tiles. Of a tile only those are measured whose distance, by one product in single
    precision less a margin above its rounding, does not exceed the farthest one held so far.
    """

    def __init__(self, donors: np.ndarray):
        self.values, whole = donors, Donors(donors)
        self.shift, self.norms, self.complete = whole.shift, whole.norms, whole.complete
        p = donors.shape[1]
        top = float(np.abs(whole.x).max(initial=0.0))
        self.kind = np.float32 if top < 1e15 else np.float64  # squares must not overflow
        self.margin = 4.0 * (3 * p + 16) * float(np.finfo(self.kind).eps)
        self.sides: dict[bool, np.ndarray] = {}
        self.room = np.empty(0, self.kind), np.empty(0, bool)
        self.taken: tuple = (None, None, None)  # the last choice of donors, for which form, and their side

    def _side(self, complete: bool, among: np.ndarray | None) -> np.ndarray:
        """The donors' side of the product. Where no value is missing on either side, distances need no masks: p + 2 rows, not 3 p + 2."""
        if complete not in self.sides:
            w = Donors(self.values)  # not kept: three times as large as the donors themselves
            ones, norms = np.ones((1, len(self.values))), w.norms[None, :]
            parts = [w.x, ones, norms] if complete else [w.mask, w.x, w.squares, ones, norms]
            self.sides[complete] = np.vstack(parts).astype(self.kind)
        if among is None:
            return self.sides[complete]
        if self.taken[0] is not among or self.taken[1] != complete:
            self.taken = (among, complete, self.sides[complete][:, among])
        return self.taken[2]

    def _room(self, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a product and its signs are written. New room for every tile costs more than the product itself."""
        size = rows * columns
        if size > len(self.room[0]):
            self.room = np.empty(size, self.kind), np.empty(size, bool)
        return tuple(r[:size].reshape(rows, columns) for r in self.room)

    def _screen(self, x: np.ndarray, mask: np.ndarray, tau: np.ndarray, complete: bool = False) -> np.ndarray:
        """The queries' side of the product: at most zero for a donor at a distance of at most ``tau``."""
        tau = tau + 10.0 ** -DISTANCE_DIGITS
        squares, p = x * x, x.shape[1]
        if complete:
            size = squares.sum(axis=1)
            base = (size - tau - self.margin * (size + tau))[:, None]
            with np.errstate(over="ignore"):
                return np.hstack([-2.0 * x, base, np.full((len(x), 1), 1.0 - self.margin)]).astype(self.kind)
        base = -self.margin * (squares.sum(axis=1) + tau)
        less = np.full((len(x), 1), -self.margin)
        with np.errstate(over="ignore"):
            return np.hstack([squares - (tau / p)[:, None] * mask, -2.0 * x, mask, base[:, None], less]).astype(self.kind)

    def nearest(self, queries: np.ndarray, k: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, places) of the k nearest of the donors ``among`` (places in rising order), one row per query.

        Rows are ordered by rounded distance, equal ones by place, and filled up with inf and -1.
        """
        places = np.arange(len(self.values)) if among is None else among
        present = ~np.isnan(queries)
        complete = self.complete and bool(present.all())
        side = self._side(complete, among)
        x, mask = np.where(present, queries - self.shift, 0.0), present.astype(np.float64)
        seen = mask.astype(self.kind)
        n, p = queries.shape
        dist, place = np.full((n, k), np.inf), np.full((n, k), -1)
        known = np.flatnonzero(present.any(axis=1))  # the others have no distance to anything
        start = stop = 0
        while known.size and stop < len(places):
            start, stop = stop, min(len(places), stop + min(TILE_ROWS, max(FIRST_ROWS, stop)))
            tile = side[:, start:stop]
            tau = dist[known, -1]
            full = np.isfinite(tau)
            product, near = self._room(known.size, tile.shape[1])
            if full.any():
                rows = slice(None) if full.all() else full
                some, limits = known[rows], tau[rows]
                product = product[:some.size]
                with np.errstate(invalid="ignore", over="ignore"):
                    np.matmul(self._screen(x[some], mask[some], limits, complete), tile, out=product)
                    # a product that is no number tells nothing, so the donor stays
                    if some.size == known.size:
                        np.logical_not(np.greater(product, 0, out=near), out=near)
                    else:
                        near[full] = ~(product > 0)
            if not full.all():
                has = np.ones((p, stop - start), self.kind) if complete else tile[:p]
                near[~full] = self._first(queries[known[~full]], seen[known[~full]], has, places[start:stop], k)
            flat = np.flatnonzero(near.ravel())  # few of many: much faster than over two axes
            if flat.size == 0:
                continue
            row, col = np.divmod(flat, near.shape[1])
            row, col = known[row], places[start + col]
            gap = queries[row] - self.values[col]
            if complete:
                found = p * np.einsum("ij,ij->i", gap, gap) / p
            else:
                both = ~np.isnan(gap)
                common = both.sum(axis=1)
                squares = np.where(both, gap, 0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = p * np.einsum("ij,ij->i", squares, squares) / common
                use = common > 0
                row, col, found = row[use], col[use], found[use]
            held_row, held = np.nonzero(place >= 0)
            changed = np.zeros(n, bool)
            changed[row] = True
            keep = changed[held_row]
            held_row, held = held_row[keep], held[keep]
            row = np.concatenate([held_row, row])
            col, found = np.concatenate([place[held_row, held], col]), np.concatenate([dist[held_row, held], found])
            # Held places are lower than new ones and both come in order, so stable sorts leave equal distances in the order of places.
            order = np.argsort(np.round(found, DISTANCE_DIGITS), kind="stable")
            order = order[np.argsort(row[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]
            row, col, found = row[order], col[order], found[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            first = rank < k
            dist[changed], place[changed] = np.inf, -1
            dist[row[first], rank[first]], place[row[first], rank[first]] = found[first], col[first]
        return dist, place

    def _first(self, queries: np.ndarray, seen: np.ndarray, has: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
        """Donors for queries that hold fewer than k yet: of those with a common feature, all that may be the k nearest of the tile."""
        reach = seen @ has > 0
        many = np.flatnonzero(reach.sum(axis=1) > 4 * k)
        if many.size:
            part = Donors(self.values[places]).distances(queries[many])
            kth = np.partition(part, k - 1, axis=1)[:, k - 1:k]
            size = (np.where(np.isnan(queries[many]), 0.0, queries[many] - self.shift) ** 2).sum(axis=1)[:, None] + self.norms[places].max()
            # the expanded sums are rounded by a share of the squares, not of the distance
            reach[many] &= part <= kth + 2 * 10.0 ** -DISTANCE_DIGITS + 1e-12 * queries.shape[1] * size
        return reach


def nearest_with_gaps(tiles: Tiles, queries: np.ndarray, k: int, among: np.ndarray | None = None):
    """(position, row, place, distance) of the k nearest donors that have the feature, for every gap of the queries.

    The nearest donors of a row are listed once; a gap takes the first k of them that have its feature. Rows with a gap for
    which that short list is not enough are listed again at length, and gaps that are still short are searched among all
    donors that have the feature.
    """
    still, present = np.isnan(queries), ~np.isnan(tiles.values)
    total = len(tiles.values) if among is None else len(among)
    found = []
    for length in LISTED:
        rows = np.flatnonzero(still.any(axis=1))
        if rows.size == 0:
            return found
        dist, place = tiles.nearest(queries[rows], length * k, among)
        ended = (place[:, -1] < 0) | (place.shape[1] >= total)  # the list holds every donor within reach
        for pos in np.flatnonzero(still.any(axis=0)):
            asking = np.flatnonzero(still[rows, pos])
            usable = present[place[asking], pos] & (place[asking] >= 0)
            count = usable.cumsum(axis=1)
            enough = (count[:, -1] >= k) | ended[asking]
            row, at = np.nonzero(usable & (count <= k) & enough[:, None])
            row = asking[row]
            found.append((np.full(len(row), pos), rows[row], place[row, at], dist[row, at]))
            still[rows[asking[enough]], pos] = False
    for pos in np.flatnonzero(still.any(axis=0)):
        rest, having = np.flatnonzero(still[:, pos]), np.flatnonzero(present[:, pos])
        if among is not None:
            having = np.intersect1d(having, among)
        if having.size:
            far, where = tiles.nearest(queries[rest], k, having)
            row, at = np.nonzero(where >= 0)
            found.append((np.full(len(row), pos), rest[row], where[row, at], far[row, at]))
    return found


def _sizes(queries: DataFrame, donors: DataFrame, keys: list[str], block_rows: int | None) -> DataFrame:
    """keys..., _per_block, _per_query_block: rows of a block; _qblocks, _dblocks: blocks of a side; _qgroups, _dgroups: of which a task takes one each; _qleast: fewest _qgroups."""
    low, high = DONOR_ROWS
    most = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.col("_p"), F.lit(1)))))
    parts = F.least(F.lit(QUERY_PARTS), F.ceil(F.col("_nq") / LEAST_QUERIES))
    qleast = F.ceil(F.col("_nq") / F.least(most, F.lit(QUERY_ROWS)))
    qgroups = F.greatest(qleast, parts).cast("int")
    dgroups = F.ceil(F.col("_nd") / most).cast("int")
    per_block = most if block_rows is None else F.lit(block_rows)
    per_query_block = F.least(most, F.lit(QUERY_ROWS)) if block_rows is None else F.lit(block_rows)
    return (
        queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nq"), F.max(F.size("x")).alias("_p"))
        .join(donors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nd")), keys)
        .select(
            *keys, per_block.cast("double").alias("_per_block"), per_query_block.cast("double").alias("_per_query_block"),
            F.ceil(F.col("_nq") / per_query_block).cast("int").alias("_qblocks"),
            F.ceil(F.col("_nd") / per_block).cast("int").alias("_dblocks"),
            qgroups.alias("_qgroups"), dgroups.alias("_dgroups"), qleast.cast("int").alias("_qleast"),
        )
    )


def _wide(block_rows: int | None) -> Column:
    """Keys whose blocks are laid out by nearness."""
    return F.col("_dblocks") > (GRID_BLOCKS if block_rows is None else 1)


class _Search:
    """Which groups of queries and donors meet, and their best rows.

    ``block`` gets queries, donors and which blocks of both must meet, and gives (keys..., id, donor_id, dist, ...): the best
    donors of this group for everything a query wants. Keys of few groups of donors are cut by a hash, and all groups meet. With
    more, both sides are laid out in blocks of near rows (``boxes``); a block of queries visits the few blocks that most of
    its rows have as nearest ones, and then those whose bound does not exceed what some row has found there.
    """

    def __init__(self, queries: DataFrame, donors: DataFrame, keys: Sequence[str], id_col: str, block, schema: T.StructType, stage):
        self.queries, self.donors, self.keys, self.id_col = queries, donors, list(keys), id_col
        self.block, self.schema = block, schema
        self.stage = Workspace(queries.sparkSession, "neighbours").stage if stage is as_is else stage  # the steps read each other many times
        self.group = [*self.keys, "qgroup", "dgroup"]
        self.groups = 0  # that meet, as far as known

    def run(self, block_rows: int | None, wants, serves: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
        """All that ``block`` gives for the pairs of blocks that must meet.

        ``wants(queries, found)`` adds what a query still wants after its first blocks as (slot, tau), see ``boxes_within``.
        ``sizes`` are given if it is known that no key is laid out by nearness.
        """
        keys, spark = self.keys, self.queries.sparkSession
        if sizes is not None:
            return self._grid(self.queries, self.donors, sizes)
        sizes = self.stage(_sizes(self.queries, self.donors, keys, block_rows), "block-sizes")
        share = -(-GROUPS // max(1, sizes.count()))
        sizes = sizes.withColumn("_qgroups", F.greatest("_qleast", F.least("_qgroups", F.lit(share))))
        many = sizes.where(_wide(block_rows)).collect()  # one row for each key of many donors
        if not many:
            return self._grid(self.queries, self.donors, sizes)
        large = spark.createDataFrame(many, sizes.schema)
        q, d = (side.join(large.select(*keys), keys, "left_semi") for side in (self.queries, self.donors))
        rest = [side.join(large.select(*keys), keys, "left_anti") for side in (self.queries, self.donors)]
        return self._grid(*rest, sizes).unionByName(self._bounded(q, d, large, wants, serves, block_rows is None))

    def _grid(self, queries: DataFrame, donors: DataFrame, sizes: DataFrame) -> DataFrame:
        """Every group of queries meets every group of donors of its key."""
        sizes = sizes.select(*self.keys, "_qgroups", "_dgroups")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        place = lambda c: F.pmod(F.xxhash64(self.id_col), c).cast("int")
        q = queries.join(sizes, self.keys).withColumn("qgroup", place("_qgroups")).withColumn("dgroup", every("_dgroups"))
        d = donors.join(sizes, self.keys).withColumn("dgroup", place("_dgroups")).withColumn("qgroup", every("_qgroups"))
        self.groups = sizes.agg(F.sum(F.col("_qgroups") * F.col("_dgroups"))).first()[0] or 0
        return self._met(*(side.drop("_qgroups", "_dgroups").withColumns({"qblock": F.lit("0"), "dblock": F.lit("0")}) for side in (q, d)))

    def _met(self, queries: DataFrame, donors: DataFrame) -> DataFrame:
        # Small tables are much work here: with a number of partitions given, they are not put together by their bytes. With more partitions
        # than groups of rows, few of them get several groups, and no core is left with most of the work.
        parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * self.groups, MOST_PARTS))
        queries, donors = (side.repartition(parts, *self.group) for side in (queries, donors))
        return cogroup_apply(queries, donors, self.group, self.block, self.schema)

    def _visit(self, queries: DataFrame, donors: DataFrame, visits: DataFrame) -> DataFrame:
        """The best rows of every query in the blocks that its block visits; both go to the tasks where such blocks meet.

        What must meet reaches a task as rows of ``qblock`` and ``dblock`` alone among its donors.
        """
        told = visits.join(queries.select(*self.keys, "qblock", "qgroup").distinct(), [*self.keys, "qblock"])
        told = self.stage(told.join(donors.select(*self.keys, "dblock", "dgroup").distinct(), [*self.keys, "dblock"]), "visits")
        asked = queries.join(told.select(*self.keys, "qblock", "dgroup").distinct(), [*self.keys, "qblock"])
        given = donors.join(told.select(*self.keys, "dblock", "qgroup").distinct(), [*self.keys, "dblock"])
        pairs = told.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in told.columns else F.col(f.name) for f in given.schema], "qblock")
        return self._met(asked, given.withColumn("qblock", F.lit(None).cast("string")).unionByName(pairs))

    def _bounded(self, queries: DataFrame, donors: DataFrame, sizes: DataFrame, wants, serves: Column | None, whole_blocks: bool) -> DataFrame:
        keys, id_col, stage = self.keys, self.id_col, self.stage
        d, q = boxes.near_blocks(donors, queries, sizes, keys, id_col, stage)
        described = stage(boxes.boxes_of(d, keys, "dblock", serves), "boxes")
        # Blocks that fill a task are groups of their own; small ones go together.
        place = lambda side: F.col(f"{side}block") if whole_blocks else F.pmod(F.xxhash64(f"{side}block"), f"_{side}groups").cast("string")
        d, q = (t.join(sizes.select(*keys, f"_{side}groups"), keys).withColumn(f"{side}group", place(side)).drop(f"_{side}groups") for t, side in ((d, "d"), (q, "q")))
        first = boxes.nearest_boxes(q, described, keys, id_col).groupBy(*keys, "qblock", "dblock").count()
        rank = Window.partitionBy(*keys, "qblock").orderBy(F.desc("count"), "dblock")
        first = first.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= boxes.FIRST_BOXES).select(*keys, "qblock", "dblock")
        first = stage(first, "first-visits")
        found = stage(self._visit(q, d, first), "first-found")
        seen = first.groupBy(*keys, "qblock").agg(F.collect_list("dblock").alias("seen"))  # a few blocks
        asking = q.join(seen, [*keys, "qblock"])
        more = boxes.boxes_within(wants(asking, found), described, keys, id_col, by_block=True).distinct()
        return found.unionByName(self._visit(q, d, stage(more, "more-visits")))


def _to_meet(left: pd.DataFrame, right: pd.DataFrame, id_col: str):
    """(donors in the order of their ids, [(places of queries, places of donors or None for all)]) of one task."""
    pairs = right[right[id_col].isna()] if "qblock" in right and right["qblock"].notna().any() else None
    told = None if pairs is None or not (pairs["qblock"] != "0").any() else pairs
    donors = right if told is None else right[right[id_col].notna()]
    donors = donors.sort_values(id_col, kind="stable").reset_index(drop=True)
    if told is None:
        return donors, [(np.arange(len(left)), None)]
    blocks, meet = donors["dblock"].to_numpy(), []
    places = {b: np.flatnonzero(blocks == b) for b in np.unique(blocks)}
    rows = left.groupby("qblock").indices
    for qblock, listed in told.groupby("qblock")["dblock"]:
        if qblock in rows:
            among = np.sort(np.concatenate([places[b] for b in listed]))
            meet.append((rows[qblock], None if len(among) == len(donors) else among))
    return donors, meet


def _farthest(found: DataFrame, keys: Sequence[str], k: Column, slot: Column) -> DataFrame:
    """keys..., slot, tau: the k-th smallest distance found in the first blocks, without a limit where there are fewer."""
    kth = F.get(F.sort_array(F.collect_list("dist")), F.first(k) - 1)
    return found.groupBy(*keys, slot.alias("slot")).agg(F.coalesce(kth, F.lit(float("inf"))).alias("tau"))


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def nearest_donor_values(
    queries: DataFrame, donors: DataFrame, keys: Sequence[str], k: int, block_rows: int | None = None,
    stage=as_is,
) -> DataFrame:
    """The k nearest donors of every gap: keys..., sample_id, pos, donor_id, dist, value, rank.

    Both sides are (keys..., sample_id, x). A donor counts for a gap only if it has that feature.
    """
    keys = list(keys)
    best = gap_donors(queries, donors, keys, k, block_rows, stage).select(*keys, "sample_id", F.inline(F.arrays_zip(*NEAR)))
    order = Window.partitionBy(*keys, "sample_id", "pos").orderBy("dist", "donor_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gap_donors(
    queries: DataFrame, donors: DataFrame, keys: Sequence[str], k: int, block_rows: int | None = None,
    stage=as_is,
) -> DataFrame:
    """keys..., sample_id, pos, dist, donor_id, value: for every query and group of donors the k nearest of the group for each gap, as arrays."""
    keys = list(keys)
    side = [*keys, "sample_id", "x"]
    kinds = (T.IntegerType(), T.DoubleType(), T.StringType(), T.DoubleType())
    listed = [T.StructField(n, T.ArrayType(t)) for n, t in zip(NEAR, kinds)]
    schema = T.StructType([*_fields(queries, [*keys, "sample_id"]), *listed])

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=schema.names)
        right, meet = _to_meet(left, right, "sample_id")
        values, wanted = _stack(right["x"]), _stack(left["x"])
        tiles, found = Tiles(values), []
        for rows_of, among in meet:
            for start in range(0, len(rows_of), SLICE_ROWS):
                part = rows_of[start:start + SLICE_ROWS]
                found += [(pos, part[row], col, far) for pos, row, col, far in nearest_with_gaps(tiles, wanted[part], k, among)]
        if not found:
            return pd.DataFrame(columns=schema.names)
        pos, row, col, dist = (np.concatenate(part) for part in zip(*found))
        order = np.argsort(row, kind="stable")
        pos, row, col, dist = pos[order], row[order], col[order], np.round(dist[order], DISTANCE_DIGITS)
        own, first = np.unique(row, return_index=True)
        ids = right["sample_id"].to_numpy()
        out = left[[*keys, "sample_id"]].iloc[own].reset_index(drop=True)
        columns = zip(NEAR, (pos.astype("int32"), dist, ids[col], values[col, pos]))
        return out.assign(**{n: pd.Series(np.split(c, first[1:]), dtype=object) for n, c in columns})

    def wants(asking: DataFrame, found: DataFrame) -> DataFrame:
        """Every gap wants donors no farther than the k-th one found; one that has none yet takes any."""
        rows = found.select(*keys, "sample_id", F.inline(F.arrays_zip("pos", "dist")))
        tau = _farthest(rows, [*keys, "sample_id"], F.lit(k), F.col("pos"))
        known = tau.groupBy(*keys, "sample_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "tau"))).alias("_tau"))
        gaps = F.filter(F.transform("x", lambda v, i: F.when(v.isNull(), i)), lambda i: i.isNotNull())
        want = lambda i: F.struct(i.alias("slot"), F.coalesce(F.try_element_at("_tau", i), F.lit(float("inf"))).alias("tau"))
        return asking.join(known, [*keys, "sample_id"], "left").withColumn("wants", F.transform(gaps, want)).drop("_tau")

    return _Search(queries.select(side), donors.select(side), keys, "sample_id", block, schema, stage).run(block_rows, wants)


def merged_fills(near: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """keys..., sample_id, _fills: what ``gap_donors`` found in several groups of donors, merged."""
    groups = F.flatten(F.collect_list(F.arrays_zip(*NEAR)))
    ordered = near.groupBy(*keys, "sample_id").agg(F.sort_array(groups).alias("_near"))
    return ordered.select(*keys, "sample_id", _fills(F.col("_near"), k).alias("_fills"))


def _fills(near: Column, k: int) -> Column:
    """(pos, mean value) of the first k of each position of ``near``, whose entries come in the order of ``NEAR``."""
    first = F.filter(near, lambda e, i: (i < k) | (F.get(near, i - k)["pos"] != e["pos"]))
    value = lambda mine: F.aggregate(mine, F.lit(0.0), lambda a, e: a + e["value"]) / F.size(mine)
    spots = F.array_distinct(F.transform(first, lambda e: e["pos"]))
    return F.transform(spots, lambda p: F.struct(p.alias("pos"), value(F.filter(first, lambda e: e["pos"] == p)).alias("value")))


def knn_impute(
    matrix: Matrix, k: int, block_rows: int | None = None, stage=as_is, views: bool = False
) -> Matrix:
    """Fill gaps with the mean of the k nearest train rows that have the feature; without any, its train mean.

    ``views`` tells that keys which differ in their last part alone hold the same samples, which are sought once for all of them.
    """
    from peaklake.operators.views import gap_fills  # it builds on this module

    keys = list(matrix.keys)
    fills = gap_fills(matrix, k, block_rows, stage, views)
    means = stage(pack(column_stats(matrix, train_rows(), mean=F.avg("value")), matrix.keys, "mean"), "means")
    empty = F.array().cast("array<struct<pos:int,value:double>>")
    seen = F.filter(
        F.transform("x", lambda v, i: F.struct(i.alias("pos"), v.alias("value"))),
        lambda e: e["value"].isNotNull(),
    )
    filled = dense(F.concat(seen, F.coalesce("_fills", empty)), F.size("x"))
    rows = (
        matrix.rows.join(fills, [*keys, "sample_id"], "left")
        .join(means, keys)
        .withColumn("x", F.when(F.col("_fills").isNull(), F.col("x")).otherwise(filled))
        .withColumn("x", F.when(has_gap(F.col("x")), F.zip_with("x", "mean", lambda v, m: F.coalesce(v, m))).otherwise(F.col("x")))
    )
    return matrix.with_rows(rows.drop("_fills", "mean"))


def nearest_rows(
    queries: DataFrame, donors: DataFrame, keys: Sequence[str], k: int, k_kin: int = 0, block_rows: int | None = None,
    stage=as_is, sizes: DataFrame | None = None,
) -> DataFrame:
    """The nearest other rows: keys..., row_id, y, kind, donor_id, donor_y, dist, rank.

    Both sides are (keys..., row_id, y, x) of complete rows; a row is not its own donor. Kind ``all`` lists the k
    nearest donors, kind ``kin`` the ``k_kin`` nearest ones of the query's own class, from the same distances.
    """
    keys = list(keys)
    side = [*keys, "row_id", "y", "x"]
    schema = T.StructType(
        [
            *_fields(queries, [*keys, "row_id"]),
            T.StructField("y", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("donor_id", T.StringType()),
            T.StructField("donor_y", T.IntegerType()),
            T.StructField("dist", T.DoubleType()),
        ]
    )

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=schema.names)
        right, meet = _to_meet(left, right, "row_id")
        ids, own = right["row_id"].to_numpy(), left["row_id"].to_numpy()
        y, own_y = right["y"].to_numpy(), left["y"].to_numpy()
        tiles, wanted = Tiles(_stack(right["x"])), _stack(left["x"])
        at = np.minimum(np.searchsorted(ids.astype(str), own.astype(str)), len(ids) - 1)
        at = np.where(ids[at] == own, at, -2)  # the place of the row itself

        def listed(kind: str, rows_of: np.ndarray, wanted_rows: int, among: np.ndarray | None) -> None:
            for start in range(0, len(rows_of), SLICE_ROWS):
                part = rows_of[start:start + SLICE_ROWS]
                dist, place = tiles.nearest(wanted[part], wanted_rows + 1, among)
                other = (place >= 0) & (place != at[part][:, None])
                row, col = np.nonzero(other & (other.cumsum(axis=1) <= wanted_rows))
                found.append((kind, part[row], place[row, col], dist[row, col]))

        found = []
        for rows_of, among in meet:
            listed("all", rows_of, k, among)
            for c in np.unique(own_y[rows_of]) if k_kin else ():
                kin = np.flatnonzero(y == c) if among is None else among[y[among] == c]
                if kin.size:
                    listed("kin", rows_of[own_y[rows_of] == c], k_kin, kin)
        if not found:
            return pd.DataFrame(columns=schema.names)
        kind = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        row, col, dist = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
        out = left[[*keys, "row_id", "y"]].iloc[row].reset_index(drop=True)
        out = out.assign(kind=kind, donor_id=ids[col], donor_y=y[col].astype("int32"), dist=np.round(dist, DISTANCE_DIGITS))
        return out[schema.names]

    def wants(asking: DataFrame, found: DataFrame) -> DataFrame:
        """Rows no farther than the k-th one found, and kin no farther than the last of its own."""
        kin = F.col("kind") == "kin"
        tau = _farthest(found, [*keys, "row_id"], F.when(kin, k_kin).otherwise(k), F.when(kin, F.col("y") + 1).otherwise(0))
        known = tau.groupBy(*keys, "row_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "tau"))).alias("_tau"))
        slots = F.array(F.lit(0), *([F.col("y") + 1] if k_kin else []))
        want = lambda i: F.struct(i.alias("slot"), F.coalesce(F.try_element_at("_tau", i), F.lit(float("inf"))).alias("tau"))
        return asking.join(known, [*keys, "row_id"], "left").withColumn("wants", F.transform(slots, want)).drop("_tau")

    search = _Search(queries.select(side), donors.select(side), keys, "row_id", block, schema, stage)
    of_class = [F.count_if(F.col("y") == c) for c in (0, 1)]
    best = search.run(block_rows, wants, F.array(F.count(F.lit(1)), *of_class), sizes)
    order = Window.partitionBy(*keys, "row_id", "kind").orderBy("dist", "donor_id")
    wanted = F.when(F.col("kind") == "all", k).otherwise(k_kin)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, k_kin)).where(
        F.col("rank") <= wanted
    )


def danger_and_kin(
    minority: DataFrame, rows: DataFrame, keys: Sequence[str], k: int, m: int, block_rows: int | None = None, stage=as_is
) -> tuple[DataFrame, DataFrame]:
    """(keys..., row_id of the minority rows in danger; keys..., row_id, kin_id, _k: their k nearest minority rows at least).

    Keys that a task holds tell only rows in danger, with their kin, from one set of distances; others of few groups list all
    neighbours. In keys with more, counts in balls settle most rows (``balls``); neighbours are sought only for those left open,
    and kin, among the minority alone, only for rows in danger.
    """
    keys = list(keys)
    stage = Workspace(rows.sparkSession, "smote").stage if stage is as_is else stage
    sizes = stage(_sizes(minority, rows, keys, block_rows), "smote-sizes")
    held = F.col("_dgroups") <= (HELD_GROUPS if block_rows is None else 0)
    own = T.StructType(_fields(rows, keys))
    some = [sizes.where(c).select(*keys).collect() for c in (_wide(block_rows), ~_wide(block_rows) & ~held)]  # keys
    large, middle = (rows.sparkSession.createDataFrame(found, own) if found else None for found in some)
    few, all_ = (_split(_split(side, large, "left_anti"), middle, "left_anti") for side in (minority, rows))
    fills = few.groupBy(*keys).agg(F.array(F.max("y").cast("int")).alias("minority"))
    block = all_.join(fills, keys).select(*keys, "row_id", "y", "x", F.array(F.lit(1)).alias("multiplicity"), "minority")
    told = stage(drawn_danger(block, keys, k, m, (1, 1)), "smote-told")
    danger = told.where(F.col("verdict") == balls.DANGER).select(*keys, "row_id")
    kin = told.select(*keys, "row_id", F.posexplode("kin").alias("_k", "kin_id")).withColumn("_k", F.col("_k") + 1)
    open_ = told.where(F.col("verdict") == balls.OPEN)
    if not open_.isEmpty():  # row_ids that repeat
        found, more = _listed_danger(open_, few, all_, keys, k, m, block_rows, stage)
        danger, kin = danger.unionByName(found), kin.unionByName(more.select(*kin.columns))
    if middle is not None:
        few, all_, known = (side.join(middle, keys, "left_semi") for side in (minority, rows, sizes))
        near = stage(nearest_rows(few, all_, keys, m, k, block_rows, stage, known), "smote-near")
        danger = danger.unionByName(_in_danger(near.where(F.col("kind") == "all"), keys, m))
        kin = kin.unionByName(near.where(F.col("kind") == "kin").select(*keys, "row_id", F.col("rank").alias("_k"), F.col("donor_id").alias("kin_id")))
    if large is not None:
        some, all_ = (side.join(large, keys, "left_semi") for side in (minority, rows))
        told = stage(balls.verdicts(some, balls.balls_of(all_.select(*keys, "row_id", "y", "x"), keys, stage), keys, m), "smote-verdicts")
        open_ = some.join(told.where(F.col("verdict") == balls.OPEN), [*keys, "row_id"], "left_semi")
        counted = _in_danger(nearest_rows(open_, all_, keys, m, 0, block_rows, stage), keys, m)
        sure = told.where(F.col("verdict") == balls.DANGER).select(*keys, "row_id")
        found = stage(counted.unionByName(sure), "smote-large-danger")
        starts = some.join(found, [*keys, "row_id"], "left_semi")
        kin = kin.unionByName(nearest_rows(starts, some, keys, k, 0, block_rows, stage).select(*keys, "row_id", F.col("rank").alias("_k"), F.col("donor_id").alias("kin_id")))
        danger = danger.unionByName(found)
    return danger, (kin if large is None else stage(kin, "smote-kin"))


DRAWN_VALUES = 16_000_000  # rows x features of a key whose draws take their neighbours from one list: a task holds them all
HELD_GROUPS = 2  # groups of donors of a key that one task still holds
DRAWN_LISTS = (3, 6)  # times m (and k) rows of a list, and so many more: a row is drawn once on average


def walk(own: np.ndarray, y: np.ndarray, times: np.ndarray, place: np.ndarray, donor_y: np.ndarray, donor_times: np.ndarray, m: int):
    """(others, known) of the queries in one draw: how many of the first m copies in a list are of the other class.

    ``place`` lists the nearest rows in order, filled up with -1, the query's own row among them; ``times`` tells how often rows
    were drawn. ``known`` is off where the list ends before m copies, or without the own row although that has other copies.
    """
    mine = place == own[:, None]
    copies = np.where(place >= 0, donor_times[place], 0) - mine  # a copy is not its own neighbour
    reached = copies.cumsum(axis=1)
    taken = np.clip(m - (reached - copies), 0, copies)
    others = (taken * (donor_y[place] != y[:, None])).sum(axis=1)
    return others, (reached[:, -1] >= m) & (mine.any(axis=1) | (times == 1))


def kin_of(own: np.ndarray, times: np.ndarray, place: np.ndarray, donor_times: np.ndarray, k: int):
    """(places, known): the rows behind the first k copies of a list, one row per query."""
    mine = place == own[:, None]
    reached = (np.where(place >= 0, donor_times[place], 0) - mine).cumsum(axis=1)
    at = np.stack([(reached < i).sum(axis=1) for i in range(1, k + 1)], axis=1)
    known = (reached[:, -1] >= k) & (mine.any(axis=1) | (times == 1))
    return np.take_along_axis(place, np.minimum(at, place.shape[1] - 1), axis=1), known


def drawn_danger(block: DataFrame, keys: Sequence[str], k: int, m: int, lists: tuple[int, int] = DRAWN_LISTS) -> DataFrame:
    """keys..., _draw, row_id, verdict, kin of the minority rows of every draw that are in danger or left open.

    ``block`` is (keys..., row_id, y, x, multiplicity, minority): each row once, how often each draw took it, and the class that
    each draw fills up, or -1. All draws of a row read one list of its nearest rows. ``kin`` are the row_ids of its k nearest
    minority copies.
    """
    keys = list(keys)
    factor, more = lists
    n = block.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = -(-GROUPS // max(1, n.count()))
    sizes = n.select(*keys, F.least(F.lit(share), F.ceil(F.col("_n") / LEAST_QUERIES)).cast("int").alias("_groups"))
    sized = block.join(sizes, keys)
    left = sized.where(F.array_contains("minority", F.col("y").cast("int"))).select(*keys, "row_id", "minority", F.pmod(F.xxhash64("row_id"), "_groups").cast("int").alias("_group"))
    right = sized.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    right = right.select(*keys, "_group", "row_id", "y", "x", "multiplicity")
    schema = T.StructType([
        *_fields(block, keys), T.StructField("_draw", T.IntegerType()), T.StructField("row_id", T.StringType()),
        T.StructField("verdict", T.StringType()), T.StructField("kin", T.ArrayType(T.StringType())),
    ])

    def run(key: tuple, asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or rows.empty:
            return pd.DataFrame(columns=schema.names)
        rows = rows.assign(_sign=rows["row_id"] + "#").sort_values("_sign", kind="stable")  # as copies sort
        ids, y, times = rows["row_id"].to_numpy(), rows["y"].to_numpy(), np.vstack(rows["multiplicity"].to_list()).astype(np.int32)
        minority, out = np.asarray(asking["minority"].iloc[0]), []
        if not rows["row_id"].is_unique or rows["row_id"].hasnans:  # a list of places does not tell such rows apart
            for r in np.unique(np.flatnonzero(minority >= 0)):
                left_open = rows["row_id"][(times[:, r] > 0) & (y == minority[r])]
                left_open = left_open[left_open.isin(asking["row_id"])].unique()
                out.append(pd.DataFrame({"_draw": int(r), "row_id": left_open, "verdict": balls.OPEN, "kin": None}))
            return pd.concat(out, ignore_index=True).assign(**dict(zip(keys, key)))[schema.names]
        tiles = Tiles(_stack(rows["x"]))
        places = np.flatnonzero(rows["row_id"].isin(asking["row_id"]))
        for c in np.unique(y[places]):
            drawn = np.flatnonzero(minority == c)
            kin, mine = np.flatnonzero(y == c), places[(y[places] == c)]
            mine = mine[(times[np.ix_(mine, drawn)] > 0).any(axis=1)] if drawn.size else mine[:0]
            for start in range(0, len(mine), SLICE_ROWS):
                part = mine[start:start + SLICE_ROWS]
                _, near = tiles.nearest(tiles.values[part], min(factor * m + more, len(ids)))
                _, same = tiles.nearest(tiles.values[part], min(factor * k + more, len(kin)), kin)
                for r in drawn:
                    use = times[part, r] > 0
                    own, own_y = part[use], y[part[use]]
                    others, known = walk(own, own_y, times[own, r], near[use], y, times[:, r], m)
                    ends, found = kin_of(own, times[own, r], same[use], times[:, r], k)
                    danger = known & found & (2 * others >= m) & (others < m)
                    open_ = ~known | (~found & (2 * others >= m) & (others < m))
                    keep = danger | open_
                    if not keep.any():
                        continue
                    listed = [list(ids[e]) if d else None for e, d in zip(ends[keep], danger[keep])]
                    verdict = np.where(danger[keep], balls.DANGER, balls.OPEN)
                    out.append(pd.DataFrame({"_draw": int(r), "row_id": ids[own[keep]], "verdict": verdict, "kin": listed}))
        if not out:
            return pd.DataFrame(columns=schema.names)
        return pd.concat(out, ignore_index=True).assign(**dict(zip(keys, key)))[schema.names]

    parts = int(block.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as in ``_Search``: much work on few bytes
    left, right = (side.repartition(parts, *keys, "_group") for side in (left, right))
    return cogroup_apply(left, right, [*keys, "_group"], run, schema)


def danger_and_kin_of_draws(
    minority: DataFrame, rows: DataFrame, block: DataFrame, keys: Sequence[str], k: int, m: int, block_rows: int | None = None, stage=as_is
) -> tuple[DataFrame, DataFrame]:
    """``danger_and_kin`` of rows that are copies, named id#number, of the rows of ``block`` (see ``drawn_danger``).

    ``keys`` ends with the number of the draw. Rows that the lists leave open are sought among the copies themselves.
    """
    *base, draw = keys
    origin = F.regexp_replace("row_id", "#[0-9]+$", "")
    told = stage(drawn_danger(block, base, k, m).withColumnRenamed("_draw", draw), "draw-danger")
    copies = minority.select(*keys, "row_id", origin.alias("_origin"))
    mine = copies.join(told.withColumnRenamed("row_id", "_origin"), [*keys, "_origin"])
    sure = mine.where(F.col("verdict") == balls.DANGER)
    # Any copy of a row will do as an end: all have the same values.
    ends = copies.groupBy(*keys, F.col("_origin").alias("_end")).agg(F.min("row_id").alias("kin_id"))
    kin = sure.select(*keys, "row_id", F.posexplode("kin").alias("_k", "_end")).withColumn("_k", F.col("_k") + 1)
    danger, kin = sure.select(*keys, "row_id"), kin.join(ends, [*keys, "_end"]).select(*keys, "row_id", "kin_id", "_k")
    if told.where(F.col("verdict") == balls.OPEN).isEmpty():
        return danger, kin
    found, more = _listed_danger(mine.where(F.col("verdict") == balls.OPEN), minority, rows, keys, k, m, block_rows, stage)
    return danger.unionByName(found), kin.unionByName(more)


def _listed_danger(open_: DataFrame, minority: DataFrame, rows: DataFrame, keys: list[str], k: int, m: int, block_rows, stage):
    """(danger, kin) of the minority rows named in ``open_``, from lists of all their neighbours."""
    asked = stage(minority.join(open_.select(*keys, "row_id"), [*keys, "row_id"], "left_semi"), "smote-open")
    near = stage(nearest_rows(asked, rows, keys, m, k, block_rows, stage), "smote-listed")
    kin = near.where(F.col("kind") == "kin").select(*keys, "row_id", F.col("donor_id").alias("kin_id"), F.col("rank").alias("_k"))
    return _in_danger(near.where(F.col("kind") == "all"), keys, m), kin


def _draw_block(drawn: DataFrame, rows: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``drawn`` (row_id, y, x of the rows behind the copies ``rows``) with how often each draw holds them and which class it fills up."""
    *base, draw = keys
    last = rows.agg(F.max(draw)).first()[0]
    numbers = F.sequence(F.lit(0), F.lit(last))
    listed = lambda c, default: F.transform(numbers, lambda r: F.coalesce(F.try_element_at(c, r), F.lit(default)).cast("int"))
    times = rows.groupBy(*keys, F.regexp_replace("row_id", "#[0-9]+$", "").alias("row_id")).agg(F.count(F.lit(1)).cast("int").alias("_m"))
    times = times.groupBy(*base, "row_id").agg(F.map_from_entries(F.collect_list(F.struct(draw, "_m"))).alias("_times"))
    fills = counts.groupBy(*base).agg(F.map_from_entries(F.collect_list(F.struct(draw, "minority"))).alias("_fills"))
    return drawn.join(times, [*base, "row_id"]).join(fills, base).select(
        *base, "row_id", "y", "x", listed("_times", 0).alias("multiplicity"), listed("_fills", -1).alias("minority")
    )


def _split(side: DataFrame, large: DataFrame | None, how: str) -> DataFrame:
    return side if large is None else side.join(large, large.columns, how)


def _in_danger(near: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    """keys..., row_id: at least half, but not all, of the m nearest rows are of the other class."""
    others = near.groupBy(*keys, "row_id").agg(F.count_if(F.col("donor_y") != F.col("y")).alias("_other"))
    return others.where((F.col("_other") * 2 >= m) & (F.col("_other") < m)).select(*keys, "row_id")


DRAWS_PER_CHUNK = 10_000


def borderline_smote(
    rows: DataFrame,
    keys: Sequence[str],
    k: int = 5,
    m: int = 10,
    strategy: str | float | dict = "auto",
    seed: int = 42,
    block_rows: int | None = None,
    stage=as_is,
    drawn: DataFrame | None = None,
    alike: DataFrame | None = None,
) -> DataFrame:
    """Synthetic minority rows near the border: keys..., row_id, y, x (the new rows only).

    A minority row is in danger if at least half, but not all, of its m nearest rows are of the other class. A
    synthetic row lies between a danger row and one of its k nearest minority rows. ``auto`` makes both classes
    equally large; a float is the wanted minority/majority ratio, a dict gives the wanted rows per class. Keys
    without a danger row get nothing; too few rows for k or m is an error.

    ``drawn`` (keys but the last, row_id, y, x) says that ``rows`` are copies of its rows, named id#number, and the last key the
    number of the draw. ``alike`` (keys..., _as) says that a key holds the same rows as the one whose last key is ``_as``. Both
    only spare searches.
    """
    keys = list(keys)
    counts = class_counts(rows, keys).withColumn("_new", _synthetic_count(strategy)).where(F.col("_new") > 0)
    short = (F.col("n_min") <= k) | (F.col("n_min") + F.col("n_maj") <= m)
    error = F.raise_error(F.lit(f"too few rows for {k} minority and {m} overall neighbours"))
    counts = counts.withColumn("_new", F.when(short, error).otherwise(F.col("_new")))
    counts = stage(counts.select(*keys, "minority", "_new"), "smote-counts")
    minority = rows.join(counts.select(*keys, F.col("minority").alias("y")), [*keys, "y"])
    if drawn is not None:
        danger, kin = _neighbours_of_draws(minority, rows, drawn, counts, keys, k, m, block_rows, stage)
    elif alike is not None:
        first = alike.where(F.col(keys[-1]) == F.col("_as")).select(*keys)
        found = danger_and_kin(*(side.join(first, keys, "left_semi") for side in (minority, rows)), keys, k, m, block_rows, stage)
        danger, kin = (side.withColumnRenamed(keys[-1], "_as").join(alike, [*keys[:-1], "_as"]).drop("_as") for side in found)
    else:
        danger, kin = danger_and_kin(minority, rows, keys, k, m, block_rows, stage)
    ranked = hash_rank(danger.withColumn("_h", draw_key(seed, F.col("row_id"))), keys, "_h", "row_id", name="_d")
    ranked = stage(ranked.select(*keys, "row_id", "_d"), "smote-danger")
    per_key = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_danger")).join(counts, keys)
    # Two steps, so that a large key is not unrolled by one task.
    last = ((F.col("_new") - 1) / DRAWS_PER_CHUNK).cast("int")
    chunks = per_key.withColumn("_chunk", F.explode(F.sequence(F.lit(0), last))).repartition(*keys, "_chunk")
    first = F.col("_chunk") * DRAWS_PER_CHUNK
    draws = chunks.withColumn(
        "_g", F.explode(F.sequence(first, F.least(first + DRAWS_PER_CHUNK, F.col("_new").cast("int")) - 1))
    )
    named = [seed, *[F.col(c) for c in keys], F.col("_g")]
    draws = draws.select(
        *keys,
        F.col("minority").cast("int").alias("y"),
        "_g",
        (F.pmod(draw_int(*named, "row"), F.col("_n_danger")) + 1).alias("_d"),
        (F.pmod(draw_int(*named, "kin"), F.lit(k)) + 1).alias("_k"),
        draw_unit(*named, "gap").alias("_u"),
    )
    starts = rows.select(*keys, "row_id", "x")
    ends = rows.select(*keys, F.col("row_id").alias("kin_id"), F.col("x").alias("_end"))
    made = (
        draws.join(ranked, [*keys, "_d"]).join(kin, [*keys, "row_id", "_k"])
        .join(starts, [*keys, "row_id"]).join(ends, [*keys, "kin_id"])
    )
    x = F.transform(F.arrays_zip("x", "_end"), lambda c: c["x"] + F.col("_u") * (c["_end"] - c["x"]))
    return made.select(*keys, F.concat(F.lit("synthetic-"), F.col("_g")).alias("row_id"), "y", x.alias("x"))


def _neighbours_of_draws(minority, rows, drawn, counts, keys, k, m, block_rows, stage) -> tuple[DataFrame, DataFrame]:
    """Keys whose rows fit a task read lists of the rows behind the copies; larger ones search the copies of every draw."""
    base = keys[:-1]
    size = drawn.groupBy(*base).agg((F.count(F.lit(1)) * F.max(F.size("x"))).alias("_values"))
    found = size.where(F.col("_values") > DRAWN_VALUES).select(*base).collect()  # keys
    large = drawn.sparkSession.createDataFrame(found, T.StructType(_fields(drawn, base))) if found else None
    few, small = (_split(side, large, "left_anti") for side in (minority, rows))
    block = stage(_draw_block(_split(drawn, large, "left_anti"), small, counts, keys), "draw-block")
    danger, kin = danger_and_kin_of_draws(few, small, block, keys, k, m, block_rows, stage)
    if large is not None:
        more = danger_and_kin(*(side.join(large, base, "left_semi") for side in (minority, rows)), keys, k, m, block_rows, stage)
        danger, kin = (a.unionByName(b.select(*a.columns)) for a, b in zip((danger, kin), more))
    return danger, kin


def _synthetic_count(strategy: str | float | dict) -> Column:
    if isinstance(strategy, dict):
        wanted = F.lit(None).cast("bigint")
        for label, size in strategy.items():
            wanted = F.when(F.col("minority") == label, F.lit(size)).otherwise(wanted)
        return F.coalesce(wanted - F.col("n_min"), F.lit(0))
    if isinstance(strategy, (int, float)):
        return F.floor(F.col("n_maj") * F.lit(float(strategy))) - F.col("n_min")
    return F.col("n_maj") - F.col("n_min")


def resample(
    rows: DataFrame, keys: Sequence[str], under_sample: bool, smote: bool, seed: int = 42, *,
    target_ratio: float | None = 5.0, under_sample_strategy: str | float | dict = "auto",
    smote_strategy: str | float | dict = "auto", k: int = 5, m: int = 10, stage=as_is,
    drawn: DataFrame | None = None, alike: DataFrame | None = None,
) -> DataFrame:
    """Under-sample, then add synthetic rows: keys..., row_id, y, x. Both steps are optional; pass staged rows.

    ``drawn`` and ``alike`` are those of ``borderline_smote``.
    """
    out = whole = rows.select(*keys, "row_id", "y", "x")
    if under_sample:
        out = random_under_sample(
            out, keys, target_ratio, under_sample_strategy, seed, id_col="row_id", stage=stage
        )
        if out is not whole:  # draws of equal keys differ
            out, alike = out.select(*keys, "row_id", "y", "x"), None
    if smote:
        out = out.unionByName(borderline_smote(out, keys, k, m, smote_strategy, seed, stage=stage, drawn=drawn, alike=alike))
    return out
