"""Operator 13: hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Vectors are scaled to integers and put in the order of a Hilbert curve through all dimensions, so that near vectors lie
near each other. Runs of ``block_rows`` of them become the rows of a Parquet table of candidate blocks, each with a zone
map: the least and greatest value of every dimension and of the labels. For an anchor, interval arithmetic turns a zone
map into bounds of its inner products with the whole block; only blocks whose bounds meet what the anchor still needs are
read:

* positives: blocks that may hold its label and reach the score of the last positive found in the anchor's own block;
* negatives: blocks that may hold another label and whose bounds meet one of the anchor's windows, the scores
  from ``low`` to ``high`` percent of a positive's.

Anchors are a given query set and stay in groups of bounded size beside their block. Groups meet pages of zone maps (a two
thousandth of the data) on the page number, and chosen pairs (group, block) meet the blocks in a shuffled join on the block. A
pair is one matrix product, of which at most the wanted rows per anchor and window come out; a ranked merge follows, whose
limit Spark applies before its shuffle. Nothing is collected, and pairs of vectors never become rows.

Scores are integers and exact: products run in doubles while all sums stay below 2**53, else in 64-bit integers.

Defined results: rows with a null id, label or vector, a null or non-finite component, or a scaled component of 2**28 or
more in size take no part; a shorter vector counts as if zeros followed; equal scores rank by the smaller id; of repeated rows
each is an anchor and a candidate of its own, and only a row itself is left out of its positives; windows without
integers give no rows; anchors without positives give none; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peaklake.llm.common import workspace

LIMIT = 1 << 28
BITS = 4  # bits of a coordinate on the curve
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Rule:
    """How many positives and negatives, and the window of a negative in percent of the positive's score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    block_rows: int = 2048
    group_rows: int = 512
    page_zones: int = 256


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of small unsigned coordinates on a Hilbert curve, as rows of big-endian bytes."""
    x = x.astype(np.uint32).copy()
    n, dims = x.shape
    if dims == 0:
        return np.zeros((n, 0), np.uint8)
    first = x[:, 0]
    for level in range(bits - 1, 0, -1):  # undo the turns of the sub-cubes, from the largest down
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(dims):
            here = (x[:, i] & bit) != 0
            swap = np.where(here, 0, (first ^ x[:, i]) & low).astype(np.uint32)
            first ^= np.where(here, low, swap).astype(np.uint32)
            if i:
                x[:, i] ^= swap
    np.bitwise_xor.accumulate(x, axis=1, out=x)  # Gray code
    turn = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> level) & 1, np.uint32((1 << level) - 1), np.uint32(0)).astype(np.uint32)
    x ^= turn[:, None]
    planes = (x[:, None, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[None, :, None]) & 1
    return np.packbits(planes.reshape(n, bits * dims).astype(np.uint8), axis=1)


def as_matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column, with zeros behind the shorter ones."""
    cuts = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]]
    sizes = np.diff(cuts)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(cuts[:-1] - cuts[0], sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each row of ``a`` with anything in each box, widened by rounding."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1e-12 * (np.abs(up) @ np.maximum(np.abs(low), np.abs(high)).T + np.abs(down) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, most + slack


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of every row; of equal ones the first columns."""
    left, rows, cols = allowed.copy(), [], []
    for _ in range(min(k, scores.shape[1])):
        some = np.flatnonzero(left.any(axis=1))
        if not some.size:
            break
        low = scores.min() - 1
        top = np.where(left[some], scores[some], low).argmax(axis=1)
        rows.append(some)
        cols.append(top)
        left[some, top] = False
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(cols or [none])


def integers(vectors: DataFrame, anchors: Column, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, anchor, v) of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    whole = F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(F.lit(float(scale)) * e.cast("double")) < LIMIT))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & whole)
    return rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), anchors.alias("anchor"), x.cast("array<int>").alias("v")
    )


BLOCK = "block bigint, ids binary, labels binary, vectors binary, low binary, high binary, least bigint, greatest bigint, a_ids binary, a_at binary, a_vectors binary, a_labels binary, a_need binary"
GROUP = "grp bigint, a_ids binary, a_block binary, a_at binary, a_vectors binary, a_labels binary, a_need binary"
KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _ints(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int64)


def _vectors(value: pa.Scalar, dims: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32).reshape(-1, dims) if dims else np.zeros((0, 0), np.int32)


class Miner:
    """Candidate blocks and anchor groups of one table of vectors, staged."""

    def __init__(self, vectors: DataFrame, anchors: Column, rule: Rule = Rule(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"):
        self.rule, self.work = rule, workspace(vectors.sparkSession, "hard-negatives")
        rows = integers(vectors, anchors, id_col, vec_col, label_col, rule.scale)
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
        self.n, self.dims = found["n"], found["dims"] or 0
        self.blocks = self.work.stage(self._blocks(self._on_curve(rows, found["low"] or 0, found["high"] or 0)), "blocks")
        self.groups = self.work.stage(self._groups(), "groups")
        self.pages = self.work.stage(self._pages(), "pages")
        self.n_pages = self.pages.count()

    def _on_curve(self, rows: DataFrame, low: int, high: int) -> DataFrame:
        """The rows with their place on the curve, staged: the range of each task is then sampled from files."""
        dims, step = self.dims, (high - low) / (1 << BITS) + 1e-9

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = as_matrix(batch.column("v"), dims)
                cells = np.minimum((v - low) / step, (1 << BITS) - 1)
                keys = hilbert_keys(cells)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], [*batch.schema.names, "key"])

        return self.work.stage(rows.mapInArrow(run, "id bigint, label bigint, anchor boolean, v array<int>, key binary"), "curve")

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """One row per block: its vectors in the order of their ids, its zone map, and its anchors with the score that their last positive has at least."""
        dims, rule = self.dims, self.rule
        parts = max(1, -(-self.n // (2 * rule.block_rows)))
        ordered = rows.repartitionByRange(parts, "label", "key", "id").sortWithinPartitions("label", "key", "id")

        def pack(number: int, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, v: np.ndarray) -> tuple:
            order = np.argsort(ids, kind="stable")
            ids, labels, anchor, v = ids[order], labels[order], anchor[order], v[order]
            at = np.flatnonzero(anchor)
            need = np.full(len(at), np.iinfo(np.int64).min)
            if len(at) and len(ids) > rule.positives:
                for a in range(0, len(at), rule.group_rows):
                    part = at[a : a + rule.group_rows]
                    scores = products(v[part], v).astype(np.int64)
                    allowed = labels[part][:, None] == labels
                    allowed[np.arange(len(part)), part] = False
                    sure = np.flatnonzero(allowed.sum(axis=1) >= rule.positives)
                    worst = np.where(allowed[sure], scores[sure], np.iinfo(np.int64).min)
                    need[a + sure] = np.partition(worst, -rule.positives, axis=1)[:, -rule.positives]
            low, high = (v.min(axis=0), v.max(axis=0)) if dims else (np.zeros(0), np.zeros(0))
            block = (TaskContext.get().partitionId() << 32) + number
            arrays = [ids, labels, v.astype(np.int32), low.astype(np.int64), high.astype(np.int64)]
            mine = [ids[at], at.astype(np.int64), v[at].astype(np.int32), labels[at], need]
            return (block, *[x.tobytes() for x in arrays], int(labels.min()), int(labels.max()), *[x.tobytes() for x in mine])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held = 0, None
            for batch in batches:
                new = (batch.column("id").to_numpy(), batch.column("label").to_numpy(), batch.column("anchor").fill_null(False).to_numpy(zero_copy_only=False), as_matrix(batch.column("v"), dims))
                held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
                while len(held[0]) >= rule.block_rows:
                    yield _batch(BLOCK, [pack(number, *[p[: rule.block_rows] for p in held])])
                    number, held = number + 1, tuple(p[rule.block_rows :] for p in held)
            if held is not None and len(held[0]):
                yield _batch(BLOCK, [pack(number, *held)])

        return ordered.mapInArrow(run, BLOCK)

    def _groups(self) -> DataFrame:
        """The anchors of neighbouring blocks, at most ``group_rows`` together."""
        dims, rule = self.dims, self.rule

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held, count = 0, [], 0

            def flush() -> pa.RecordBatch:
                grp = (TaskContext.get().partitionId() << 32) + number
                return _batch(GROUP, [(grp, *[np.concatenate(p).tobytes() for p in zip(*held, strict=True)])])

            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    ids, at, labels, need = (_ints(row[c]) for c in ("a_ids", "a_at", "a_labels", "a_need"))
                    v, block = _vectors(row["a_vectors"], dims), np.full(len(ids), row["block"].as_py(), np.int64)
                    start = 0
                    while start < len(ids):
                        end = min(len(ids), start + rule.group_rows - count)
                        held.append(tuple(x[start:end] for x in (ids, block, at, v, labels, need)))
                        count, start = count + end - start, end
                        if count == rule.group_rows:
                            yield flush()
                            number, held, count = number + 1, [], 0
            if count:
                yield flush()

        return self.blocks.select("block", "a_ids", "a_at", "a_vectors", "a_labels", "a_need").mapInArrow(run, GROUP)

    def _pages(self) -> DataFrame:
        """Zone maps, ``page_zones`` in a row, numbered from 0."""
        zones, size = self.blocks.select("block", "low", "high", "least", "greatest"), self.rule.page_zones
        packed = "page bigint, blocks binary, low binary, high binary, least binary, greatest binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = 0
            for batch in batches:
                for a in range(0, batch.num_rows, size):
                    part = batch.slice(a, size)
                    joined = [np.asarray(part.column(c).to_numpy(), np.int64).tobytes() for c in ("block", "least", "greatest")]
                    boxes = [b"".join(part.column(c).to_pylist()) for c in ("low", "high")]
                    yield _batch(packed, [((TaskContext.get().partitionId() << 32) + number, joined[0], *boxes, *joined[1:])])
                    number += 1

        return zones.mapInArrow(run, packed)

    def pairs(self, wanted: DataFrame, chooses, name: str) -> DataFrame:
        """(grp, block) of the blocks that a group must read, staged.

        ``wanted`` has the groups and whatever else ``chooses`` needs; that gets the row, the bounds of its anchors with
        the zones of a page and the zones' labels, and tells which (anchor, zone) need to meet.
        """
        dims, buckets = self.dims, max(1, self.n_pages)
        pages = self.pages.withColumn("bucket", F.pmod(F.xxhash64("page"), F.lit(buckets)).cast("int"))
        groups = wanted.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
        both = groups.join(pages, "bucket").drop("bucket")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    blocks, least, greatest = (_ints(row[c]) for c in ("blocks", "least", "greatest"))
                    low, high = (_ints(row[c]).reshape(len(blocks), dims) for c in ("low", "high"))
                    lower, upper = bounds(_vectors(row["a_vectors"], dims), low, high)
                    need = chooses(row, lower, upper, least, greatest).any(axis=0)
                    yield _batch("grp bigint, block bigint", [(row["grp"].as_py(), b) for b in blocks[need].tolist()])

        return self.work.stage(both.mapInArrow(run, "grp bigint, block bigint"), name)

    def positives(self) -> DataFrame:
        """(grp, at, anchor_id, p, positive_id, positive_score): the first positives of every anchor, numbered from 1; staged."""
        dims, k = self.dims, self.rule.positives

        def chooses(row, lower, upper, least, greatest) -> np.ndarray:
            labels, need = _ints(row["a_labels"])[:, None], _ints(row["a_need"])[:, None].astype(np.float64)
            return (least <= labels) & (labels <= greatest) & (upper >= need)

        pairs = self.pairs(self.groups, chooses, "positive-pairs")
        schema = "grp bigint, at int, anchor_id bigint, positive_id bigint, positive_score bigint"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    ids, own = _ints(row["ids"]), _ints(row["a_ids"])
                    scores = products(_vectors(row["a_vectors"], dims), _vectors(row["vectors"], dims))
                    allowed = (_ints(row["a_labels"])[:, None] == _ints(row["labels"])) & (scores >= _ints(row["a_need"])[:, None])
                    here = np.flatnonzero(_ints(row["a_block"]) == row["block"].as_py())
                    allowed[here, _ints(row["a_at"])[here]] = False
                    at, col = best(scores, allowed, k)
                    arrays = [np.full(len(at), row["grp"].as_py()), at.astype(np.int32), own[at], ids[col], scores[at, col].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [f.split()[0] for f in schema.split(", ")])

        met = pairs.join(self.groups, "grp").join(self.blocks.select("block", "ids", "labels", "vectors"), "block")
        return self.work.stage(self._first(met.mapInArrow(run, schema), ["grp", "at"], "positive_score", "positive_id", k, "p"), "positives")

    @staticmethod
    def _first(found: DataFrame, keys: list[str], score: str, name: str, k: int, rank: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
        return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)

    def negatives(self, positives: DataFrame) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
        dims, rule = self.dims, self.rule
        listed = positives.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("at", "p", "positive_id", "positive_score"))).alias("w"))
        columns = [F.col(f"w.{c}").alias(f"w_{c}") for c in ("at", "p", "positive_id", "positive_score")]
        wanted = self.work.stage(self.groups.drop("a_need").join(listed, "grp").select("*", *columns).drop("w"), "windows")

        def windows(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(anchor, least, greatest score) of every window; scores are whole numbers."""
            score = np.array(row["w_positive_score"].values, np.int64)
            return np.array(row["w_at"].values, np.int64), -(-rule.low * score // 100), rule.high * score // 100

        def chooses(row, lower, upper, least, greatest) -> np.ndarray:
            at, low, high = windows(row)
            labels = _ints(row["a_labels"])[at][:, None]
            other = (least != labels) | (greatest != labels)
            return other & (low <= high)[:, None] & (upper[at] >= low[:, None]) & (lower[at] <= high[:, None])

        pairs = self.pairs(wanted, chooses, "negative-pairs")
        schema = "grp bigint, at int, p int, anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    ids, own, (at, low, high) = _ints(row["ids"]), _ints(row["a_ids"]), windows(row)
                    scores = products(_vectors(row["a_vectors"], dims), _vectors(row["vectors"], dims))
                    other = _ints(row["a_labels"])[:, None] != _ints(row["labels"])
                    for a in range(0, len(at), rule.group_rows):
                        part = slice(a, a + rule.group_rows)
                        mine = scores[at[part]]
                        w, col = best(mine, other[at[part]] & (mine >= low[part, None]) & (mine <= high[part, None]), rule.negatives)
                        found = mine[w, col].astype(np.int64)
                        w += a
                        named = [np.array(row[f"w_{c}"].values, np.int64)[w] for c in ("p", "positive_id", "positive_score")]
                        arrays = [np.full(len(w), row["grp"].as_py()), at[w].astype(np.int32), named[0].astype(np.int32), own[at[w]], named[1], ids[col], named[2], found]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [f.split()[0] for f in schema.split(", ")])

        met = pairs.join(wanted, "grp").join(self.blocks.select("block", "ids", "labels", "vectors"), "block")
        found = self.work.stage(met.mapInArrow(run, schema), "found")
        ranked = self._first(found, ["grp", "at", "p"], "negative_score", "negative_id", rule.negatives, "rank")
        return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, anchors: Column, rule: Rule = Rule(), **names) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds."""
    miner = Miner(vectors, anchors, rule, **names)
    return miner.negatives(miner.positives())


def contract_rows(vectors: DataFrame) -> DataFrame:
    """The rows of ``embeddings`` with every seventh label moved on by one."""
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))


def oracle_sql(rule: Rule = Rule()) -> str:
    scaled = f"{rule.scale} * x::DOUBLE"
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_resize([floor({scaled}) FOR x IN embedding], (SELECT coalesce(max(len(embedding)), 0) FROM embeddings), 0.0) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x) OR abs({scaled}) >= {LIMIT}]) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same,
    coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.e, b.e)]), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT * FROM (SELECT a, other_id, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) AS p FROM scored WHERE same)
  WHERE p <= {rule.positives}),
neg AS (
  SELECT s.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.other_id) AS rank
  FROM scored s JOIN pos p USING (a)
  WHERE NOT s.same AND {rule.low} * p.score <= 100 * s.score AND 100 * s.score <= {rule.high} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {rule.negatives}"""
