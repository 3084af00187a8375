"""Operator 5: near-duplicate join of word-shingle sets by rare-first prefix filtering.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least 80/100. The steps:

1. *Classes.* Documents with equal sets are one class (128-bit order-free set hash); only one text of each goes on.
2. *Pruning.* A class of n shingles has at most a = n - ceil(0.8 n) shingles outside any partner. A fixed hash sample of
   all shingles tells how many of a class's s sampled shingles occur in another class; fewer than s - a, and it has no
   partner. Postings travel packed, each task sends a shingle once, so a passage in a third of all documents costs one
   posting per task.
3. *Rare-first prefixes* of the survivors: exact document frequencies, shingles by rising frequency, the first
   n - ceil(0.8 n) + 1 of them. Shingles of one class alone come first and cannot match, so only the rest are written.
4. *Candidates* share a prefix shingle and pass the length filter; the positional filter bounds their overlap by what
   follows their first common shingle, the suffix filter by the sizes of the parts between fixed pivots; the rest are
   verified once per pair on whole sets. First every class is verified with one hub of its lists; what then is in one
   component needs no further pairs. After that, classes outside the main component of a list meet the list's others.
5. *Components* by contracting every node into its smallest neighbour.

Shingles are compared by 64-bit hashes. Defined results: a null or empty text, or one of white space, has no shingles
and links with nothing; null ids never name a component unless there is no other; documents that share an id are
judged by their texts; repeated rows are copies; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from peaklake.llm.common import arrow_rows, broadcast_if_small, text_or_empty, workspace
from peaklake.llm.wordhash import in_batches, mix, shingle_hashes, word_hashes

PERCENT = 80
SAMPLE_EIGHTHS = 3
BUCKET_POSTINGS = 500_000
U = np.uint64
_SECOND = U(0x8EBC6AF09C88C6E3)
_POSTING = 13  # bytes: 40 bits of the shingle hash, 64 of the class
_MANY = U(0)  # stands for "several classes" in a posting
_PIVOTS = 64


def least_overlap(n: Column | int):
    """ceil(0.8 n): shingles that a set of n has in common with any partner."""
    if isinstance(n, Column):
        return F.floor((n * PERCENT + 99) / 100).cast("bigint")
    return (n * PERCENT + 99) // 100


class Sets:
    """Distinct shingles of a few texts: ``hashes`` sorted within each text, ``first`` position of each text."""

    def __init__(self, texts: list[str]):
        words, at = word_hashes(texts)
        raw, first = shingle_hashes(words, at)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        order = np.argsort(raw)
        order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
        hashes, owner = raw[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = hashes[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.sampled = (self.hashes & U(7)) < U(SAMPLE_EIGHTHS)
        totals = []
        for salt in (U(0), _SECOND):
            sums = np.zeros(len(self.hashes) + 1, U)
            np.cumsum(mix(self.hashes ^ salt), out=sums[1:])
            totals.append(mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(U)))
        self.cls, self.check = totals


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for low, high in in_batches(texts):
            sets = Sets(texts[low:high])
            s = np.bincount(sets.owner[sets.sampled], minlength=high - low)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(low, high - low) for c in (0, 2)), pa.array(sets.sizes), pa.array(s), _signed(sets.cls), _signed(sets.check)],
                ["id", "x", "n", "s", "cls", "chk"],
            )


def _pack(hashes: np.ndarray, cls: np.ndarray) -> np.ndarray:
    out = np.empty((len(hashes), _POSTING), np.uint8)
    out[:, :5] = np.ascontiguousarray(hashes >> U(3)).view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5:] = np.ascontiguousarray(cls).view(np.uint8).reshape(-1, 8)
    return out


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(blob, np.uint8).reshape(-1, _POSTING)
    hashes = np.zeros((len(rows), 8), np.uint8)
    hashes[:, :5] = rows[:, :5]
    return hashes.view(U).ravel(), np.ascontiguousarray(rows[:, 5:]).view(U).ravel()


def _postings(buckets: int):
    """Sampled shingles as packed postings by bucket; classes of shingles already known as shared are credited here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cls, seen, held = [], [], set(), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in in_batches(texts):
                sets = Sets(texts[low:high])
                fresh = np.array([c not in seen and not seen.add(c) for c in sets.cls.tolist()])
                take = sets.sampled & fresh[sets.owner]
                hashes.append(sets.hashes[take])
                cls.append(sets.cls[sets.owner[take]])
                held += len(hashes[-1])
            if held > BUCKET_POSTINGS:
                yield from packed(hashes, cls)
                hashes, cls, seen, held = [], [], set(), 0
        if held:
            yield from packed(hashes, cls)

    def packed(hashes: list[np.ndarray], cls: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, c = np.concatenate(hashes), np.concatenate(cls)
        order = np.argsort(h)
        h, c = h[order], c[order]
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(begin, len(h)))
        shared = np.repeat(count > 1, count)
        owners, credits = np.unique(c[shared], return_counts=True)
        h, c = h[begin], np.where(count > 1, _MANY, c[begin])
        bucket = ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)  # rises with h
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = _pack(h, c)
        full = np.flatnonzero(np.diff(cuts))
        blobs = [rows[cuts[b] : cuts[b + 1]].tobytes() for b in full]
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.nulls(len(full), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "part", "blob"]
        )
        if len(owners):
            of, data = _credit_blobs(owners, credits, buckets)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(of), pa.int32()), of, data], ["bucket", "part", "blob"])

    return run


_CREDIT = np.dtype([("cls", "<u8"), ("credit", "<i8")])


def _credit_blobs(owners: np.ndarray, credits: np.ndarray, parts: int) -> tuple[pa.Array, pa.Array]:
    """Credits of sorted classes, packed by range of class."""
    rows = np.empty(len(owners), _CREDIT)
    rows["cls"], rows["credit"] = owners, credits
    part = ((owners >> U(32)) * U(parts) >> U(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pa.array(full.astype(np.int32)), pa.array([rows[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())


def _summed(group: pa.Table) -> pa.Table:
    """Credits of the classes of one range over all buckets."""
    rows = np.frombuffer(b"".join(group.column("blob").to_pylist()), _CREDIT)
    owners, at = np.unique(rows["cls"], return_inverse=True)
    return pa.table({"cls": _signed(owners), "credit": pa.array(np.bincount(at, rows["credit"]).astype(np.int64))})


def _credits(parts: int):
    return lambda group: _bucket_credits(group, parts)


def _bucket_credits(group: pa.Table, parts: int) -> pa.Table:
    """How many shingles of each class in one bucket occur in another class as well."""
    h, c = _unpack(b"".join(group.column("blob").to_pylist()))
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    h, c = h[new], c[new]
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    count = np.diff(np.append(begin, len(h)))
    shared = np.repeat((count > 1) | (c[begin] == _MANY), count) & (c != _MANY)
    of, data = _credit_blobs(*np.unique(c[shared], return_counts=True), parts)
    return pa.table({"part": of, "blob": data})


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for low, high in in_batches(texts):
            sets = Sets(texts[low:high])
            data = [sets.hashes[a:b].tobytes() for a, b in zip(sets.first[:-1], sets.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([_signed(sets.cls), pa.array(sets.sizes), pa.array(data, pa.binary())], ["cls", "n", "shingles"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            n = part.column(1).to_numpy()
            flat = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(flat)], ["cls", "n", "h"])


def linked(a: bytes, b: bytes) -> bool:
    """Suffix filter, then the exact test on two sorted sets."""
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    need = -(-PERCENT * (len(x) + len(y)) // (100 + PERCENT))
    parts = [np.bincount((s >> U(58)).astype(np.int64), minlength=_PIVOTS) for s in (x, y)]
    if np.minimum(*parts).sum() < need:
        return False
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


@F.pandas_udf(BooleanType())
def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([linked(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; the side that repeats least is joined last."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").where(_linked("x", "y")).select("a", "b")


def components(edges: DataFrame, work) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): every node points to its smallest neighbour, pointers are
    doubled once, nodes are contracted, until no edge is left."""
    steps = []
    edges = work.stage(edges.select("a", "b"), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = work.stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")), "near")
        jump = near.select(F.col("a").alias("up"), F.col("up").alias("top"))
        step = work.stage(near.join(jump, "up").select(F.col("a").alias("node"), F.col("top").alias("root")), "step")
        steps.append(step)
        a, b = (step.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = work.stage(
            edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        more = step.select(F.col("node").alias("root"), F.col("root").alias("over"))
        out = out.join(more, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    return out


def _lengths_fit(n: str, m: str) -> Column:
    return (F.least(n, m) * 100) >= (F.greatest(n, m) * PERCENT)


def _positions_fit(n: str, pos: str, m: str, other: str) -> Column:
    """Positional filter: what follows a pair's first common shingle on either side, it included, reaches the overlap
    that the pair needs. Rows of later common shingles may fall too; the first one of a linked pair never does."""
    rest = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(other))
    return rest * (100 + PERCENT) >= (F.col(n) + F.col(m)) * PERCENT


def _prefixes(sets: DataFrame, work) -> DataFrame:
    """(h, cls, n, u, pos): prefix shingles that occur in several classes; u counts those of the class alone."""
    tokens = sets.mapInArrow(_tokens, "cls bigint, n bigint, h bigint")
    frequency = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(frequency, "h")
    mine = "partition by cls"
    ranked = shared.select("h", "cls", "n", F.expr(f"row_number() over ({mine} order by df, h)").alias("r"), F.expr(f"count(*) over ({mine})").alias("m"))
    pos = (F.col("n") - F.col("m") + F.col("r") - 1).alias("pos")
    kept = ranked.select("h", "cls", "n", (F.col("n") - F.col("m")).alias("u"), pos, "m")
    fits = (F.col("m") >= least_overlap(F.col("n"))) & (F.col("pos") <= F.col("n") - least_overlap(F.col("n")))
    return work.stage(kept.where(fits).drop("m"), "prefixes")


def _hub_pairs(prefixes: DataFrame) -> DataFrame:
    """One candidate for each class: of the hubs of its lists, the one it has most prefix shingles in common with.

    The hub of a list is the class with the smallest share of shingles of its own: edits add such, so it is the origin
    of a group of edited copies.
    """
    hubs = prefixes.groupBy("h").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), F.col("cls").alias("hub"), F.col("n").alias("hn"), F.col("pos").alias("hpos"))).alias("top"), F.count(F.lit(1)).alias("k"))
    hubs = hubs.where("k > 1").select("h", "top.hub", "top.hn", "top.hpos")
    met = prefixes.join(hubs, "h").where(F.col("cls") != F.col("hub")).where(_lengths_fit("n", "hn"))
    fits = F.bool_or(_positions_fit("n", "pos", "hn", "hpos")).alias("fits")
    best = met.groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("k"), fits).where("fits").groupBy("cls").agg(F.max(F.struct("k", "hub")).alias("best"))
    return best.select(F.col("cls").alias("a"), F.col("best.hub").alias("b"))


def _open_pairs(prefixes: DataFrame, comps: DataFrame) -> DataFrame:
    """All candidates between components: classes outside the main component of a list meet the others of the list."""
    root = comps.select(F.col("node").alias("cls"), "root")
    placed = prefixes.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    sizes = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"))
    mains = sizes.groupBy("h").agg(F.max(F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mains = mains.where("roots > 1").select("h", F.col("main.root").alias("main"))
    mixed = placed.join(mains, "h")
    some = mixed.where("root <> main").select("h", *[F.col(c).alias(f"{c}1") for c in ("cls", "n", "pos", "root")])
    others = mixed.select("h", "main", *[F.col(c).alias(f"{c}2") for c in ("cls", "n", "pos", "root")])
    met = some.join(others, "h").where("root1 <> root2").where((F.col("root2") == F.col("main")) | (F.col("cls1") < F.col("cls2")))
    met = met.where(_lengths_fit("n1", "n2") & _positions_fit("n1", "pos1", "n2", "pos2"))
    first = F.col("cls1") < F.col("cls2")

    a, b = (F.when(first, x).otherwise(y) for x, y in ((F.col("cls1"), F.col("cls2")), (F.col("cls2"), F.col("cls1"))))
    return met.select(a.alias("a"), b.alias("b")).distinct()


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` (smallest id it is linked to, over any number of links)."""
    return _linked_rows(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _linked_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``link_components``, with ``x``, a hash that tells texts under one id apart."""
    with arrow_rows(docs.sparkSession):
        return _linked_in_batches(docs, id_col, text_col)


def _linked_in_batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    work = workspace(docs.sparkSession, "jaccard-join")
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    key = source.schema["id"].dataType.simpleString()
    hashed = source.withColumn("x", F.xxhash64("t"))
    described = work.stage(hashed.mapInArrow(_describe, f"id {key}, x bigint, n bigint, s bigint, cls bigint, chk bigint"), "described")
    classes = work.stage(described.where("n > 0").groupBy("cls", "chk", "n", "s").agg(F.min("id").alias("rep")), "classes")
    roots = _class_components(source, classes, work)
    named = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "chk", "rep", F.coalesce("root", "cls").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = work.stage(named.join(smallest, "root").select("cls", "chk", "component_id"), "named")
    return described.join(named, ["cls", "chk"], "left").select(
        "id", "x", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def _class_components(source: DataFrame, classes: DataFrame, work) -> DataFrame:
    """(node, root) of the classes that link with another one."""
    sampled = classes.agg(F.sum("s")).first()[0] or 0
    buckets = max(1, -(-sampled // BUCKET_POSTINGS))
    postings = source.select("t").mapInArrow(_postings(buckets), "bucket int, part int, blob binary")
    postings = work.stage(postings, "postings")
    met = postings.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_credits(buckets), "part int, blob binary")
    credit = met.unionByName(postings.where("part is not null").select("part", "blob"))
    credit = credit.groupBy("part").applyInArrow(_summed, "cls bigint, credit bigint")
    least = F.col("s") - (F.col("n") - least_overlap(F.col("n")))
    survivors = classes.join(credit, "cls", "left").where(F.coalesce("credit", F.lit(0)) >= least).select("rep")
    survivors = broadcast_if_small(work.stage(survivors.distinct(), "survivors"))
    texts = source.join(survivors, F.col("id").eqNullSafe(F.col("rep")), "left_semi").select("t")
    sets = work.stage(texts.mapInArrow(_whole_sets, "cls bigint, n bigint, shingles binary").where("n > 0"), "sets")
    if sets.count() > sets.select("cls").distinct().count():  # repeated rows
        sets = work.stage(sets.dropDuplicates(["cls"]), "sets")
    prefixes = _prefixes(sets, work)
    links = work.stage(_verified(_hub_pairs(prefixes), sets), "hub-links")
    comps = work.stage(components(links, work), "comps")
    more = work.stage(_verified(work.stage(_open_pairs(prefixes, comps), "open"), sets), "links")
    if more.isEmpty():
        return comps
    return components(links.unionByName(more), work)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which no linked one has a smaller id; of rows with one id, the smallest text hash stays.

    Texts are joined with nothing: what goes is looked up beside the rows by id and text hash. Rows without an id stay.
    """
    work = workspace(docs.sparkSession, "near-duplicates")
    found = work.stage(_linked_rows(docs, id_col, text_col).where("id is not null"), "components")
    keepers = found.groupBy("component_id").agg(F.min(F.struct("id", "x")).alias("keeper"))
    gone = found.join(keepers, "component_id").where(F.struct("id", "x") != F.col("keeper"))
    gone = work.stage(gone.select(F.col("id").alias("_gone"), F.col("x").alias("_text")).distinct(), "gone")
    same = (docs[id_col] == F.col("_gone")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_text"))
    kept = docs.join(broadcast_if_small(gone), same, "left_anti")
    if found.groupBy("id", "x").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]))
