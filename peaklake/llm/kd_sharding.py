"""Operator 6: k-d tree partitioning by distributed weighted medians.

Every document is a point of metadata coordinates with its bytes as weight. A node that holds several shards is split
along its widest coordinate at the weighted median (for odd shard counts at the matching share), until a leaf is one
shard of about the target bytes. All nodes of a level are split together. The median is found exactly by descent over
the digits of a 62-bit sort key (coordinate, then a hash of id and text): each step is one grouped sum, combined
before its shuffle, over a narrow staged table, and leaves one row per node. No group of rows is ever gathered; a hot
source is cut inside by the hash.

Rows are assigned by following the splits, which are tables of one row per inner node, so a text is never moved.

Defined results: a null text has size 1, null metadata counts as the smallest value of its coordinate; a null id takes
part like any other; rows equal in id, text and metadata share a shard; an empty table gives no rows; extra columns
are kept by ``assign`` and not read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peaklake.llm.common import workspace
from peaklake.operators.ranking import hash_rank

COORDINATE_BITS = 31
DIGITS = (46, 30, 14, 0)  # shifts of the steps; 16 bits each, the last 14
INTERNAL = "__kd_"


def _hash31(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(1 << COORDINATE_BITS)


def size_of(text_col: str) -> Column:
    """UTF-8 bytes of the text and one byte for its end."""
    return (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 1).cast("bigint")


class KdTree(NamedTuple):
    """``levels``: one (node, dim, cut, left, right) table per level, each a Python list of rows as small as the tree."""

    shards: int
    keys: tuple[Column, ...]
    levels: list[DataFrame]

    def assign(self, frame: DataFrame, name: str) -> DataFrame:
        """``frame`` with the shard number of every row; frame must have the columns that ``keys`` read."""
        node = f"{INTERNAL}node"
        out = frame.withColumn(node, F.lit(0))
        for table in self.levels:
            split = table.select(F.col("node").alias(node), *[F.col(c).alias(INTERNAL + c) for c in ("dim", "cut", "left", "right")])
            key = reduce(lambda other, d: F.when(F.col(f"{INTERNAL}dim") == d, self.keys[d]).otherwise(other), range(len(self.keys)), F.lit(None))
            step = F.when(F.col(f"{INTERNAL}cut").isNull(), F.col(node)).when(key <= F.col(f"{INTERNAL}cut"), F.col(f"{INTERNAL}left")).otherwise(F.col(f"{INTERNAL}right"))
            out = out.join(split, node, "left").select(*[F.col(f"`{c}`") for c in frame.columns], step.alias(node))
        return out.withColumn(name, F.col(node).cast("int")).drop(node)


def coordinates(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> tuple[Column, ...]:
    """Sort keys of the three metadata dimensions: source, language, text length."""
    tie = _hash31(F.concat_ws("|", F.col(id_col).cast("string"), F.col(text_col).cast("string")))
    raw = [
        F.coalesce(_hash31(F.col(source_col).cast("string")), F.lit(0)),
        F.coalesce(_hash31(F.col(lang_col).cast("string")), F.lit(0)),
        size_of(text_col),
    ]
    return tuple(F.shiftleft(c.cast("bigint"), COORDINATE_BITS) + tie for c in raw)


def build(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> KdTree:
    """Tree with ``shards`` leaves, or with as many as ``target_bytes`` a leaf asks for."""
    spark = docs.sparkSession
    work = workspace(spark, "kd-tree")
    keys = coordinates(docs, id_col, text_col, source_col, lang_col)
    names = [f"k{d}" for d in range(len(keys))]
    points = work.stage(docs.select(size_of(text_col).alias("w"), *[k.alias(n) for k, n in zip(keys, names, strict=True)]), "points")
    whole = points.agg(F.sum("w").alias("w"), *[f(F.shiftright(n, COORDINATE_BITS)).alias(f"{n}{s}") for n in names for f, s in ((F.min, "_lo"), (F.max, "_hi"))]).first()
    if whole["w"] is None:
        return KdTree(shards or 1, keys, [])
    shards = shards or -(-whole["w"] // target_bytes)
    spans = [max(1, whole[f"{n}_hi"] - whole[f"{n}_lo"]) for n in names]
    tree = KdTree(shards, tuple(F.col(n) for n in names), [])
    # a node is named by its first shard; nodes(node, k): how many shards it holds
    nodes = spark.range(1).select(F.lit(0).alias("node"), F.lit(shards).alias("k"))
    while 2 ** len(tree.levels) < shards:
        placed = tree.assign(points, "node")
        nodes = work.stage(_split(placed, nodes.where("k > 1"), names, spans, work), "level")
        tree.levels.append(nodes.select("node", "dim", "cut", F.col("node").alias("left"), (F.col("node") + F.expr("k div 2")).cast("int").alias("right")))
        halves = [nodes.select("node", F.expr("cast(k div 2 as int)").alias("k")), nodes.select(F.expr("cast(node + k div 2 as int)").alias("node"), F.expr("cast(k - k div 2 as int)").alias("k"))]
        nodes = halves[0].unionByName(halves[1])
    return KdTree(shards, keys, tree.levels)


def _split(placed: DataFrame, nodes: DataFrame, names: list[str], spans: list[int], work) -> DataFrame:
    """(node, k, dim, cut): rows with key <= cut of dimension dim go left."""
    edges = placed.groupBy("node").agg(
        F.sum("w").alias("w"), *[((F.max(F.shiftright(n, COORDINATE_BITS)) - F.min(F.shiftright(n, COORDINATE_BITS))) / F.lit(float(s))).alias(f"{n}_width") for n, s in zip(names, spans, strict=True)]
    )
    widest = F.greatest(*[F.col(f"{n}_width") for n in names])
    dim = reduce(lambda other, d: F.when(F.col(f"{names[d]}_width") == widest, d).otherwise(other), reversed(range(len(names))), F.lit(0))
    state = work.stage(
        edges.join(nodes, "node").select("node", "k", dim.alias("dim"), F.expr("w * (k div 2) div k").alias("goal"), F.lit(0).cast("bigint").alias("cut"), F.lit(0).cast("bigint").alias("base")),
        "nodes",
    )
    for shift in DIGITS:
        above = F.lit(0).cast("bigint") if shift == DIGITS[0] else F.shiftright("key", DIGITS[DIGITS.index(shift) - 1])
        prefix = F.lit(0).cast("bigint") if shift == DIGITS[0] else F.shiftright("cut", DIGITS[DIGITS.index(shift) - 1])
        key = reduce(lambda other, d: F.when(F.col("dim") == d, F.col(names[d])).otherwise(other), range(len(names)), F.lit(None).cast("bigint"))
        sums = (
            placed.join(state.select("node", "dim", "cut"), "node").select("node", key.alias("key"), "cut", "w")
            .where(above == prefix).groupBy("node", F.shiftright("key", shift).alias("head")).agg(F.sum("w").alias("w"))
        )
        upto = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("head")))
        state = work.stage(
            upto.join(state, "node").withColumn("reach", F.col("base") + F.col("upto"))
            .where("reach >= goal").groupBy("node").agg(F.min(F.struct("head", (F.col("reach") - F.col("w")).alias("base"))).alias("first"), F.first("k").alias("k"), F.first("dim").alias("dim"), F.first("goal").alias("goal"))
            .select("node", "k", "dim", "goal", F.shiftleft("first.head", shift).alias("cut"), F.col("first.base").alias("base")),
            "step",
        )
    return state.select("node", "k", "dim", "cut")


def shard(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang", name: str = "shard",
) -> DataFrame:
    """``docs`` with the column ``name``; nothing but the splits is joined, so rows stay where they are."""
    tree = build(docs, shards, target_bytes, id_col, text_col, source_col, lang_col)
    return tree.assign(docs, name)


def manifest(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, crc32, law, shard, slot and grown_shard."""
    tree = build(docs, shards=shards, id_col=id_col, text_col=text_col)
    placed = tree.assign(docs, "shard").select(
        F.col(id_col), size_of(text_col).alias("size"), F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_crc32"),
        "shard", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("order"),
    )
    ranked = hash_rank(workspace(docs.sparkSession, "kd-manifest").stage(placed, "placed"), ["shard"], "order", id_col, name="slot")
    return ranked.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle_sql(shards: int = 16) -> str:
    """DuckDB, for a power of two of shards: one block of window functions per level."""
    h = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % 2147483648"
    tie = h.format("concat_ws('|', CAST(doc_id AS VARCHAR), text)")
    dims = [f"coalesce({h.format('source')}, 0)", f"coalesce({h.format('lang')}, 0)", "coalesce(strlen(text), 0) + 1"]
    ctes = [
        f"l0 AS (SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, 0 AS node, {shards} AS k, "
        + ", ".join(f"({c}) AS c{i}, ({c}) * 2147483648 + {tie} AS k{i}" for i, c in enumerate(dims)) + " FROM documents)",
        "g AS (SELECT " + ", ".join(f"greatest(1, max(c{i}) - min(c{i})) AS s{i}" for i in range(3)) + " FROM l0)",
    ]
    for level in range((shards - 1).bit_length()):
        widths = ", ".join(f"(max(c{i}) OVER n - min(c{i}) OVER n) / CAST(s{i} AS DOUBLE) AS w{i}" for i in range(3))
        ctes += [
            f"a{level} AS (SELECT l{level}.*, {widths}, CAST(sum(size) OVER n * (k // 2) // k AS BIGINT) AS goal FROM l{level}, g WINDOW n AS (PARTITION BY node))",
            f"b{level} AS (SELECT *, CASE greatest(w0, w1, w2) WHEN w0 THEN k0 WHEN w1 THEN k1 ELSE k2 END AS key FROM a{level})",
            f"c{level} AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY key) - sum(size) OVER (PARTITION BY node, key) AS base FROM b{level})",
            f"l{level + 1} AS (SELECT doc_id, text, size, CASE WHEN base < goal THEN node ELSE node + k // 2 END AS node, "
            f"CASE WHEN base < goal THEN k // 2 ELSE k - k // 2 END AS k, c0, c1, c2, k0, k1, k2 FROM c{level})",
        ]
    last = f"l{(shards - 1).bit_length()}"
    return f"""WITH {', '.join(ctes)},
crc AS (SELECT list(list_reduce([i] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))
SELECT doc_id, size, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295,
    list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) END AS text_crc32,
  'bytes' AS law, CAST(node AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY node ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM {last}, crc"""
