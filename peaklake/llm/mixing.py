"""Operator 9: mixing sources to target weights by temperature.

Shares of the sources (in tokens) are raised to an exponent between 1 (natural shares) and 0 (equal shares) and
normalised. The exponent is bisected so that the weights meet a target entropy or a repetition limit; every step tries
a grid of exponents in one grouped sum over the table of sources. The weights are then realised exactly: each source
is a stream of epochs, each epoch an own random permutation of its documents, cut off at the token budget of the source.
The stream of a source is dealt into blocks that hold its weight's part of the block tokens, and the documents of a
block are permuted together, so that every block has the mixture.

Running token sums inside a permutation are made in two steps (sums over 4,096 hash buckets of each source, then rows
within a bucket), so a source with a third of all rows is spread over all tasks. Which documents the last, partial
epoch takes is a threshold on the permutation hash, one per source: ``mix`` decides it beside each row by a join with
the table of sources and moves no text.

Defined results: a document has its white-space separated words and one end as tokens (null text: the end alone); null
sources form a source of their own; rows equal in id, source and tokens are told apart by neither the order nor the
threshold and go together; an empty table gives no rows; extra columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peaklake.llm.common import text_or_empty, workspace

GRID = 64
ROUNDS = 4  # 64 ** 4 steps: exponents in units of 2 ** -24
BUCKET_DIGITS = 3
INTERNAL = "__mix_"


class Target(NamedTuple):
    """``max_repeats``: no source is seen more often than this; or ``entropy``: share of the largest possible entropy.

    ``budget``: tokens to deal out; None stands for as many as show every document at least once.
    """

    max_repeats: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None


def tokens_of(text_col: str) -> Column:
    words = F.split(F.trim(F.regexp_replace(text_or_empty(text_col), r"[\t-\r ]+", " ")), " ")
    return (F.size(F.filter(words, lambda w: w != "")) + 1).cast("bigint")


def source_key(source_col: str) -> Column:
    """Null sources are one source: keys of others are prefixed."""
    return F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("n:"))


def order_key(seed: int, epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))))


def _fits(sources: DataFrame, target: Target, exponents: list[float]) -> dict[float, bool]:
    """Which exponents meet the target: one grouped sum over (source, exponent)."""
    total = sources.agg(F.sum("tokens")).first()[0]
    share = F.col("tokens") / F.lit(float(total))
    tried = sources.select("tokens", share.alias("p"), F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    power = F.pow("p", "a")
    found = tried.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("zl"), F.count(F.lit(1)).alias("n"),
        F.max(power / F.col("p")).alias("steep"), F.min(power / F.col("p")).alias("flat"),
    ).collect()
    out = {}
    for r in found:
        if target.entropy is not None:
            entropy = math.log(r["z"]) - r["zl"] / r["z"]
            out[r["a"]] = entropy >= target.entropy * math.log(r["n"]) - 1e-12
        else:
            # repetitions of source s are its weight times the budget over its tokens
            scale = 1.0 / r["flat"] if target.budget is None else target.budget / total / r["z"]
            out[r["a"]] = r["steep"] * scale <= target.max_repeats * (1 + 1e-12)
    return out


def bisect_exponent(sources: DataFrame, target: Target) -> float:
    """Entropy falls and repetition eases as the exponent grows: the largest exponent with enough entropy, or the
    smallest one within the repetition limit, as a multiple of 64 ** -ROUNDS."""
    low, width = 0, GRID**ROUNDS
    unit = float(width)
    for _ in range(ROUNDS):
        width //= GRID
        marks = [low + i * width for i in range(GRID + 1)]
        fits = _fits(sources, target, [m / unit for m in marks])
        good = [m for m in marks if fits[m / unit]]
        if target.entropy is not None:
            if not good:
                return 0.0
            low = max(good)
            if low >= unit:
                return 1.0
        else:
            if not good:
                return 1.0
            first = min(good)
            if first == 0:
                return 0.0
            low = first - width
    return low / unit if target.entropy is not None else (low + width) / unit


def plan(docs: DataFrame, target: Target, block_tokens: int, id_col: str, text_col: str, source_col: str, seed: int, work) -> tuple[DataFrame, DataFrame]:
    """Staged (rows, sources): rows have source key, id and tokens; sources have tokens, weight, budget and block part."""
    rows = work.stage(docs.select(F.col(id_col).alias("id"), source_key(source_col).alias("s"), tokens_of(text_col).alias("n")), "rows")
    sources = work.stage(rows.groupBy("s").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    if sources.isEmpty():
        return rows, sources.select("s", "tokens", *[F.lit(0.0).alias(c) for c in ("weight", "part")], F.lit(0).cast("bigint").alias("budget"))
    exponent = bisect_exponent(sources, target)
    total = sources.agg(F.sum("tokens")).first()[0]
    powered = sources.withColumn("power", F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)))
    sums = powered.agg(F.sum("power").alias("z"), F.max(F.col("tokens") / F.col("power")).alias("m")).first()
    budget = sums["z"] * sums["m"] if target.budget is None else float(target.budget)
    weight = F.col("power") / F.lit(sums["z"])
    goal = F.round(weight * F.lit(budget)).cast("bigint")
    if target.budget is None:
        goal = F.greatest(goal, F.col("tokens"))
    return rows, work.stage(powered.select("s", "tokens", weight.alias("weight"), (weight * F.lit(float(block_tokens))).alias("part"), goal.alias("budget")), "weights")


def deal(rows: DataFrame, sources: DataFrame, seed: int, work) -> DataFrame:
    """(s, id, n, epoch, before, part, key): every copy within budget; ``before`` counts the source's tokens ahead of it."""
    epochs = F.expr("sequence(0, cast((budget + tokens - 1) div tokens as int) - 1)")
    copies = rows.join(sources.where("budget > 0"), "s").select("s", "id", "n", "tokens", "budget", "part", F.explode(epochs).alias("epoch"))
    keyed = copies.withColumn("key", order_key(seed, F.col("epoch"), F.col("id"))).withColumn("b", F.substring("key", 1, BUCKET_DIGITS))
    keyed = work.stage(keyed, "copies")
    upto = Window.partitionBy("s", "epoch").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("s", "epoch", "b").agg(F.sum("n").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(upto), F.lit(0))).drop("m")
    inside = Window.partitionBy("s", "epoch", "b").orderBy("key", "n").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("epoch") * F.col("tokens") + F.col("offset") + F.coalesce(F.col("inner"), F.lit(0))
    return (
        keyed.withColumn("inner", F.sum("n").over(inside)).join(offsets, ["s", "epoch", "b"])
        .withColumn("before", before).where("before < budget").select("s", "id", "n", "epoch", "before", "part", "key")
    )


def schedule(
    docs: DataFrame, target: Target = Target(), block_tokens: int = 1 << 20, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", seed: int = 17,
) -> DataFrame:
    """One row per dealt copy: id, source, epoch, tokens, block and slot (order within the block, from 0)."""
    work = workspace(docs.sparkSession, "mixing")
    rows, sources = plan(docs, target, block_tokens, id_col, text_col, source_col, seed, work)
    block = F.floor(F.col("before") / F.col("part")).cast("bigint")
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), "block", "key"))
    slots = Window.partitionBy("block").orderBy("mixed", "key", "n")
    return (
        deal(rows, sources, seed, work).withColumn("block", block).withColumn("mixed", mixed)
        .select(
            F.col("id").alias(id_col), F.when(F.col("s") != "n:", F.substring("s", 3, 1 << 30)).alias(source_col),
            F.col("epoch").cast("int").alias("epoch"), F.col("n").alias("tokens"), "block", (F.row_number().over(slots) - 1).cast("bigint").alias("slot"),
        )
    )


def mix(
    docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", seed: int = 17,
) -> DataFrame:
    """``docs`` with every row as often as the mixture shows it, in its own columns only."""
    work = workspace(docs.sparkSession, "mixing")
    rows, sources = plan(docs, target, 1 << 20, id_col, text_col, source_col, seed, work)
    dealt = deal(rows, sources, seed, work)
    last = sources.select("s", F.expr("case when budget > 0 then (budget - 1) div tokens else -1 end").alias("last"))
    cuts = dealt.join(last, "s").where("epoch = last").groupBy("s").agg(F.max("key").alias("cut"))
    limits = work.stage(last.join(cuts, "s", "left"), "limits").select(*[F.col(c).alias(INTERNAL + c) for c in ("s", "last", "cut")])
    key = order_key(seed, F.col(f"{INTERNAL}last"), F.col(id_col))
    copies = (F.col(f"{INTERNAL}last") + F.when(key <= F.col(f"{INTERNAL}cut"), 1).otherwise(0)).cast("int")
    return (
        docs.withColumn(f"{INTERNAL}s", source_key(source_col)).join(limits, f"{INTERNAL}s")
        .withColumn(f"{INTERNAL}copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def oracle_sql(max_repeats: float = 2.0, block_tokens: int = 1 << 20, seed: int = 17) -> str:
    """DuckDB: the exponent of a repetition limit under full coverage has a closed form."""
    steps = float(GRID**ROUNDS)
    return f"""WITH d AS (SELECT doc_id, source, coalesce('s:' || source, 'n:') AS s,
  len(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[\t-\r ]+', ' ', 'g')), ' '), lambda w: w <> '')) + 1 AS n FROM documents),
t AS (SELECT s, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY s),
a AS (SELECT CASE WHEN max(tokens) = min(tokens) THEN 0.0 ELSE greatest(0.0, ceil((1 - ln({max_repeats}) / ln(max(tokens) / CAST(min(tokens) AS DOUBLE))) * {steps}) / {steps}) END AS a, CAST(sum(tokens) AS DOUBLE) AS total FROM t),
p AS (SELECT s, tokens, pow(tokens / total, a) AS power FROM t, a),
z AS (SELECT sum(power) AS z, max(tokens / power) AS m FROM p),
w AS (SELECT s, tokens, power / z * CAST({block_tokens} AS DOUBLE) AS part, greatest(CAST(round(power / z * (z * m)) AS BIGINT), tokens) AS budget FROM p, z),
e AS (SELECT doc_id, source, s, n, tokens, budget, part, unnest(range(0, (budget + tokens - 1) // tokens)) AS epoch FROM d JOIN w USING (s)),
k AS (SELECT *, md5('{seed}|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM e),
b AS (SELECT *, epoch * tokens + coalesce(sum(n) OVER (PARTITION BY s, epoch ORDER BY key, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
c AS (SELECT *, CAST(floor(before / part) AS BIGINT) AS block FROM b WHERE before < budget)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, n AS tokens, block,
  row_number() OVER (PARTITION BY block ORDER BY md5('{seed}|' || block || '|' || key), key, n) - 1 AS slot FROM c"""
