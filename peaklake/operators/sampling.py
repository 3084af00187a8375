"""Splits, folds, under-sampling and bootstrap draws, all as keyed hashes."""

from __future__ import annotations

from collections.abc import Sequence

from peaklake.functions.hashing import draw_int, draw_key
from peaklake.operators.ranking import hash_rank
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stratified_split(
    samples: DataFrame, by: str = "condition", test_ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``test_split``: per stratum floor(n * ratio) test rows, at least one if n > 1."""
    keyed = samples.withColumn("_h", draw_key(seed, F.col("sample_id")))
    sizes = samples.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    floor = F.floor(F.col("_n") * F.lit(test_ratio)).cast("int")
    n_test = F.when(F.col("_n") > 1, F.greatest(floor, F.lit(1))).otherwise(0)
    return (
        hash_rank(keyed, [by], "_h", "sample_id", name="_r")
        .join(sizes, by)
        .withColumn("test_split", F.col("_r") <= n_test)
        .drop("_h", "_r", "_n")
    )


def stratified_kfold(rows: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1 per key, balanced by ``y``: fold and class sizes differ by at most one."""
    hashed = rows.withColumn("_h", draw_key(seed, *[F.col(c) for c in keys], F.col("sample_id")))
    ranked = hash_rank(hashed, keys, "_h", "sample_id", before=["y"], name="_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def class_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., n_pos, n_neg, n_min, n_maj, minority (0/1; the negative class on a tie)."""
    counts = rows.groupBy(*keys).agg(
        F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg")
    )
    return counts.withColumns(
        {
            "n_min": F.least("n_pos", "n_neg"),
            "n_maj": F.greatest("n_pos", "n_neg"),
            # On equal counts the first class is the majority, as with an argmax over (0, 1).
            "minority": F.when(F.col("n_pos") <= F.col("n_neg"), 1).otherwise(0),
        }
    )


def random_under_sample(
    rows: DataFrame,
    keys: Sequence[str],
    target_ratio: float | None = 5.0,
    strategy: str | float | dict = "auto",
    seed: int = 42,
    id_col: str = "sample_id",
    stage=None,
) -> DataFrame:
    """Cut the majority class of each key to at most ``target_ratio`` times the minority, without replacement.

    With ``target_ratio=None`` or more than two classes the strategy decides: ``auto`` cuts every class but the
    smallest to its size, a float is the wanted minority/majority ratio, a dict gives rows per class. With ``stage``
    the class sizes are looked at first and nothing is ranked if no class has to be cut.
    """
    keys = list(keys)
    sizes = _class_targets(rows, keys, target_ratio, strategy)
    if stage is not None:
        sizes = stage(sizes, "class-targets")
        if sizes.where(F.col("_target") < F.col("_size")).isEmpty():
            return rows  # every class is within its bound
    sized = rows.join(sizes, [*keys, "y"])
    over = sized.where(F.col("_target") < F.col("_size"))
    hashed = over.withColumn("_h", draw_key(seed, *[F.col(c) for c in keys], F.col(id_col)))
    kept = hash_rank(hashed, [*keys, "y"], "_h", id_col, name="_r").where(F.col("_r") <= F.col("_target"))
    within = sized.where(F.col("_target") >= F.col("_size")).select(*rows.columns)
    out = within.unionByName(kept.select(*rows.columns))
    return out if stage is None else stage(out, "under-sampled")


def _class_targets(rows, keys, target_ratio, strategy) -> DataFrame:
    per_class = rows.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_class.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_classes"), F.min("n").alias("_min"), F.max("n").alias("_max")
    )
    # One class only is left alone; of two equal classes neither exceeds the ratio.
    n, n_min = F.col("n"), F.col("_min")
    if isinstance(strategy, dict):
        wanted = F.lit(None).cast("bigint")
        for label, size in strategy.items():
            wanted = F.when(F.col("y") == label, F.lit(size)).otherwise(wanted)
        fallback = F.coalesce(wanted, n)
    elif isinstance(strategy, (int, float)):
        fallback = F.when(n > n_min, F.floor(n_min / F.lit(float(strategy)))).otherwise(n)
    else:
        fallback = n_min
    fallback = F.least(n, fallback)
    target: Column = fallback
    if target_ratio is not None:
        cut = F.greatest(F.lit(1), F.least(n, F.bround(F.lit(float(target_ratio)) * n_min).cast("bigint")))
        binary = F.when((n > n_min) & (n > n_min * F.lit(float(target_ratio))), cut).otherwise(n)
        target = F.when(F.col("_classes") == 2, binary).when(F.col("_classes") == 1, n).otherwise(fallback)
    return per_class.join(per_key, keys).select(
        *keys, "y", F.col("n").alias("_size"), target.cast("bigint").alias("_target")
    )


def bootstrap_draws(
    rows: DataFrame, keys: Sequence[str], replicates: int, seed: int = 42
) -> DataFrame:
    """keys..., replicate, sample_id, attributes..., multiplicity (how often the row was drawn).

    Each row makes one draw per replicate; draws are counted per (key, replicate, drawn index) and joined back to
    the rows by their index. Replicates that hold one class only are left out.
    """
    keys = list(keys)
    indexed = hash_rank(
        rows.withColumn("_h", draw_key(seed, *[F.col(c) for c in keys], F.col("sample_id"))),
        keys, "_h", "sample_id", name="_r",
    ).withColumn("_i", F.col("_r") - 1).drop("_h", "_r")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draw = draw_int(seed, *[F.col(c) for c in keys], F.col("replicate"), F.col("_i"))
    drawn = (
        indexed.select(*keys, "_i")
        .join(sizes, keys)
        .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("_i", F.pmod(draw, F.col("_n")))
        .groupBy(*keys, "replicate", "_i")
        .agg(F.count(F.lit(1)).alias("multiplicity"))
    )
    taken = drawn.join(indexed, [*keys, "_i"]).drop("_i")
    both = (
        taken.groupBy(*keys, "replicate")
        .agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
        .where(F.col("_lo") < F.col("_hi"))
    )
    return taken.join(both.select(*keys, "replicate"), [*keys, "replicate"])
