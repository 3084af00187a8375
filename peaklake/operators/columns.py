"""Column statistics of keyed matrices, as arrays per key."""

from __future__ import annotations

from peaklake.operators.matrix import Matrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def train_rows() -> Column:
    return F.col("role") == "train"


def column_stats(matrix: Matrix, where: Column | None = None, **aggregates: Column) -> DataFrame:
    """keys..., pos, one column per aggregate over ``value``."""
    return matrix.exploded(where=where).groupBy(*matrix.keys, "pos").agg(
        *[agg.alias(name) for name, agg in aggregates.items()]
    )


def pack(stats: DataFrame, keys: tuple[str, ...], *names: str) -> DataFrame:
    """One row per key; each statistic as an array in the order of the axis."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", *names)))
    packed = stats.groupBy(*keys).agg(ordered.alias("packed"))
    return packed.select(*keys, *[F.col(f"packed.{name}").alias(name) for name in names])


def missing_share() -> Column:
    """Share of NULL among the values of a group."""
    return 1.0 - F.count("value") / F.count(F.lit(1))


def min_positive() -> Column:
    return F.min(F.when(F.col("value") > 0, F.col("value")))
