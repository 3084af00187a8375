"""Feature filters on missing cells."""

from __future__ import annotations

from collections.abc import Sequence

from peaklake.operators.columns import missing_share
from peaklake.operators.matrix import Matrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_overall_missingness(
    matrix: Matrix, max_na_prop: float = 0.5, where: Column | None = None
) -> DataFrame:
    """Features whose share of missing cells is at most ``max_na_prop``: keys..., feature_id."""
    kept = (
        matrix.exploded(where=where)
        .groupBy(*matrix.keys, "pos")
        .agg(missing_share().alias("na_prop"))
        .where(F.col("na_prop") <= max_na_prop)
    )
    return matrix.positions().join(kept, [*matrix.keys, "pos"]).select(*matrix.keys, "feature_id")


def filter_groupwise_missingness(
    matrix: Matrix,
    group_cols: Sequence[str] = ("condition",),
    min_prop: float = 0.6,
    min_group_n: int = 3,
    require_all: bool = True,
    where: Column | None = None,
    exempt: Sequence[int] = (),
) -> DataFrame:
    """Features observed often enough in the groups of a key: keys..., feature_id.

    Groups with fewer than ``min_group_n`` rows are ignored. ``require_all`` combines the remaining ones by ALL,
    otherwise by ANY; without any group left ALL keeps every feature and ANY none. A missing group value is an
    error. ``exempt`` features (the internal standard) always stay.
    """
    keys = list(matrix.keys)
    named = matrix.with_rows(
        matrix.rows.withColumns({c: _required(c) for c in group_cols})
    )
    judged = (
        named.exploded(*group_cols, where=where)
        .groupBy(*keys, "pos", *group_cols)
        .agg(F.count(F.lit(1)).alias("n"), missing_share().alias("na_prop"))
        .where(F.col("n") >= min_group_n)
        .withColumn("passes", 1.0 - F.col("na_prop") >= min_prop)
        .groupBy(*keys, "pos")
        .agg((F.bool_and if require_all else F.bool_or)("passes").alias("passes"))
    )
    passes = F.coalesce("passes", F.lit(require_all))
    if exempt:
        passes = passes | F.col("feature_id").isin(*exempt)
    return (
        matrix.positions()
        .join(judged, [*keys, "pos"], "left")
        .where(passes)
        .select(*keys, "feature_id")
    )


def _required(name: str) -> Column:
    error = F.raise_error(F.concat(F.lit(f"no {name} for sample "), F.col("sample_id")))
    return F.coalesce(F.col(name), error)
