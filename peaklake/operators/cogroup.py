"""Grouped pairs of tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cogroup_apply(
    left: DataFrame, right: DataFrame, keys: Sequence[str], fn: Callable, schema: T.StructType
) -> DataFrame:
    """``applyInPandas`` over both tables grouped by ``keys``; they may stem from the same table."""
    fresh = right.select(*[F.col(c).alias(c) for c in right.columns])  # own column identities
    return left.groupBy(*keys).cogroup(fresh.groupBy(*keys)).applyInPandas(fn, schema)
