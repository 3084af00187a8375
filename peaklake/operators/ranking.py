"""Exact ranks without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3  # 16**3 buckets per group


def hash_rank(
    df: DataFrame,
    group: Sequence[str],
    hash_col: str,
    tie: str,
    before: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """``row_number`` within ``group``, ordered by ``before``, then by an md5 column, then by ``tie``.

    md5 text is uniform, so its first digits cut every group into buckets of even size. Bucket sizes are counted
    (map-side combined), summed up to offsets, and the rows are numbered inside their bucket only: a group with a
    third of all rows is spread over 4,096 windows.
    """
    cut = df.withColumn("_bucket", F.substring(hash_col, 1, BUCKET_DIGITS))
    place = [*group, *before, "_bucket"]
    counts = cut.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*group)
        .orderBy(*before, "_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*place).orderBy(hash_col, tie)
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, place)
        .withColumn(name, F.col("_rank") + F.col("_offset"))
        .drop("_bucket", "_rank", "_offset")
    )
