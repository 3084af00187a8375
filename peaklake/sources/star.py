"""The star schema: abundances, features and samples as Parquet."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("samples", "features", "abundances")
# Fixed value: how older databases spell the osmolality column.
OLD_OSMOLALITY = "mean_osmoality"


class Star(NamedTuple):
    samples: DataFrame
    features: DataFrame
    abundances: DataFrame


def load_tables(spark: SparkSession, root: str) -> Star:
    """Lazy readers of the three tables, written by any tool; NaN areas become NULL."""
    read = lambda name: spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    samples, features, abundances = (read(name) for name in TABLES)
    if OLD_OSMOLALITY in samples.columns:
        samples = samples.withColumnRenamed(OLD_OSMOLALITY, "mean_osmolality")
    for measure in ("area", "rt", "mz"):
        if measure in abundances.columns:
            value = F.col(measure)
            abundances = abundances.withColumn(measure, F.when(~F.isnan(value), value))
    return Star(samples, features, abundances)


def write_star_schema(star: Star, root: str, mode: str = "overwrite") -> None:
    """Write the tables; the fact is range-partitioned and sorted by feature, so row groups can be skipped."""
    root = root.rstrip("/")
    star.samples.sort("sample_id").write.mode(mode).parquet(f"{root}/samples.parquet")
    (
        star.abundances.repartitionByRange("feature_id", "sample_id")
        .sortWithinPartitions("feature_id", "sample_id")
        .write.mode(mode).parquet(f"{root}/abundances.parquet")
    )
    star.features.sort("feature_id").write.mode(mode).parquet(f"{root}/features.parquet")
