"""Sample metadata: one row per sample visit."""

from __future__ import annotations

from peaklake.functions.scalars import (
    coerce_numeric,
    derive_condition,
    derive_symptomatic,
    extract_sample_id,
    row_mean_skipna,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the metadata sheet.
ID_COLUMN = "CSUID"
READINGS = ("OsmolReading1", "OsmolReading2", "OsmolReading3")
OTHER_COLUMNS = ("SampleType", "VisitDay", "tbsymptom")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV (all columns as text) or Parquet, told apart by the file name."""
    if path.rstrip("/").lower().endswith((".csv", ".csv.gz")):
        table = spark.read.options(header=True).csv(path)
    else:
        table = spark.read.parquet(path)
    missing = [c for c in (ID_COLUMN, "tbsymptom", *READINGS) if c not in table.columns]
    if missing:
        raise ValueError(f"metadata lacks the columns {missing}")
    return table


def build_samples(metadata: DataFrame) -> DataFrame:
    """(sample_id, condition, symptomatic, mean_osmolality); rows without a sample id are dropped."""
    optional = lambda c: F.col(c).cast("string") if c in metadata.columns else F.lit(None).cast("string")
    readings = [coerce_numeric(F.col(c).cast("string")) for c in READINGS]
    return metadata.select(
        extract_sample_id(F.col(ID_COLUMN).cast("string")).alias("sample_id"),
        derive_condition(optional("SampleType"), optional("VisitDay")).alias("condition"),
        derive_symptomatic(optional("tbsymptom")).alias("symptomatic"),
        row_mean_skipna(*readings).alias("mean_osmolality"),
    ).where(F.col("sample_id").isNotNull())
