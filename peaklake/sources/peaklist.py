"""Wide peak list: one row per feature, three columns per sample."""

from __future__ import annotations

import csv
import io
import re

from peaklake.functions.scalars import MEASURE_COLUMN, MEASURES, missing_to_null, zfill
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED_COLUMNS = {"id": T.LongType(), "mz": T.DoubleType(), "rt": T.DoubleType()}
CSV_OPTIONS = {"header": True, "maxColumns": 2_000_000, "maxCharsPerColumn": -1, "nanValue": "NaN"}


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line. Reads one line, not the file."""
    line = spark.read.text(path).head()
    if line is None:
        raise ValueError(f"empty peak list: {path}")
    return next(csv.reader(io.StringIO(line[0])))


def parse_measure_columns(names: DataFrame) -> DataFrame:
    """(column) -> (column, sample_id, measure); columns of another form are left out."""
    part = lambda i: F.regexp_extract("column", MEASURE_COLUMN, i)
    return names.where(F.col("column").rlike(MEASURE_COLUMN)).select(
        "column", zfill(part(1)).alias("sample_id"), part(2).alias("measure")
    )


def read_peaklist(spark: SparkSession, path: str) -> DataFrame:
    """The wide table with a schema made from the header: ``id`` long, every number a double.

    No schema inference: an all-empty sample column would become text. A cell that is not a number is missing.
    """
    names = header_of(spark, path)
    if "id" not in names:
        raise ValueError("the peak list needs a column 'id'")
    if not any(re.match(MEASURE_COLUMN, n) for n in names):
        raise ValueError("the peak list has no measure column of the form datafile:*CSU-TB-*.mzML:*")
    numeric = set(FIXED_COLUMNS) | {n for n in names if re.match(MEASURE_COLUMN, n)}
    kind = lambda n: FIXED_COLUMNS.get(n, T.DoubleType() if n in numeric else T.StringType())
    schema = T.StructType([T.StructField(n, kind(n)) for n in names])
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def column_map(spark: SparkSession, peaklist: DataFrame) -> DataFrame:
    """(column, sample_id, measure) of a wide table."""
    names = spark.createDataFrame([(c,) for c in peaklist.columns], "column string")
    return parse_measure_columns(names)


def melt_measures(peaklist: DataFrame, id_col: str = "id") -> DataFrame:
    """(feature_id, column, value) for every measure column; missing cells stay as rows."""
    columns = [c for c in peaklist.columns if re.match(MEASURE_COLUMN, c)]
    return melt(peaklist, [id_col], columns).withColumnRenamed(id_col, "feature_id")


def melt(wide: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Long form (ids..., column, value) that keeps missing cells. NaN becomes NULL here, once."""
    quoted = [F.col(f"`{c}`") for c in columns]
    long = wide.unpivot(ids, quoted, "column", "value")
    return long.withColumn("value", missing_to_null(F.col("value")))


def assemble_abundances(long: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per (feature, sample) with the measures side by side.

    One pass and one shuffle: the measures are put side by side by conditional aggregates over a single long table
    instead of being joined from three. A measure without any column is NULL throughout; two columns of one sample
    and measure are an error.
    """
    named = long.join(columns, "column")

    def side(measure: str):
        mine = F.col("measure") == measure
        error = F.raise_error(F.lit(f"two {measure} columns for one sample"))
        return F.when(F.count_if(mine) > 1, error).otherwise(F.max(F.when(mine, F.col("value")))).alias(measure)

    return named.groupBy("feature_id", "sample_id").agg(*[side(m) for m in MEASURES])
