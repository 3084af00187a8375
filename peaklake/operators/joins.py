"""Checks and joins between the three tables of the star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "test", "all", None)


def query_samples(
    samples: DataFrame,
    conditions: Sequence[str] | None = None,
    symptomatic: Sequence[str] | None = None,
    split: str | None = None,
    label_col: str = "condition",
    require: bool = False,
) -> DataFrame:
    """Samples of the given labels, symptom states and split. All filters reach the scan.

    ``require`` runs a one-row job and raises if nothing is left.
    """
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    out = samples
    if conditions is not None:
        out = out.where(F.col(label_col).isin(*conditions))
    if symptomatic is not None:
        out = out.where(F.col("symptomatic").isin(*symptomatic))
    if split in ("train", "test"):
        flag = F.col("test_split")
        out = out.where(flag if split == "test" else ~flag)
    if require and out.isEmpty():
        raise ValueError(f"no sample for {conditions=}, {symptomatic=}, {split=}")
    return out


def exclude_samples(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Drop the listed ids. The list is a short fixed parameter, so this is a filter, not a join."""
    return df.where(~F.col("sample_id").isin(*ids)) if ids else df


def valid_sample_ids(peak_ids: DataFrame, metadata_ids: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Ids present on both sides, minus the exclusions."""
    return exclude_samples(
        peak_ids.select("sample_id").intersect(metadata_ids.select("sample_id")), excluded
    )


def missing_sample_count(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: how many samples of the cells have no metadata."""
    ids = cells.select("sample_id").distinct()
    return ids.join(samples.select("sample_id"), "sample_id", "left_anti").agg(
        F.count(F.lit(1)).alias("n_missing")
    )


def require_metadata(cells: DataFrame, samples: DataFrame) -> None:
    n = missing_sample_count(cells, samples).first()["n_missing"]
    if n:
        raise ValueError(f"{n} samples of the matrix are missing from the metadata")


def n_obs_per_feature(abundances: DataFrame) -> DataFrame:
    return abundances.groupBy("feature_id").agg(F.count("area").alias("n_obs"))


def join_feature_counts(features: DataFrame, counts: DataFrame) -> DataFrame:
    return features.join(counts, "feature_id", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))


def union_distinct_samples(*parts: DataFrame) -> DataFrame:
    """Concatenate sample tables and keep one row per sample."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["sample_id"])
