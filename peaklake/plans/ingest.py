"""From raw files to the star schema."""

from __future__ import annotations

import os

from peaklake.config import EXCLUDED_SAMPLE_IDS, INTERNAL_STANDARD_ID
from peaklake.functions.scalars import flag_internal_standard
from peaklake.operators.joins import join_feature_counts, n_obs_per_feature, valid_sample_ids
from peaklake.operators.sampling import stratified_split
from peaklake.sources.metadata import build_samples, read_metadata
from peaklake.sources.peaklist import assemble_abundances, column_map, melt_measures, read_peaklist
from peaklake.sources.star import Star, write_star_schema
from peaklake.workspace import Workspace
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def star_from_tables(
    peaklist: DataFrame, metadata: DataFrame, peakset_version: str, test_ratio: float = 0.2, seed: int = 42,
    excluded: tuple[str, ...] = EXCLUDED_SAMPLE_IDS, standard_id: int = INTERNAL_STANDARD_ID, stage=None,
) -> Star:
    """The three tables from a wide peak list and the sample metadata.

    With ``stage`` the fact is made once, and both the counts per feature and the sink read it back.
    """
    spark = peaklist.sparkSession
    columns = column_map(spark, peaklist)
    samples = build_samples(metadata)
    valid = valid_sample_ids(columns, samples, excluded)
    if valid.isEmpty():
        raise ValueError(f"no sample is in both inputs after excluding {list(excluded)}")
    samples = samples.join(valid, "sample_id", "left_semi")
    samples = stratified_split(samples, "condition", test_ratio, seed)
    known = columns.join(valid, "sample_id", "left_semi")
    abundances = (
        assemble_abundances(melt_measures(peaklist), known)
        .withColumn("peakset_version", F.lit(peakset_version))
        .withColumn("internal_standard", flag_internal_standard(F.col("feature_id"), standard_id))
        .select("sample_id", "feature_id", "area", "rt", "mz", "peakset_version", "internal_standard")
    )
    if stage is not None:
        abundances = stage(abundances, "abundances")
    features = join_feature_counts(
        peaklist.select(F.col("id").alias("feature_id"), "mz", "rt"), n_obs_per_feature(abundances)
    ).withColumn("internal", flag_internal_standard(F.col("feature_id"), standard_id))
    return Star(
        samples.select("sample_id", "condition", "symptomatic", "mean_osmolality", "test_split"),
        features.select("feature_id", "mz", "rt", "n_obs", "internal"),
        abundances,
    )


def build_star_schema(
    spark: SparkSession, peaklist_path: str, metadata_path: str, out_dir: str, test_ratio: float = 0.2,
    seed: int = 42, peakset_version: str | None = None, excluded: tuple[str, ...] = EXCLUDED_SAMPLE_IDS,
    standard_id: int = INTERNAL_STANDARD_ID,
) -> None:
    """Read both files, build the star schema and write it. The version defaults to the name of the peak list."""
    version = peakset_version or os.path.splitext(os.path.basename(peaklist_path.rstrip("/")))[0]
    staged = Workspace(spark, "ingest")
    star = star_from_tables(
        read_peaklist(spark, peaklist_path), read_metadata(spark, metadata_path), version, test_ratio, seed,
        excluded, standard_id, staged.stage,
    )
    write_star_schema(star, out_dir)
    staged.close()
