"""Samples x features matrices.

A matrix is held as one row per (key, sample) with the values in an ``array<double>`` that follows the feature
order of the key; NULL is a missing cell. A row is as long as the feature dimension, never as long as the data.
Keys are the loops of a study (comparison, fold, replicate): they are columns, so one plan serves them all.
Column statistics explode the arrays and aggregate with map-side combine; nothing is ever gathered by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peaklake.functions.vectors import dense, take_positions


@dataclass(frozen=True)
class Matrix:
    rows: DataFrame  # keys..., sample_id, attributes..., x
    axis: DataFrame  # keys..., feature_ids (sorted)
    keys: tuple[str, ...]

    def with_rows(self, rows: DataFrame) -> "Matrix":
        return Matrix(rows, self.axis, self.keys)

    def map_x(self, x: Column) -> "Matrix":
        return self.with_rows(self.rows.withColumn("x", x))

    def positions(self) -> DataFrame:
        """keys..., pos, feature_id."""
        return self.axis.select(*self.keys, F.posexplode("feature_ids").alias("pos", "feature_id"))

    def cells(self, *attributes: str) -> DataFrame:
        """Long form: keys..., sample_id, attributes..., feature_id, value; missing cells included."""
        zipped = F.explode(F.arrays_zip(F.col("feature_ids"), F.col("x"))).alias("cell")
        return (
            self.rows.join(self.axis, list(self.keys))
            .select(*self.keys, "sample_id", *attributes, zipped)
            .select(
                *self.keys,
                "sample_id",
                *attributes,
                F.col("cell.feature_ids").alias("feature_id"),
                F.col("cell.x").alias("value"),
            )
        )

    def exploded(self, *attributes: str, where: Column | None = None) -> DataFrame:
        """keys..., attributes..., pos, value: the input of column statistics."""
        rows = self.rows if where is None else self.rows.where(where)
        return rows.select(*self.keys, *attributes, F.posexplode("x").alias("pos", "value"))


def feature_axis(features: DataFrame) -> DataFrame:
    """One row with the sorted feature ids. Its length is the length of every matrix row."""
    return features.agg(F.sort_array(F.collect_set("feature_id")).alias("feature_ids"))


def row_vectors(cells: DataFrame, samples: DataFrame, axis: DataFrame) -> DataFrame:
    """Add ``x`` to every sample: its cells in the order of the axis, absent cells as NULL.

    ``cells`` is (sample_id, feature_id, value). Samples without any cell keep an all-NULL row; cells of other
    features or samples are ignored; a repeated (sample, feature) is an error. One shuffle, by sample.
    """
    places = axis.select(F.posexplode("feature_ids").alias("pos", "feature_id"))
    size = axis.select(F.size("feature_ids")).scalar()
    observed = (
        cells.join(places, "feature_id")
        .groupBy("sample_id")
        .agg(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"))).alias("entries"))
    )
    empty = F.array().cast("array<struct<pos:int,value:double>>")
    joined = samples.join(observed, "sample_id", "left").withColumns(
        {"entries": F.coalesce("entries", empty), "_size": size}
    )
    repeated = F.size(F.array_distinct(F.col("entries.pos"))) < F.size("entries")
    error = F.raise_error(F.concat(F.lit("repeated feature in sample "), F.col("sample_id")))
    x = F.when(repeated, error.cast("array<double>")).otherwise(dense(F.col("entries"), F.col("_size")))
    return joined.withColumn("x", x).drop("entries", "_size")


def keyed_matrix(vectors: DataFrame, axis: DataFrame, membership: DataFrame, keys: Sequence[str]) -> Matrix:
    """Repeat the sample vectors for every key they belong to.

    ``membership`` is (keys..., sample_id, attributes...). All keys start with the whole axis.
    """
    keys = tuple(keys)
    rows = membership.join(vectors.select("sample_id", "x"), "sample_id")
    axes = membership.select(*keys).distinct().withColumn(
        "feature_ids", axis.select("feature_ids").scalar()
    )
    return Matrix(rows, axes, keys)


def keep_features(matrix: Matrix, kept: DataFrame) -> Matrix:
    """Restrict each key to the features listed for it in ``kept`` (keys..., feature_id).

    Unknown ids are ignored; a key without any feature left disappears.
    """
    picked = (
        matrix.positions()
        .join(kept, [*matrix.keys, "feature_id"], "left_semi")
        .groupBy(*matrix.keys)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "feature_id"))).alias("picked"))
    )
    return pick(matrix, picked)


def dropped_features(
    keyed: DataFrame, first: DataFrame, standard_id: int | None, steps: Sequence[tuple[str, DataFrame]], keys: Sequence[str]
) -> DataFrame:
    """keys..., feature_id, reason: the features of the first axis that a key no longer has.

    ``first`` is (feature_ids); each step names a reason and gives the axes (keys..., feature_ids) after it, in order. A
    feature is listed with the first step that lacks it; a key without an axis after a step has lost all of them there.
    """
    keys = list(keys)
    left = keyed.select(*keys).distinct().withColumn("_left", first.select("feature_ids").scalar())
    is_standard = lambda f: F.lit(False) if standard_id is None else f == standard_id
    gone = F.transform(F.filter("_left", is_standard), _entry("internal standard"))
    left = left.withColumn("_gone", gone).withColumn("_left", F.filter("_left", lambda f: ~is_standard(f)))
    for reason, axis in steps:
        after = left.join(axis.select(*keys, F.col("feature_ids").alias("_now")), keys, "left")
        lost = F.array_except("_left", F.coalesce("_now", F.slice("_left", 1, 0)))
        entries = F.transform("_lost", _entry(reason))
        after = after.withColumn("_lost", lost)
        left = after.select(
            *keys, F.array_except("_left", "_lost").alias("_left"), F.concat("_gone", entries).alias("_gone")
        )
    return left.select(*keys, F.explode("_gone").alias("_g")).select(*keys, "_g.feature_id", "_g.reason")


def _entry(reason: str):
    return lambda f: F.struct(f.alias("feature_id"), F.lit(reason).alias("reason"))


def pick(matrix: Matrix, picked: DataFrame) -> Matrix:
    """Apply a (keys..., picked array<struct<pos, feature_id>>) selection."""
    rows = matrix.rows.join(picked, list(matrix.keys)).withColumn(
        "x", take_positions(F.col("x"), F.col("picked.pos"))
    )
    axis = picked.select(*matrix.keys, F.col("picked.feature_id").alias("feature_ids"))
    return Matrix(rows.drop("picked"), axis, matrix.keys)


def densify_cells(cells: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """Every sample gets every feature, absent cells as NULL: (sample_id, feature_id, value).

    Goes through the sample vectors, so no samples x features join is made.
    """
    axis = feature_axis(features)
    vectors = row_vectors(cells, samples.select("sample_id"), axis)
    listed = vectors.withColumn("feature_ids", axis.select("feature_ids").scalar())
    zipped = F.explode(F.arrays_zip(F.col("feature_ids"), F.col("x"))).alias("cell")
    return listed.select("sample_id", zipped).select(
        "sample_id", F.col("cell.feature_ids").alias("feature_id"), F.col("cell.x").alias("value")
    )


def pivot_matrix(cells: DataFrame, samples: DataFrame, feature_ids: Sequence[int]) -> DataFrame:
    """Wide form for small feature sets: one column ``f<id>`` per feature, one row per sample with a cell.

    Feature names are given, so no job is spent on finding them. For many features use ``row_vectors``.
    """
    wanted = cells.join(samples.select("sample_id"), "sample_id", "left_semi")
    value = lambda i: F.when(F.col("feature_id") == i, F.col("value"))
    count = lambda i: F.count_if(F.col("feature_id") == i)
    columns = [
        F.when(count(i) > 1, F.raise_error("repeated (sample, feature)").cast("double"))
        .otherwise(F.max(value(i)))
        .alias(f"f{i}")
        for i in sorted(feature_ids)
    ]
    return wanted.groupBy("sample_id").agg(*columns)
