"""Train-aware preprocessing: normalise, log2, two-step imputation, scaling.

Every fit reads the rows with ``role = 'train'`` only and returns one row per key with arrays along the axis;
every transform joins these arrays by key and works inside the row.
"""

from __future__ import annotations

from peaklake.config import Preprocess
from peaklake.functions.hashing import draw_unit
from peaklake.functions.scalars import finite_positive
from peaklake.operators.columns import column_stats, min_positive, missing_share, pack, train_rows
from peaklake.operators.matrix import Matrix, pick
from peaklake.operators.neighbors import as_is, knn_impute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_cells(
    cells: DataFrame, samples: DataFrame, standard_id: int, drop_standard: bool = True
) -> DataFrame:
    """Divide by osmolality, then by the raw internal standard: (sample_id, feature_id, value).

    A row without a finite positive osmolality stays untouched even if its standard is valid. The factors depend
    on the sample alone, so this runs once, before any pair or fold is looked at.
    """
    standard = cells.where(F.col("feature_id") == standard_id).select(
        "sample_id", F.col("value").alias("_standard")
    )
    factors = samples.select("sample_id", F.col("mean_osmolality").alias("_osmo")).join(
        standard, "sample_id", "left"
    )
    value = F.col("value")
    scaled = F.when(
        finite_positive(F.col("_osmo")),
        F.when(finite_positive(F.col("_standard")), value / F.col("_osmo") / F.col("_standard"))
        .otherwise(value / F.col("_osmo")),
    ).otherwise(value)
    out = cells.join(factors, "sample_id")
    if drop_standard:
        out = out.where(F.col("feature_id") != standard_id)
    return out.select("sample_id", "feature_id", scaled.alias("value"))


def fit_log2(matrix: Matrix, fallback_eps: float = 1e-3) -> DataFrame:
    """keys..., eps: a fifth of the smallest positive train value of each feature, or the fallback."""
    stats = column_stats(matrix, train_rows(), low=min_positive())
    eps = F.coalesce(0.2 * F.col("low"), F.lit(fallback_eps))
    stats = stats.withColumn("eps", F.when(finite_positive(eps), eps).otherwise(fallback_eps))
    return pack(stats, matrix.keys, "eps")


def apply_log2(matrix: Matrix, stats: DataFrame) -> Matrix:
    """log2(value + eps); where the sum is not positive the cell becomes missing."""
    rows = matrix.rows.join(stats, list(matrix.keys))
    x = F.zip_with("x", "eps", lambda v, e: F.when(v + e > 0, F.log2(v + e)))
    return matrix.with_rows(rows.withColumn("x", x).drop("eps"))


def low_value_stats(matrix: Matrix, nan_threshold: float = 0.5) -> DataFrame:
    """keys..., pos, n (observed train values), base: min / 5 where the missing share reaches the threshold."""
    stats = column_stats(matrix, train_rows(), n=F.count("value"), na_share=missing_share(), low=F.min("value"))
    return stats.withColumn("base", F.when(F.col("na_share") >= nan_threshold, F.col("low") / 5.0))


def fit_low_value(matrix: Matrix, nan_threshold: float = 0.5) -> DataFrame:
    """keys..., base: a fifth of the smallest observed train value, where enough is missing, else NULL."""
    return pack(low_value_stats(matrix, nan_threshold), matrix.keys, "base")


def apply_low_value(matrix: Matrix, stats: DataFrame, noise_scale: float, seed: int) -> Matrix:
    """Fill gaps of the fitted features with base * (1 + noise_scale * u), u uniform per (sample, feature)."""
    joined = matrix.rows.join(stats, list(matrix.keys)).join(matrix.axis, list(matrix.keys))

    def fill(cell):
        u = draw_unit(seed, F.col("sample_id"), cell["feature_ids"])
        return F.coalesce(cell["x"], cell["base"] * (1.0 + noise_scale * u))

    x = F.transform(F.arrays_zip("x", "base", "feature_ids"), fill)
    return matrix.with_rows(joined.withColumn("x", x).drop("base", "feature_ids"))


def fit_scale(matrix: Matrix) -> DataFrame:
    """keys..., mean, sd (population; zero counts as one)."""
    sd = F.stddev_pop("value")
    stats = column_stats(matrix, train_rows(), mean=F.avg("value"), sd=F.when(sd == 0, 1.0).otherwise(sd))
    return pack(stats, matrix.keys, "mean", "sd")


def apply_scale(matrix: Matrix, stats: DataFrame, with_mean: bool = True, with_std: bool = True) -> Matrix:
    def scaled(cell):
        v = cell["x"] - cell["mean"] if with_mean else cell["x"]
        return v / cell["sd"] if with_std else v

    joined = matrix.rows.join(stats, list(matrix.keys))
    x = F.transform(F.arrays_zip("x", "mean", "sd"), scaled)
    return matrix.with_rows(joined.withColumn("x", x).drop("mean", "sd"))


def never_observed(matrix: Matrix) -> DataFrame:
    """keys..., feature_id of features without any train value; they cannot be imputed and are dropped."""
    stats = column_stats(matrix, train_rows(), n=F.count("value")).where(F.col("n") == 0)
    return matrix.positions().join(stats, [*matrix.keys, "pos"]).select(*matrix.keys, "feature_id")


def preprocess(matrix: Matrix, config: Preprocess, stage=as_is, views: bool = False) -> Matrix:
    """log2 -> drop what was never observed -> low-value fill -> nearest neighbours -> scale.

    Takes normalised values. ``stage`` writes a table and reads it back; with it each step is computed once and
    the statistics are joined as broadcasts of known size. ``views`` tells that keys which differ in their last part alone hold
    views of the same samples, which share one neighbour search.
    """
    logged = apply_log2(matrix, stage(fit_log2(matrix, config.fallback_eps), "log2"))
    # One pass serves both: which features were ever observed, and the base of the low-value fill.
    stats = low_value_stats(logged, config.nan_threshold)
    usable = stats.where(F.col("n") > 0).join(logged.positions(), [*matrix.keys, "pos"])
    packed = F.sort_array(F.collect_list(F.struct("pos", "feature_id", "base")))
    picked = stage(usable.groupBy(*matrix.keys).agg(packed.alias("picked")), "low")
    low = picked.select(*matrix.keys, F.col("picked.base").alias("base"))
    filled = apply_low_value(pick(logged, picked), low, config.noise_scale, config.seed)
    filled = filled.with_rows(stage(filled.rows, "filled"))
    complete = knn_impute(filled, config.k_neighbors, stage=stage, views=views)
    if not config.scale:
        return complete
    complete = complete.with_rows(stage(complete.rows, "complete"))
    return apply_scale(complete, stage(fit_scale(complete), "scale"), config.with_mean, config.with_std)
