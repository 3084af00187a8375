"""Classification metrics, votes and choices over keyed predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("bacc", "precision", "recall", "f1")


def confusion_counts(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., tp, fp, fn, tn from (y, pred) in 0/1; one pass with map-side combine."""
    y, pred = F.col("y") == 1, F.col("pred") == 1
    return predictions.groupBy(*keys).agg(
        F.count_if(y & pred).alias("tp"),
        F.count_if(~y & pred).alias("fp"),
        F.count_if(y & ~pred).alias("fn"),
        F.count_if(~y & ~pred).alias("tn"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def metric_columns(prefix: str = "") -> list[Column]:
    """Balanced accuracy, precision, recall and F1 from the four counts; 0 on division by zero.

    Balanced accuracy averages the recall of the classes that occur in the truth.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg = tp + fn, tn + fp
    recall, specificity = _ratio(tp, pos), _ratio(tn, neg)
    bacc = (
        F.when((pos > 0) & (neg > 0), (recall + specificity) / 2.0).when(pos > 0, recall).otherwise(specificity)
    )
    values = (bacc, _ratio(tp, tp + fp), recall, _ratio(2 * tp, 2 * tp + fp + fn))
    return [v.alias(prefix + name) for name, v in zip(METRICS, values)]


def classification_metrics(predictions: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    return confusion_counts(predictions, keys).select(*keys, *metric_columns(prefix))


def mean_fold_score(scores: DataFrame, keys: Sequence[str], *columns: str, models: DataFrame | None = None) -> DataFrame:
    """Mean over the folds of each model; a model of ``models`` (keys...) without any fold scores 0.0."""
    means = scores.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
    if models is None:
        return means
    every = models.select(*keys).distinct().join(means, list(keys), "left")
    return every.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def argmax_c(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """keys..., best_C, best_score: highest finite score, ties go to the smallest C."""
    s = F.col(score)
    usable = scores.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))))
    return usable.groupBy(*keys).agg(
        F.min_by("C", F.struct(-s, F.col("C"))).alias("best_C"), F.max(score).alias("best_score")
    )


def majority_vote(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., sample_id, y, pred: positive with at least half of the votes."""
    return predictions.groupBy(*keys, "sample_id").agg(
        F.first("y").alias("y"),
        F.when(F.sum("pred") * 2 >= F.count("pred"), 1).otherwise(0).alias("pred"),
    )


def selection_counts(weights: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """keys..., feature_id, n_selections: in how many models the weight is not zero."""
    return (
        weights.where(F.abs("weight") > tol)
        .groupBy(*keys, "feature_id")
        .agg(F.count(F.lit(1)).alias("n_selections"))
    )


def min_selections_sets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., min_selections, feature_id: for k = 1..max the features selected at least k times.

    A feature with n selections belongs to the sets 1..n, so each row unrolls by itself: no theta join.
    """
    best = counts.groupBy(*keys, "feature_id").agg(F.max("n_selections").alias("n_selections"))
    return best.where(F.col("n_selections") > 0).select(
        *keys,
        F.explode(F.sequence(F.lit(1), F.col("n_selections").cast("int"))).alias("min_selections"),
        "feature_id",
    )
