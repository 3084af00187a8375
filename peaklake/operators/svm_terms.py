"""Terms of the L1-penalised squared-hinge SVM as plain DataFrame aggregates.

For single looks at a model (objective, slope, one step); the fits themselves use the batched solver.
``rows`` is (keys..., y in 0/1, x); ``weights`` is (keys..., w array<double>, b).
"""

from __future__ import annotations

from collections.abc import Sequence

from peaklake.functions.scalars import signed_label
from peaklake.functions.vectors import linear_decision, sq_norm
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zero_weights(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(F.size("x")).alias("p")).select(
        *keys, F.array_repeat(F.lit(0.0), F.col("p")).alias("w"), F.lit(0.0).alias("b")
    )


def default_step(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., step = 1 / (2 R^2) with R the largest row norm."""
    return rows.groupBy(*keys).agg((1.0 / (2.0 * F.max(sq_norm(F.col("x"))) + 1e-12)).alias("step"))


def _slack(rows: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    y = signed_label(F.col("y"))
    margin = y * linear_decision(F.col("x"), F.col("w"), F.col("b"))
    return rows.join(weights, list(keys)).withColumn("_gap", F.greatest(F.lit(0.0), 1.0 - margin))


def svm_objective(rows: DataFrame, weights: DataFrame, keys: Sequence[str], lam: float) -> DataFrame:
    """keys..., objective."""
    penalty = F.aggregate("w", F.lit(0.0), lambda acc, v: acc + F.abs(v))
    return (
        _slack(rows, weights, keys)
        .groupBy(*keys).agg(F.avg(F.col("_gap") * F.col("_gap")).alias("loss"))
        .join(weights, list(keys))
        .select(*keys, (F.col("loss") + lam * penalty).alias("objective"))
    )


def svm_gradient(rows: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., gw array<double>, gb: slope of the mean squared hinge; partial sums leave each partition."""
    keys = list(keys)
    pull = _slack(rows, weights, keys).withColumn("_pull", -2.0 * signed_label(F.col("y")) * F.col("_gap"))
    # The intercept rides along as one more column of ones.
    parts = pull.select(*keys, F.posexplode(F.concat("x", F.array(F.lit(1.0)))).alias("pos", "v"), "_pull")
    slopes = parts.groupBy(*keys, "pos").agg(F.avg(F.col("v") * F.col("_pull")).alias("g"))
    packed = slopes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "g"))).alias("s"))
    g = F.col("s.g")
    return packed.select(*keys, F.slice(g, 1, F.size(g) - 1).alias("gw"), F.element_at(g, -1).alias("gb"))


def proximal_step(rows: DataFrame, weights: DataFrame, steps: DataFrame, keys: Sequence[str], lam: float) -> DataFrame:
    """One step: against the slope, then shrink w (not b) by step * lam."""
    moved = weights.join(svm_gradient(rows, weights, keys), list(keys)).join(steps, list(keys))
    step = F.col("step")

    def shrink(w, g):
        target = w - step * g
        return F.sign(target) * F.greatest(F.abs(target) - step * lam, F.lit(0.0))

    return moved.select(*keys, F.zip_with("w", "gw", shrink).alias("w"), (F.col("b") - step * F.col("gb")).alias("b"))
