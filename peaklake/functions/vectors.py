"""Expressions over matrix rows held as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dense(entries: Column, size: Column) -> Column:
    """Array of ``size`` values from structs (pos, value) in any order; absent positions become NULL.

    The absent positions are found by a hash difference and the whole is put in order by one sort, so a
    row costs p log p, not one map lookup per position.
    """
    every = F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    absent = F.array_except(every, entries.getField("pos"))
    gaps = F.transform(absent, lambda i: F.struct(i.alias("pos"), F.lit(None).cast("double").alias("value")))
    return F.sort_array(F.concat(entries, gaps)).getField("value")


def take_positions(x: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.get(x, i))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)


def linear_decision(x: Column, w: Column, intercept: Column) -> Column:
    return dot(x, w) + intercept


def linear_predict(decision: Column) -> Column:
    """Sign of the decision; zero counts as positive."""
    return F.when(decision >= 0, 1).otherwise(-1)


def has_gap(x: Column) -> Column:
    return F.exists(x, lambda v: v.isNull())
