"""Scalar expressions of the ingest and of the pair encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns of the raw files.
MEASURE_COLUMN = r"^datafile:.*CSU-TB-(\d+)\.mzML:(area|rt|mz)$"
SAMPLE_TOKEN = r"CSU-TB-(\d+)"
MEASURES = ("area", "rt", "mz")
SAMPLE_ID_WIDTH = 5
PAIR_SEPARATOR = "_vs_"


def zfill(col: Column, width: int = SAMPLE_ID_WIDTH) -> Column:
    """Left-pad with zeros; longer text is kept whole (``lpad`` alone would cut it)."""
    return F.when(F.length(col) < width, F.lpad(col, width, "0")).otherwise(col)


def missing_to_null(col: Column) -> Column:
    """NaN is a missing value at the sources; inside the library only NULL is."""
    return F.when(~F.isnan(col), col)


def coerce_numeric(col: Column) -> Column:
    """Text to double; anything that is not a number is missing."""
    return missing_to_null(col.try_cast("double"))


def finite_positive(col: Column) -> Column:
    return F.coalesce((col > 0) & (col < F.lit(float("inf"))), F.lit(False))


def extract_sample_id(col: Column) -> Column:
    """First sample token in the text as a padded id; NULL if there is none."""
    digits = F.regexp_extract(col, SAMPLE_TOKEN, 1)
    return F.when(digits != "", zfill(digits))


def derive_condition(sample_type: Column, visit_day: Column) -> Column:
    st = F.upper(F.coalesce(sample_type, F.lit("")))
    activation = F.upper(F.coalesce(visit_day, F.lit(""))).contains("ACTIVATION")
    return (
        F.when(st.contains("CONTROL"), "control")
        .when(st.contains("INCIDENT") & ~activation, "incident")
        .when(st.contains("PREVALENT"), "prevalent")
        .when(activation, "activated")
        .otherwise("unknown")
    )


def derive_symptomatic(col: Column) -> Column:
    text = F.trim(F.upper(F.coalesce(col, F.lit(""))))
    return F.when(text == "NEGATIVE", "-").when(text == "POSITIVE", "+").otherwise("unknown")


def row_mean_skipna(*cols: Column) -> Column:
    """Mean of the readings that are present; NULL if none is."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(total, present)


def flag_internal_standard(feature_id: Column, standard_id: int) -> Column:
    return feature_id == F.lit(standard_id)


def pair_label(negative: Column | str, positive: Column | str) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.concat_ws(PAIR_SEPARATOR, as_col(negative), as_col(positive))


def parse_pair(label: Column) -> Column:
    """Struct (negative, positive), split at the first separator; an error if there is none."""
    parts = F.split(label, PAIR_SEPARATOR, 2)
    bad = F.raise_error(F.concat(F.lit("not a pair label: "), label))
    return F.when(
        label.contains(PAIR_SEPARATOR),
        F.struct(parts[0].alias("negative"), parts[1].alias("positive")),
    ).otherwise(bad)


def encode_label(value: Column, negative: Column | str, positive: Column | str) -> Column:
    """negative -> 0, positive -> 1, anything else is an error."""
    bad = F.raise_error(F.concat(F.lit("unexpected label: "), F.coalesce(value, F.lit("NULL"))))
    return F.when(value == negative, 0).when(value == positive, 1).otherwise(bad.cast("int"))


def signed_label(y: Column) -> Column:
    return 2 * y - 1
