"""Keyed draws.

Every random choice is a function of the md5 of a text key, so it does not depend on partitioning, on row
order or on retries of a lost task, and the same draw can be written in any SQL dialect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def draw_key(*parts) -> Column:
    """md5 of the parts joined by ``|``. Plain values are literals, columns are read."""
    return F.md5(F.concat_ws("|", *[_as_col(p).cast("string") for p in parts]))


def draw_int(*parts) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(draw_key(*parts), 1, 8), 16, 10).cast("bigint")


def draw_unit(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(*parts).cast("double") / F.lit(TWO_32)
