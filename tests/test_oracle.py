"""Every registered query with a SQL counterpart, against DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from tests.conftest import SF_DIR

ORACLES = {k: sql for k, sql in entry.oracle_sql().items() if k in entry.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], ORACLES[name], SF_DIR) == ""


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["pair", "feature_id", "condition", "n", "n_observed", "mean", "sd"]
    assert df.limit(1).count() == 1


def test_registry_names():
    names = entry.queries()
    assert set(ORACLES) <= set(names)
    assert not any(n.startswith(("pipeline", "op")) for n in entry.QUERIES)
