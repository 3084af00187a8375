"""Every query on small tables of edge cases: against SQL where there is some, else for whole and stable results."""

from __future__ import annotations

import pytest

from checks.compare import compare, duck
from peaklake.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
PER_DOCUMENT = [n for n in QUERIES if n.split("_")[0] in ("op1", "op2", "op4", "op5", "op6", "op7", "op10", "op11", "op12")]


@pytest.mark.parametrize("name", sorted(ORACLES_ := {k for k, v in ORACLES.items() if v}))
def test_matches_sql(spark, name):
    assert compare(spark, duck(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) == ""


@pytest.mark.parametrize("name", sorted(ORACLES_))
def test_edge_cases_match_sql(spark, edge_dir, name):
    assert compare(spark, duck(edge_dir), QUERIES[name], ORACLES[name], edge_dir) == ""


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_one_row_for_each_row(spark, repeat_dir, name):
    ids = [r[0] for r in QUERIES[name](spark, repeat_dir).select("doc_id").collect()]
    want = [r[0] for r in spark.read.parquet(f"{repeat_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0
