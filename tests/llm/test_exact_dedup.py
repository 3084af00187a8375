"""Operator 2: columns that bear the name of the file's own metadata, and paths that end in a slash."""

from __future__ import annotations

from pyspark.sql import functions as F

from peaklake.llm.exact_dedup import deduplicate


def test_clashing_column_and_trailing_slash(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("_metadata", "at", "digest")})
    docs.repartition(2).write.parquet(str(tmp_path / "docs"))
    for path in (f"{tmp_path}/docs", f"{tmp_path}/docs/"):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in deduplicate(spark, path).collect()}
        assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True)}
