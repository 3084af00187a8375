"""Operator 3: wide nodes and deep paths, against what the tree must say."""

from __future__ import annotations

import pytest

from peaklake.llm import url_filter


def judged(spark, paths: dict[str, list[int]]) -> dict[str, tuple[str, str]]:
    """Verdict and template of each path of one host, with its labels."""
    pages = spark.createDataFrame([(i, f"http://h.org{p}") for i, p in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([("h.org", p, g) for p, gs in paths.items() for g in gs], "host string, path string, good int")
    rows = url_filter.judge(pages, labels, rules=()).collect()
    assert len(rows) == len(paths)
    return {r["path"]: (r["verdict"], r["template"]) for r in rows}


@pytest.mark.parametrize("siblings,pages", [(63, 3), (64, 3), (300, 3), (300, 1)])
def test_a_bad_section_is_rejected_however_many_siblings(spark, siblings, pages):
    paths = {f"/s{i}/{k}": [1] for i in range(siblings) for k in range(pages)}
    paths |= {f"/spam/{k}": [0] * 10 for k in range(20)}
    got = judged(spark, paths)
    assert {v for p, (v, _) in got.items() if p.startswith("/spam/")} == {"block"}
    assert {v for p, (v, _) in got.items() if not p.startswith("/spam/")} == {"allow"}
    assert {t for p, (_, t) in got.items() if p.startswith("/spam/")} == {"h.org/spam/#"}
    assert max(len(t) for _, t in got.values()) < 500


def test_deep_branches_have_templates_of_their_own(spark):
    paths = {f"/a/b/c/d/e/{name}/{k}": [good] * 10 for name, good in (("spam", 0), ("news", 1)) for k in range(20)}
    paths |= {"/a/b/c/d/e/": [], "/a//b": [], "": []}
    got = judged(spark, paths)
    assert got["/a/b/c/d/e/spam/7"] == ("block", "h.org/a/b/c/d/e/spam/#")
    assert got["/a/b/c/d/e/news/7"] == ("allow", "h.org/a/b/c/d/e/news/#")
    assert got["/a/b/c/d/e/"][1] == "h.org/a/b/c/d/e" and got["/a//b"][1] == "h.org/a/b" and got[""][1] == "h.org"
