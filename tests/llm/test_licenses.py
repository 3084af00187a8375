"""Operator 10: the canonical form of known bodies does not depend on how they are laid out."""

from __future__ import annotations

from peaklake.llm import licenses

BODIES = sorted({*licenses.TEXTS.items(), *licenses.MORE_TEXTS})


def wrapped(text: str, width: int, lead: str = "") -> str:
    """Lines of at most ``width`` letters, a single word at least."""
    lines = [""]
    for word in text.split():
        if lines[-1] and len(lines[-1]) + 1 + len(word) > width:
            lines.append("")
        lines[-1] = f"{lines[-1]} {word}".strip()
    return "\n".join(lead + line for line in lines)


def found(spark, texts: list[str]) -> list[tuple[str | None, str, str]]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return [(r["license"], r["notices"], r["canonical_sha256"]) for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_known_bodies_in_any_wrapping(spark):
    texts = [(name, wrapped(body, w, lead)) for name, body in BODIES for w in (1, 9, 70, 77, 10**6) for lead in ("", " * ")]
    assert [r[0] for r in found(spark, [t for _, t in texts])] == [name for name, _ in texts]


def test_sentences_about_copyright_stay(spark):
    whole = found(spark, ["the copyright holders be liable", "the copyright notice", "the copyright license to", "item (c) you must keep"])
    broken = found(spark, ["the\ncopyright holders be liable", "the copyright\nnotice", "the\n  copyright license to", "item\n(c) you must keep"])
    assert whole == broken and len({r[2] for r in whole}) == 4


STATEMENTS = [
    "Copyright 2020 x", "copyright (c) 2020-2024 Jane Doe", "(c) 2020 x", "© 2020 x", "(C) Jane Doe", "Copyright Jane Doe", " * Copyright: Élan SA",
    "Copyright (c) <year> <copyright holders>", "Copyright [yyyy] [name]", "# Copyright © x. All rights reserved.", "Copyright (c) holders of x",
]


def test_statements_go(spark):
    body = licenses.TEXTS["MIT"]
    texts = [f"{line}\n{more}{body}" for line in STATEMENTS for more in ("\n", "All rights reserved.\n")]
    assert {r[0] for r in found(spark, texts)} == {"MIT"}


def test_whole_files_with_title_and_copyright(spark):
    titles = {
        "MIT": "The MIT License (MIT)", "ISC": "ISC License", "Zlib": "zlib License", "BSD-2-Clause": "BSD 2-Clause License",
        "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": "Apache License, Version 2.0",
    }
    files = [(name, f"{titles[name]}\n\nCopyright (c) 2020, Jane Doe\nAll rights reserved.\n\n{body}\n") for name, body in BODIES if name in titles]
    assert {n for n, _ in files} == set(titles)
    assert [r[0] for r in found(spark, [t for _, t in files])] == [n for n, _ in files]


def test_further_bodies_from_a_table(spark):
    more = spark.createDataFrame([("X-1", "Do as you\nlike with this."), ("X-0", " ")], "license string, text string")
    docs = spark.createDataFrame([(0, "do as you like\nwith this"), (1, licenses.TEXTS["MIT"]), (2, "")], "doc_id long, text string")
    assert [r["license"] for r in licenses.scan(docs, texts=more).orderBy("doc_id").collect()] == ["X-1", "MIT", None]


def test_every_known_form_has_an_anchor(spark):
    forms = [r["form"] for r in licenses.known_forms(spark).collect()]
    pattern = licenses.anchors(forms)
    assert pattern is not None and pattern.count("|") < 24
    assert licenses.anchors(["mit", "v2"]) is None and licenses.anchors(["by the mit"]) == "(?<![a-z0-9])(?:mit)(?![a-z0-9])"


def test_lines_that_can_match_are_all_looked_up(spark, monkeypatch):
    """The same notices with and without the choice of lines, for every known text on one line in odd spelling."""
    texts = [t for _, t in licenses.known_texts()][::3]
    odd = [" ".join(t.split()).replace("icens", "icenc").upper() if i % 2 else t.replace("license", "licence") for i, t in enumerate(texts)]
    docs = [f"some prose\n{a}\nmore\n * {b}." for a, b in zip(odd, reversed(odd), strict=True)] + ["and\nnothing here", ""]
    chosen = found(spark, docs)
    monkeypatch.setattr(licenses, "ANCHORED_FORMS", 0)
    assert found(spark, docs) == chosen and sum(bool(n) for _, n, _ in chosen) > 200
