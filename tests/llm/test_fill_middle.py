"""Operator 12: cuts against plain strings, the index both ways, and the exact text from every output."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peaklake.llm import fill_middle as fm

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "a", " a", "a ", "ä", "日本 語\n", "x<P>y", "<S", "<M>", "a<", ">b", "𝔘𝔫𝔦 code é x", " wide ", "word " * 20_000, "é" * 5000 + " " * 100,
    "\r\n\t\x0b\x0cx", "é z", "<<P<S", "a\x00b c",
]


def expected(doc_id, text, rule):
    text = text or ""
    digits = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = TOKEN.findall(text) if rule.unit == "token" else list(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rule.fim_percent:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < rule.spm_percent
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_index_converts_both_ways(text):
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    text = data.tobytes().decode()
    index = fm.ExceptionIndex(data)
    want = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert index.n_chars == len(text)
    assert index.to_bytes(range(len(text) + 1)).tolist() == want
    assert index.to_chars(want).tolist() == list(range(len(text) + 1))
    assert len(index.bytes) == sum(ord(c) > 127 for c in text)
    ends = [len(text[: m.end()].encode()) for m in TOKEN.finditer(text)]
    assert fm.token_ends(data).tolist() == ends


@pytest.mark.parametrize("rule", [fm.Rule(), fm.Rule("char"), fm.Rule("token", 7, 100, 0), fm.Rule("char", 7, 100, 100), fm.Rule("char", 1, 0, 0)])
def test_outputs_and_texts_from_them(spark, rule):
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(TEXTS * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form int")  # a column named like a result
    done = fm.transform(docs.repartition(3), rule).withColumn("back", fm.restore())
    assert done.columns[:2] == ["doc_id", "text"]
    got = sorted(map(repr, ((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in done.collect())))
    assert got == sorted(repr((i, t, *expected(i, t, rule), t or "")) for i, t, _ in rows)


def test_bytes_of_the_cuts(spark):
    docs = spark.createDataFrame([(i, "é日𝔘a " * (i % 7)) for i in range(60)], "doc_id long, text string")
    for r in fm.transform(docs, fm.Rule(fim_percent=100)).where("form <> 'plain'").collect():
        prefix, both = r.text[: r.prefix_chars], r.text[: r.prefix_chars + r.middle_chars]
        assert (r.prefix_bytes, r.prefix_bytes + r.middle_bytes) == (len(prefix.encode()), len(both.encode()))


def test_unknown_unit():
    with pytest.raises(ValueError, match="unit"):
        fm.Rule("byte")
