"""Operator 7: ids against the tokenizer, whole files against both, tables that run full, and clashing hashes."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peaklake.llm import token_output as out
from peaklake.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "B", " ", "\n", "é", "日", "'s", "'", "1", "23", ".", ",", "<|endoftext|>", "\t", "\xa0", " ", "　", "𝔘", "-", "ll", "n't", "\x00", "\x1f", "é"]


@pytest.fixture(scope="module")
def tokens():
    return out.Tokens(PATH)


def expected(tokens, texts):
    return [np.array([*e.ids, 0], "<u2").tobytes() for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_random_strings(tokens):
    draw = random.Random(1)
    weights = [4 if c == " " else 2 if c == "\n" else 0.05 if c.isspace() or c.startswith("<") else 1 for c in ALPHABET]
    for _ in range(40):
        texts = ["".join(draw.choices(ALPHABET, weights, k=draw.randint(0, 14))) for _ in range(1000)]
        assert tokens.encode(pa.array(texts, pa.string())) == expected(tokens, texts)


@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    tokens = out._tokens(PATH)
    assert tokens.encode(pa.array(texts, pa.string())) == expected(tokens, texts)


def test_full_table_and_equal_hashes_change_nothing(tokens, monkeypatch):
    texts = ["one two, three\nfour", "five two one", "", "three, one\nsix"] * 3
    fresh = out.Tokens(PATH)
    monkeypatch.setattr(out, "MEMO_WORDS", 3)
    for _ in range(4):
        assert fresh.encode(pa.array(texts)) == expected(tokens, texts)
    plain = out._hashes
    monkeypatch.setattr(out, "_hashes", lambda *a: plain(*a) % np.uint64(3))  # many parts share a hash
    other = out.Tokens(PATH)
    for _ in range(2):
        assert other.encode(pa.array(texts)) == expected(tokens, texts)


def test_another_kind_of_line_end():
    """Where the line end is not one token, parts are tokenized one by one."""
    fresh = out.Tokens(PATH)
    fresh.line = np.concatenate((fresh.line, fresh.line))[:2]
    rows = ["ab", "cd ef"]
    assert fresh.encode(pa.array(rows)) == expected(fresh, rows)


def test_files_hold_what_the_tokenizer_gives(spark, repeat_dir, tokens):
    docs = spark.read.parquet(f"{repeat_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text or "" for r in docs]
    ids = [np.frombuffer(b, "<u2").astype("<u4") for b in expected(tokens, texts)]
    got = QUERIES["op7_token_output"](spark, repeat_dir).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d.doc_id), len(i), zlib.crc32(i.tobytes())) for d, i in zip(docs, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)


@pytest.mark.parametrize("block_ids", [7, 1 << 20])
def test_round_trip_in_small_blocks(spark, workspace, tokens, block_ids):
    texts = [f"text number {i} " + "word " * (i % 9) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = f"{workspace.path}/files"
    out.write_tokens(docs, path, PATH, block_ids=block_ids)
    rows = out.read_tokens(spark, path).orderBy("doc_id").collect()
    want = [np.frombuffer(b, "<u2").astype("<u4").tobytes() for b in expected(tokens, texts)]
    assert [bytes(r.ids) for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0, *[len(w) // 4 for w in want[:-1]]]).tolist()
