"""Operator 4: the style measures read the whole text."""

from __future__ import annotations

import pytest

from peaklake.llm.quality import FEATURES, features, zlib


def has(text: str, style: str) -> bool:
    return zlib.crc32(style.encode()) % FEATURES in features(text).tolist()


@pytest.mark.parametrize("words", [100, 800, 8000, 20_000])
def test_style_of_periodic_texts_does_not_depend_on_size(words):
    # half of the words shout, every other one: a stride of an even number of tokens sees one kind only
    text = "calm LOUD " * (words // 2)
    assert has(text, "\0upper5") and has(text, "\0marks0")
    text = "word ## " * (words // 2)
    assert has(text, "\0upper0") and has(text, "\0marks5")


def test_local_shouting_between_strides_counts():
    block = ["calm"] * 50
    block[1:40] = ["LOUD"] * 39
    assert has(" ".join(block * 400), "\0upper7")
