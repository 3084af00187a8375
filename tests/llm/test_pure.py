"""The kernels without Spark, against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from peaklake.llm import decontamination, quality
from peaklake.llm.huffman import Code, code_lengths
from peaklake.llm.jaccard_join import Sets, linked
from peaklake.llm.secrets import RULES, find_spans
from peaklake.llm.wordhash import in_batches, word_hashes

WORD = re.compile(r"[^ \t-\r]+")
FRAGMENTS = [
    "token", "SECRET", "api_key", "apikey", "passwd", "'", '"', " ", ":", "=", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef",
    "é", "x", "ghp_", "A" * 36, "-----BEGIN RSA ", "PRIVATE KEY-----", "\n", "sha/+_", "q", "\x00",
]


def test_secret_spans_equal_separate_searches():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 25)))
        want = []
        for k, r in enumerate(RULES):
            for m in re.finditer(r.head + r.body, text):
                body = len(m[0]) - (re.match(r.head, m[0]).end() if r.head else 0)
                if body >= r.least:
                    want.append((m.start(), k, m.end()))
        assert [tuple(s) for s in find_spans(text)] == sorted(want)


def _lengths_by_merging(counts: list[int], limit: int) -> int:
    """Cost of the best code within the limit, by package-merge on explicit lists."""
    leaves = sorted((c, (i,)) for i, c in enumerate(counts))
    items = list(leaves)
    for _ in range(limit - 1):
        pairs = [(items[i][0] + items[i + 1][0], items[i][1] + items[i + 1][1]) for i in range(0, len(items) - 1, 2)]
        items = sorted(leaves + pairs)
    return sum(c for c, _ in items[: 2 * len(counts) - 2])


@pytest.mark.parametrize("seed", range(6))
def test_code_is_optimal_and_decodes(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 60))
    counts = (rng.pareto(0.6, n) * 10 + 1).astype(np.int64)
    lengths = code_lengths(counts, 8)
    assert (2.0 ** -lengths.astype(float)).sum() == 1 and lengths.max() <= 8
    assert (lengths * counts).sum() == _lengths_by_merging(counts.tolist(), 8)
    code = Code(lengths)
    for size in (0, 1, 255, 256, 257, 3000):
        ids = rng.integers(0, n, size)
        assert (code.decode(code.encode(ids)) == ids).all()


def test_code_of_one_id_and_unknown_ids():
    code = Code(code_lengths(np.array([0, 5, 0])))
    assert code.decode(code.encode(np.array([1, 1, 1]))).tolist() == [1, 1, 1]
    with pytest.raises(ValueError):
        code.encode(np.array([2]))


def test_word_hashes_follow_words():
    texts = ["", " ", "a", "A b\tc", "b a", "ä Ä\n", "a" * 100 + " a", " x y "]
    hashes, first = word_hashes(texts)
    words = [[w.translate(str.maketrans("ABX", "abx")) for w in WORD.findall(t)] for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert len(set(zip(hashes.tolist(), flat, strict=True))) == len(set(flat))
    assert [list(r) for r in in_batches(["abc", "", "d" * 50, "e"], 10)] == [[0, 2], [2, 3], [3, 4]]


def shingles(text: str) -> set:
    w = [x.lower() for x in WORD.findall(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sets_and_links():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    sets = Sets(texts)
    assert sets.sizes.tolist() == [len(shingles(t)) for t in texts]
    by_class = {}
    for t, c in zip(texts, sets.cls.tolist(), strict=True):
        by_class.setdefault(c, set()).add(frozenset(shingles(t)))
    assert all(len(v) == 1 for v in by_class.values()) and len(by_class) == len({frozenset(shingles(t)) for t in texts})
    data = [sets.hashes[a:b].tobytes() for a, b in zip(sets.first[:-1], sets.first[1:], strict=True)]
    for i in range(0, 199):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        if a and b:
            assert linked(data[i], data[i + 1]) == (100 * len(a & b) >= 80 * len(a | b))


def bag(words: list[str]) -> Counter:
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_no_passage_at_the_threshold_is_missed():
    rng = random.Random(3)
    items = [[f"i{k}w{rng.randrange(60)}" for _ in range(rng.randint(3, 70))] for k in range(40)]
    index = decontamination.Items([" ".join(w) for w in items])
    docs, want = [], {}
    for d in range(1500):
        k = rng.randrange(len(items))
        words = list(items[k])
        for _ in range(rng.choice([0, 1, 1, 2])):
            at, kind = rng.choice([0, 1, len(words) - 1, rng.randrange(len(words))]), rng.choice("sid")
            if kind == "i":
                words.insert(at, "new")
            elif len(words) > 1:
                words[at : at + 1] = ["new"] if kind == "s" else []
        full = [rng.choice("abc") for _ in range(rng.randint(0, 20))] + words + [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        docs.append(" ".join(full))
        m = len(items[k])
        best = 0.0
        for at in range(-10, len(full)):
            window = full[max(0, at) : max(0, at + m)]
            if window:
                a, b = bag(window), bag(items[k])
                best = max(best, (a & b).total() / (a | b).total())
        if best >= decontamination.SIMILARITY:
            want[d, k] = best
    got = {(d, k): s for d, k, _, s in index.matches(docs)}
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 1e-9 for key in want)


def test_simhash_index_finds_all_within_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    probes = np.concatenate([prints ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(3)])
    values = [(prints >> np.uint64(16 * b)).astype(np.uint16) for b in range(4)]
    order = [np.argsort(v, kind="stable") for v in values]
    begins = [np.searchsorted(v[o], np.arange((1 << 16) + 1)) for v, o in zip(values, order, strict=True)]
    index = decontamination._Index(1, prints, np.arange(300), np.zeros(300, int), order, begins)
    got = set(zip(*(x.tolist() for x in index.near(probes)), strict=True))
    near = np.bitwise_count(probes[:, None] ^ prints[None, :]) <= decontamination.RADIUS
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_classifier_separates_and_survives_no_labels():
    rng = random.Random(6)
    good = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(50)) for _ in range(60)]
    bad = [t.upper() + " %%% ###" for t in good]
    rows = [quality.features(t) for t in good + bad]
    weights = quality.train(rows, np.array([1.0] * 60 + [0.0] * 60))
    score = [weights[-1] + weights[r].sum() for r in rows]
    assert min(score[:60]) > 0 > max(score[60:])
    assert quality.train([], np.zeros(0))[-1] > 0
