"""Operator 8: benchmark decontamination by SimHash of item-sized windows.

Every document is read through windows of word counts that follow the item sizes, at every word. The SimHash (64 bits)
of a window is compared with those of the items' own windows of that size: fingerprints are cut into four blocks of 16
bits, and each block is an index, so by the pigeonhole principle no fingerprint within three bits is missed. A candidate
names an item and a place; the exact weighted-shingle similarity (multiset Jaccard over five-word shingles, weighted by
their counts) of the item with the item-sized window there decides.

The window of an item of m words is the longest run of words that *any* passage with similarity 0.8 or more must have in
common with it, rounded down to a grid of sizes: at most n/5 of its n shingles can be missing, an edit inside costs at
least four, so the missing ones leave at most x/4 + 1 runs. Such a run has the same fingerprint on both sides, hence no
passage at or above the threshold is missed, whatever its edits; the radius adds passages whose windows differ.

Items are a given query set. They are read in blocks of at most ``BLOCK_WORDS`` words, each shipped to the tasks as one
table of bounded size and matched with all documents in a map; nothing is shuffled.

Letters of any script are compared in lower case.

Defined results: null or empty items and documents match nothing; an item of fewer than five words matches the same
words as a whole; null and repeated ids, items and rows are reported like others, one row for each document row and item row;
among equally similar places the first is reported; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peaklake.llm.common import arrow_rows, byte_batches, text_or_empty, text_slices, workspace
from peaklake.llm.wordhash import SHINGLE, in_batches, shingle_hashes, word_hashes

SIMILARITY = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 3, 4, 16
GRID = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 28, 36, 46, 59, 75, 96, 123)  # below 128: window counts fit a byte
BLOCK_WORDS = 2_000_000
U = np.uint64
_ONES = U(0x0101010101010101)
_TOPS = U(0x8080808080808080)


def window_words(words: int) -> int:
    """Size of the windows that stand for an item of so many words."""
    if words < SHINGLE:
        return words
    n = words - SHINGLE + 1
    missing = int(n * (1 - SIMILARITY) + 1e-9)
    run = (n - missing) // (missing // (SHINGLE - 1) + 1) + SHINGLE - 1
    return max(g for g in GRID if g <= run)


def running_bits(words: np.ndarray) -> list[np.ndarray]:
    """Running sums of the hash bits of words, eight bits side by side in each of eight arrays."""
    out = []
    for j in range(8):
        sums = np.zeros(len(words) + 1, U)
        np.cumsum((words >> U(j)) & _ONES, out=sums[1:])
        out.append(sums)
    return out


def simhashes(sums: Sequence[np.ndarray], size: int) -> np.ndarray:
    """Fingerprint of every window of ``size`` consecutive words: the majority of each hash bit."""
    n = len(sums[0]) - size
    out = np.zeros(max(0, n), U)
    lift = U(128 - (size // 2 + 1)) * _ONES
    for j, s in enumerate(sums):
        out |= (((s[size:] - s[:n]) + lift & _TOPS) >> U(7)) << U(j)
    return out


class _Index(NamedTuple):
    """Item windows of one size: fingerprints, and for every block where each of its values begins in ``order``."""

    size: int
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    order: list[np.ndarray]
    begins: list[np.ndarray]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, k) such that prints[i] and self.prints[k] differ in at most RADIUS bits."""
        found_i, found_k = [], []
        for block in range(BLOCKS):
            value = (prints >> U(block * BLOCK_BITS)).astype(np.uint16)
            begins = self.begins[block]
            there = np.flatnonzero(begins[value.astype(np.int64) + 1] > begins[value])
            low, high = begins[value[there]], begins[value[there].astype(np.int64) + 1]
            counts = high - low
            i = np.repeat(there, counts)
            k = self.order[block][np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
            close = np.bitwise_count(prints[i] ^ self.prints[k]) <= RADIUS
            found_i.append(i[close])
            found_k.append(k[close])
        return np.concatenate(found_i), np.concatenate(found_k)


class Items:
    """One block of benchmark items, ready to be matched."""

    def __init__(self, texts: Sequence[str]):
        words, first = word_hashes([t.lower() for t in texts])
        self.words = np.diff(first)
        hashes, at = shingle_hashes(words, first)
        self.bags = [Counter(hashes[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
        sums = running_bits(words)
        windows: dict[int, list[tuple[int, int]]] = {}
        for i, m in enumerate(self.words):
            if m:
                size = window_words(int(m))
                windows.setdefault(size, []).extend((i, o) for o in range(int(m) - size + 1))
        self.indexes = []
        for size, members in sorted(windows.items()):
            item, offset = np.array(members).T
            prints = simhashes(sums, size)[first[item] + offset]
            order, begins = [], []
            for block in range(BLOCKS):
                value = (prints >> U(block * BLOCK_BITS)).astype(np.uint16)
                order.append(np.argsort(value, kind="stable"))
                begins.append(np.searchsorted(value[order[-1]], np.arange((1 << BLOCK_BITS) + 1)))
            self.indexes.append(_Index(size, prints, item, offset, order, begins))

    def matches(self, texts: Sequence[str]) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, first word, similarity) of the best place of every item in every text."""
        for low, high in in_batches(texts):
            words, first = word_hashes([t.lower() for t in texts[low:high]])
            if len(words):
                for doc, item, start, similar in self._verified(words, first):
                    yield low + doc, item, start, similar

    def _verified(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        sums = running_bits(words)
        candidates: set[tuple[int, int, int]] = set()
        for index in self.indexes:
            prints = simhashes(sums, index.size)
            i, k = index.near(prints)
            inside = owner[i] == owner[i + index.size - 1] if len(i) else np.zeros(0, bool)
            i, k = i[inside], k[inside]
            candidates.update(zip(owner[i].tolist(), index.item[k].tolist(), (i - index.offset[k]).tolist(), strict=True))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for doc, item, start in sorted(candidates):
            slack = int(self.words[item] * (1 - SIMILARITY)) + 1
            for at in range(start - slack, start + slack + 1):
                if (doc, item, at) in seen:
                    continue
                seen.add((doc, item, at))
                similar = self._similarity(words, int(first[doc]), int(first[doc + 1]), item, at)
                if similar >= SIMILARITY - 1e-12 and (-similar, at) < best.get((doc, item), (1.0, 0)):
                    best[doc, item] = (-similar, at)
        for (doc, item), (similar, at) in sorted(best.items()):
            yield doc, item, max(0, at - int(first[doc])), -similar

    def _similarity(self, words: np.ndarray, low: int, high: int, item: int, at: int) -> float:
        """Multiset Jaccard of the item and the item-sized window at ``at``, cut at the ends of the text."""
        window = words[max(low, at) : max(low, min(high, at + int(self.words[item])))]
        if not len(window):
            return 0.0
        bag = Counter(shingle_hashes(window, np.array([0, len(window)]))[0].tolist())
        both = (bag & self.bags[item]).total()
        return both / (bag.total() + self.bags[item].total() - both)


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Items in blocks of bounded size, read partition by partition through a staged table."""
    rows = workspace(benchmark.sparkSession, "decontamination").stage(
        benchmark.select(F.col(item_col).alias("item"), text_or_empty(text_col).alias("t")).where("trim(t) <> ''"), "items"
    )
    ids, texts, held = [], [], 0
    for row in rows.toLocalIterator():
        if held + len(row["t"]) // 2 > BLOCK_WORDS and ids:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["item"])
        texts.append(row["t"])
        held += len(row["t"]) // 2 + 1
    if ids:
        yield ids, texts


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item, first_word, similarity): the best place of every item in every document that contains it.

    The result of each block of items is staged before the next one is read, so the driver holds one block at a time.
    """
    key, item_type = (f.select(c).schema[0].dataType for f, c in ((docs, id_col), (benchmark, item_col)))
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    schema = f"id {key.simpleString()}, item {item_type.simpleString()}, first_word bigint, similarity double"
    work = workspace(docs.sparkSession, "leaks")
    found = docs.sparkSession.createDataFrame([], schema)
    for ids, texts in _item_blocks(benchmark, item_col, item_text_col):
        with arrow_rows(docs.sparkSession):
            found = found.unionByName(work.stage(source.mapInArrow(_matcher(ids, texts), schema), "block"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "first_word", F.round("similarity", 9).alias("similarity"))


def _matcher(ids: list, texts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(texts)
        for batch in byte_batches(batches):
            rows = list(items.matches(batch.column(1).to_pylist()))
            doc = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array([ids[r[1]] for r in rows]), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.float64())],
                ["id", "item", "first_word", "similarity"],
            ) if rows else pa.RecordBatch.from_arrays([doc, pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["id", "item", "first_word", "similarity"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, in their own columns; what is left after each block of items is staged."""
    out, work = docs, workspace(docs.sparkSession, "no-leaks")
    for _, texts in _item_blocks(benchmark, item_col, item_text_col):
        with arrow_rows(docs.sparkSession):
            out = work.stage(out.where(~_leak_flag(texts)(text_or_empty(text_col))), "left")
    return out


def _leak_flag(texts: list[str]):
    @F.arrow_udf("boolean")
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(texts)
        for batch in batches:
            flags, start = np.zeros(len(batch), bool), 0
            for part in text_slices(batch):
                flags[[start + r[0] for r in items.matches(part)]] = True
                start += len(part)
            yield pa.array(flags)

    return leaks
