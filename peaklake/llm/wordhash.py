"""Hashes of words and word shingles of many texts at once, in NumPy.

A word is a maximal run without ASCII white space (0x20, 0x09-0x0D); A-Z count as a-z. A word's hash is a polynomial
over mixed byte values modulo 2**64, taken from running sums over the joined bytes, so no word is touched one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

SHINGLE = 5
BATCH_BYTES = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _BASE ** -i for i < 2 ** bits."""
    up, down = np.full(1 << bits, U(_BASE)), np.full(1 << bits, U(_INVERSE))
    up[0] = down[0] = U(1)
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the number of all words)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(max(19, int(len(joined) + 1).bit_length()))
    sums = np.zeros(len(joined) + 1, U)
    np.cumsum(_VALUES[joined] * up[: len(joined)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    first = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data])))
    return hashes, np.searchsorted(starts, first)


_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, first shingle of every text and the number of all shingles).

    Shingles are five consecutive words; a text with one to four words has one shingle of all of them.
    """
    counts = np.diff(first)
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(shingles)))
    if len(words) == 0:
        return np.zeros(0, U), offsets
    padded = np.concatenate((words, np.zeros(SHINGLE, U)))
    terms = sum(padded[i : i + len(words)] * _PLACE[i] for i in range(SHINGLE))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], shingles) + np.repeat(first[:-1], shingles)
    out = mix(terms[at])
    for d in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        short = words[first[d] : first[d + 1]]
        out[offsets[d]] = mix((short * _PLACE[: len(short)]).sum(dtype=U, keepdims=True) + U(len(short)))[0]
    return out, offsets


def in_batches(texts: Sequence[str], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
