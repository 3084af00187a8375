"""Canonical length-limited Huffman codes over integer ids, in NumPy.

A block is coded on its own: a bit stream, most significant bit first, and the bit offset of every ``EVERY``-th id. The
decoder starts at all checkpoints of a block at once and moves them forward together, one table look-up per id.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 256
MAGIC = b"PLHF1\0"
HEAD = struct.Struct("<6sHQQ")  # magic, checkpoint distance, ids, bits
U = np.uint64


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``limit`` bits (more if the ids need it); 0 for unused ids.

    Package-merge: at every level the cheapest 2p items are taken, where p packages were taken one level up; as items
    are sorted, the ids taken at a level are the rarest ones, so it is enough to know how many.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length() + 1)
    rarest = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[rarest].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        items = np.concatenate((leaves, packages))
        order = np.argsort(items, kind="stable")
        levels.append(order < len(leaves))
        items = items[order]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[rarest[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


class Code:
    """The canonical code of given lengths: shorter codes first, equal lengths by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.longest = int(lengths.max(initial=1))
        width = 1 << (self.longest - self.lengths[order])
        begins = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = begins >> (self.longest - self.lengths[order])
        self.symbol = np.zeros(1 << self.longest, np.uint32)
        table = np.repeat(order, width)
        self.symbol[: len(table)] = table

    def encode(self, ids: np.ndarray) -> bytes:
        """One block as bytes."""
        n = self.lengths[ids]
        if len(ids) and not n.all():
            raise ValueError("an id has no code")
        end = np.cumsum(n)
        at = end - n
        bits = int(end[-1]) if len(ids) else 0
        words = np.zeros(bits // 64 + 2, U)
        code, word, room = self.codes[ids].astype(U), at >> 6, 64 - (at & 63) - n
        head = np.where(room >= 0, code << np.maximum(room, 0).astype(U), code >> np.maximum(-room, 0).astype(U))
        if len(ids):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            words[word[begins]] = np.bitwise_or.reduceat(head, begins)
            over = room < 0
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(U)
        marks = at[::EVERY].astype("<u8")
        return HEAD.pack(MAGIC, EVERY, len(ids), bits) + marks.tobytes() + words.astype(">u8").tobytes()

    def decode(self, block: bytes) -> np.ndarray:
        """The ids of one block."""
        magic, every, count, _ = HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        lanes = -(-count // every)
        at = np.frombuffer(block, "<u8", lanes, HEAD.size).astype(np.int64)
        words = np.frombuffer(block, ">u8", -1, HEAD.size + 8 * lanes).astype(U)
        words = np.append(words, U(0))
        out = np.zeros((every, lanes), np.uint32)
        last = len(words) - 2
        for step in range(min(every, count)):
            word, off = np.minimum(at >> 6, last), (at & 63).astype(U)
            window = (words[word] << off) | ((words[word + 1] >> U(1)) >> (U(63) - off))
            out[step] = self.symbol[window >> U(64 - self.longest)]
            at += self.lengths[out[step]]
        return out.T.ravel()[:count]
