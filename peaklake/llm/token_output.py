"""Operator 7: token ids in binary files, coded by a global canonical Huffman code.

Documents are range-partitioned by id and tokenized once, in order, into blocks of about a million ids that are staged.
Counts of all ids, combined in the tasks, give one code for the whole corpus; its lengths are a table as large as the
vocabulary. Every block is then coded on its own, so coding and decoding are maps over blocks, and a lost task repeats
its blocks only. The files are Parquet tables of coded blocks beside the code lengths.

Words are tokenized once per worker and looked up afterwards (see ``Tokens``): byte-level tokenizers cut a text before every
single space, so the ids of a text are those of its parts.

Defined results: a null text counts as empty and has the end id only; null ids come first; rows of equal id are ordered by
a hash of their texts; empty tables make no files; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from peaklake.llm.common import byte_batches, text_bytes, text_or_empty, workspace
from peaklake.llm.huffman import Code, code_lengths
from peaklake.llm.wordhash import _powers, mix

BLOCK_IDS = 1 << 20
END_ID = 0
MEMO_WORDS = 1 << 19
JOINED_WORDS = 1 << 14
FIRST, SPACED, LINED = 0, 1, 2  # where a part stands
#: White space beyond ASCII as UTF-8: the first byte and what may follow.
WIDE_SPACE = (
    (0xC2, ((0x85, 0xA0),)), (0xE1, ((0x9A,), (0x80,))), (0xE1, ((0xA0,), (0x8E,))),
    (0xE2, ((0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF))), (0xE2, ((0x81,), (0x9F,))), (0xE3, ((0x80,), (0x80,))),
)
U = np.uint64
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = True
_MARK[48:58] = False
_MARK &= ~_LETTER
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


class Tokens:
    """Ids of texts, equal to those of the tokenizer without special tokens added.

    Texts are cut before single spaces, at single line ends and between a letter and a mark (of ASCII), where byte-level
    pre-tokenization cuts too, into parts: one behind a line end, one behind a space, or neither. The parts of about a megabyte of texts are hashed together
    and found in a sorted table of known ones, whose bytes are compared with each; ids are gathered by offsets. Parts not
    seen before are tokenized together, joined by line ends. Texts with adjacent white space or with the string of an added
    token go to the tokenizer whole, as do texts with other white space than spaces and line ends or with a part whose
    hash belongs to another one. A full table is emptied; that changes no result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line, self.space = self._ids(["\n", " "])
        self._empty()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _empty(self) -> None:
        self.hashes, self.order, self.kinds = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.bytes, self.ids = _Ragged(np.uint8), _Ragged(self.dtype)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text and the end id, as little-endian bytes."""
        joined, cuts = text_bytes(texts)
        n = len(cuts) - 1
        # every text is followed by one byte that ends its last part
        data = np.zeros(len(joined) + n, np.uint8)
        ends = cuts[1:] + np.arange(n)
        inside = np.ones(len(data), bool)
        inside[ends] = False
        data[inside] = joined
        whole = self._whole(data, inside, ends)
        gone = (data == 32) | (data == 10) | ~inside  # ends a part and belongs to none
        marked = np.zeros(len(data), bool)
        marked[1:] = _MARK[data[1:]] & _LETTER[data[:-1]] & inside[1:]
        cut = np.flatnonzero(gone | marked)
        start = np.concatenate(([0], cut[:-1] + gone[cut[:-1]]))
        before = np.concatenate(([0], np.where(inside[cut[:-1]] & gone[cut[:-1]], data[cut[:-1]], 0)))
        kinds = np.where(before == 32, SPACED, np.where(before == 10, LINED, FIRST)).astype(np.int8)
        owner = np.concatenate(([0], np.cumsum(~inside[cut])[:-1]))
        plain = ~whole[owner]
        found, same = self._look_up(data, start[plain], cut[plain], kinds[plain])
        whole[owner[plain][~same]] = True
        keep = ~whole[owner[plain]]
        sizes, ids = self.ids.gather(found[keep])
        doc = owner[plain][keep]
        out = np.full(len(ids) + n, END_ID, self.dtype)
        out[np.arange(len(ids)) + np.repeat(doc, sizes)] = ids
        stop = np.cumsum(np.bincount(doc, sizes, n).astype(np.int64) + 1)
        parts = [out[a:b].tobytes() for a, b in zip(np.concatenate(([0], stop[:-1])), stop, strict=True)]
        rest = np.flatnonzero(whole)
        if len(rest):
            end = np.array([END_ID], self.dtype)
            for i, ids in zip(rest.tolist(), self._ids(texts.take(pa.array(rest)).to_pylist()), strict=True):
                parts[i] = np.concatenate((ids, end)).tobytes()
        return parts

    def _whole(self, data: np.ndarray, inside: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts that may not be cut."""
        space = ((data == 32) | (data == 10)) & inside
        odd = _ODD[data] & inside
        odd[1:] |= space[1:] & space[:-1]
        for lead, rest in WIDE_SPACE:
            at = np.flatnonzero(data[: -len(rest)] == lead) if len(data) > len(rest) else np.zeros(0, np.int64)
            for i, values in enumerate(rest):
                at = at[np.isin(data[at + 1 + i], values)]
            odd[at] = True
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                odd[at] = True
                at = raw.find(token, at + 1)
        out = np.zeros(len(ends), bool)
        out[np.searchsorted(ends, np.flatnonzero(odd))] = True
        return out

    def _look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each part in the table, whether it is that part)."""
        hashes = _hashes(data, start, end, kinds)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > MEMO_WORDS:
            self._empty()
        at = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        there = at < len(self.hashes)
        new[there] = self.hashes[at[there]] != unique[there]
        if new.any():
            some = first[new]
            self._learn(unique[new], kinds[some], data, start[some], end[some] - start[some])
            at = np.searchsorted(self.hashes, unique)
        found = self.order[at][inverse]
        same = (self.kinds[found] == kinds) & (self.bytes.sizes[found] == end - start)
        sizes, known = self.bytes.gather(found[same])
        own = data[np.arange(len(known)) + np.repeat(start[same] - (np.cumsum(sizes) - sizes), sizes)]
        wrong = np.repeat(np.flatnonzero(same), sizes)[own != known]
        same[wrong] = False
        return found, same

    def _learn(self, hashes: np.ndarray, kinds: np.ndarray, data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> None:
        """Add parts (sorted hashes) to the table."""
        places = np.empty(len(hashes), np.int64)
        blank, spaced = sizes == 0, kinds == SPACED
        for some in (np.flatnonzero(~blank & ~spaced), np.flatnonzero(~blank & spaced), np.flatnonzero(blank)):
            for a in range(0, len(some), JOINED_WORDS):
                part = some[a : a + JOINED_WORDS]
                places[part] = len(self.kinds) + np.arange(len(part))
                self.kinds = np.concatenate((self.kinds, kinds[part]))
                if blank[part[0]]:
                    self.bytes.append(np.zeros(0, np.uint8), np.zeros(len(part), np.int64), sizes[part])
                    both = np.concatenate((self.line, self.space))
                    lined, own = kinds[part] == LINED, kinds[part] == SPACED
                    self.ids.append(both, np.where(own, len(self.line), 0), np.where(lined, len(self.line), np.where(own, len(self.space), 0)))
                else:
                    self._tokenize(data, start[part], sizes[part], kinds[part])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.order = np.insert(self.hashes, at, hashes), np.insert(self.order, at, places)

    def _tokenize(self, data: np.ndarray, start: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> None:
        """Add ids and bytes of parts that all stand behind a space or all do not; each is put behind a line end."""
        lead = 1 + int(kinds[0] == SPACED)
        begin = np.cumsum(sizes + lead) - sizes
        text = np.full(int(begin[-1] + sizes[-1]), 10, np.uint8)
        if lead == 2:
            text[begin - 1] = 32
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[within + np.repeat(begin, sizes)] = data[within + np.repeat(start, sizes)]
        self.bytes.append(text, begin, sizes)
        if len(self.line) == 1:
            ids = self._ids([text.tobytes().decode()])[0]
            at = np.flatnonzero(ids == self.line[0])
            if len(at) == len(start):
                first = at + (kinds != LINED)
                self.ids.append(ids, first, np.append(at[1:], len(ids)) - first)
                return
        words = [text[a - lead + 1 : a + n].tobytes().decode() for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]
        rows = [np.concatenate((self.line, r)) if k == LINED else r for r, k in zip(self._ids(words), kinds, strict=True)]
        lengths = np.array([len(r) for r in rows], np.int64)
        self.ids.append(np.concatenate(rows), np.cumsum(lengths) - lengths, lengths)


class _Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, dtype):
        self.flat, self.starts, self.sizes = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.flat) + starts))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, flat))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, contents) of these rows."""
        sizes = self.sizes[rows]
        before = np.cumsum(sizes) - sizes
        return sizes, self.flat[np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - before, sizes)]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, from running sums over all bytes."""
    up, down = _powers(max(19, int(len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) + (kinds.astype(U) << U(48)))


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


BLOCKS = "part int, block int, inner bigint, ids {}, sizes array<bigint>, data binary"
_NAMES = ["part", "block", "inner", "ids", "sizes", "data"]


def _blocks(path: str, key: pa.DataType, block_ids: int):
    """Tokenize a sorted partition into blocks of whole documents; ``inner`` counts the ids of the partition before a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, block, inner = _tokens(path), TaskContext.get().partitionId(), 0, 0
        width, ids, data, held = tokens.dtype.itemsize, [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = [len(d) // width for d in data]
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([inner], pa.int64()), pa.array([ids], pa.list_(key)), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, _NAMES)

        for batch in byte_batches(batches):
            for doc, found in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1)), strict=True):
                ids.append(doc)
                data.append(found)
                held += len(found)
                if held >= block_ids * width:
                    yield flush()
                    block, inner, ids, data, held = block + 1, inner + held // width, [], [], 0
        if ids:
            yield flush()

    return run


def _counts(dtype: np.dtype, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return run


def _coded(dtype: np.dtype, lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                image = code.encode(np.frombuffer(row.column(5)[0].as_buffer(), dtype))
                yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([image], pa.binary())], _NAMES)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write ``path``/blocks (coded blocks in ascending id order) and ``path``/code (lengths of the code)."""
    spark = docs.sparkSession
    work = workspace(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    kind = rows.schema["id"].dataType
    tie = F.xxhash64("t")
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    schema = BLOCKS.format(f"array<{kind.simpleString()}>")
    blocks = work.stage(ordered.mapInArrow(_blocks(tokenizer, to_arrow_type(kind), block_ids), schema), "blocks")
    tokens = _tokens(tokenizer)
    size = max(END_ID + 1, tokens.tokenizer.get_vocab_size())
    # as many rows as the vocabulary has ids
    counted = blocks.select("data").mapInArrow(_counts(tokens.dtype, size), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").write.mode("overwrite").parquet(f"{path}/code")
    blocks.mapInArrow(_coded(tokens.dtype, lengths), schema).write.mode("overwrite").parquet(f"{path}/blocks")
    work.close()


def _decoded(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                ids = code.decode(batch.column(5)[i].as_py()).astype("<u4")
                sizes = batch.column(4)[i].values.to_numpy()
                ends = np.cumsum(sizes)
                docs = batch.column(3)[i].values
                data = [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                part = np.repeat(batch.column(0)[i].as_py(), len(docs)).astype(np.int32)
                offset = ends - sizes + batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(part), docs, pa.array(offset), pa.array(sizes), pa.array(data, pa.binary())], ["part", "id", "offset", "n", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian 32-bit)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = bytes(spark.read.parquet(f"{path}/code").first()[0])
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    rows = blocks.mapInArrow(_decoded(lengths), f"part int, id {kind}, offset bigint, n bigint, ids binary")
    own = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)
    parts = blocks.groupBy("part").agg(F.max(F.col("inner") + own).alias("n"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row for each partition that wrote, 16 bytes each: fewer than the tasks that the driver keeps track of
    return rows.join(F.broadcast(parts), "part").select(
        F.col("id").alias(id_col), (F.col("base") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"), "ids"
    )


def digest(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return tokens.select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
