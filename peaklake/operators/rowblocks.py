"""Rows of a key packed as bytes: what the solver reads in every pass.

A block holds some rows of one key: labels, multiplicities and the matrix, either whole or, where few values differ from
zero, these values alone with their columns. Arrays are views of the bytes, so a pass converts nothing row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARSE_SHARE = 0.25  # blocks with at most this share of values other than zero hold only these
SPARSE_COST = 1.5  # numbers that such a value takes, with its column
BLOCK_VALUES = 1 << 18  # numbers of a block: 2 MB
HELD_VALUES = 1 << 22  # numbers that a task collects for unfinished blocks of all keys
PARTS = ("y", "multiplicity", "ends", "cols", "vals")


class Sparse:
    """Rows by their values other than zero, with a last column of ones: products as a dense matrix would give them."""

    def __init__(self, ends: np.ndarray, cols: np.ndarray, vals: np.ndarray, p: int):
        self.ends, self.cols, self.vals, self.p = ends, cols, vals, p  # ends begins with 0
        self.shape = (len(ends) - 1, p + 1)

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, rows: slice | np.ndarray) -> "Sparse":
        if not isinstance(rows, slice):
            lengths = np.diff(self.ends)[rows]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(self.ends[rows] - ends[:-1], lengths) + np.arange(ends[-1])
            return Sparse(ends, self.cols[at], self.vals[at], self.p)
        start, stop, _ = rows.indices(len(self))
        a, b = self.ends[start], self.ends[stop]
        return Sparse(self.ends[start:stop + 1] - a, self.cols[a:b], self.vals[a:b], self.p)

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows x vectors: the product with each vector."""
        out = np.zeros((len(self), len(w)))
        some = np.flatnonzero(np.diff(self.ends))
        for j, vector in enumerate(w):
            if some.size:
                out[some, j] = np.add.reduceat(vector[self.cols] * self.vals, self.ends[some])
            out[:, j] += vector[self.p]
        return out

    def gathered(self, c: np.ndarray) -> np.ndarray:
        """Vectors x columns: the rows summed up with the weights of each column of ``c``."""
        out = np.empty((c.shape[1], self.p + 1))
        lengths = np.diff(self.ends)
        for j in range(c.shape[1]):
            out[j, : self.p] = np.bincount(self.cols, weights=self.vals * np.repeat(c[:, j], lengths), minlength=self.p)
            out[j, self.p] = c[:, j].sum()
        return out

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """These columns as a dense matrix."""
        place = np.full(self.p + 1, -1)
        place[columns] = np.arange(len(columns))
        at = place[self.cols]
        row = np.repeat(np.arange(len(self)), np.diff(self.ends))
        out = np.zeros((len(self), len(columns)))
        out[row[at >= 0], at[at >= 0]] = self.vals[at >= 0]
        if place[self.p] >= 0:
            out[:, place[self.p]] = 1.0
        return out

    def add_squares(self, total: np.ndarray, weights: np.ndarray, most: int) -> None:
        """Add weight * row' row of all rows to ``total``, about ``most`` pairs of values at once."""
        lengths = np.diff(self.ends)
        upto = np.cumsum(lengths * lengths)
        start = 0
        while start < len(self):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
            a, own = self.ends[start], lengths[start:stop]
            partners = np.repeat(own, own)  # of every value: how many values its row has
            left = np.repeat(np.arange(a, self.ends[stop]), partners)
            first = np.repeat(self.ends[start:stop], own) - (np.cumsum(partners) - partners)
            right = np.repeat(first, partners) + np.arange(len(left))
            turned = self.vals[a:self.ends[stop]] * np.repeat(weights[start:stop], own)
            place = self.cols[left].astype(np.int64) * self.p + self.cols[right]
            pairs = np.bincount(place, weights=turned[left - a] * self.vals[right], minlength=self.p**2)
            total[: self.p, : self.p] += pairs.reshape(self.p, self.p)
            start = stop
        edge = self.gathered(weights[:, None])[0]
        total[self.p] += edge
        total[: self.p, self.p] += edge[: self.p]

    def norms(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self)), np.diff(self.ends)), weights=self.vals * self.vals, minlength=len(self))

    def keep(self, used: np.ndarray) -> "Sparse":
        """Only the columns ``used``, in their order."""
        place = np.full(self.p, -1)
        place[used] = np.arange(len(used))
        at = place[self.cols]
        ends = np.concatenate([[0], np.cumsum(at >= 0)])[self.ends]
        return Sparse(ends, at[at >= 0], self.vals[at >= 0], len(used))


def values_held(n: Column, p: Column, nonzero: Column) -> Column:
    """Numbers that the rows of a key take."""
    return F.when(nonzero <= SPARSE_SHARE * n * p, SPARSE_COST * nonzero).otherwise(n * p)


def packed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., n, p and the bytes of blocks of (keys..., y, multiplicity, x); rows of a null key are left out."""
    keys = list(keys)
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("n", T.IntegerType()), T.StructField("p", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in PARTS]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = {}  # of a key: parts and how many numbers they take
        held = 0
        kind: list[pa.DataType] = []

        def flush(key: tuple) -> pa.RecordBatch:
            parts, _ = waiting.pop(key)
            y, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            p = parts[0][2]
            if any(part[2] != p for part in parts):
                raise ValueError(f"rows of different lengths under one key: {key}")
            cols, vals = np.concatenate([q[4] for q in parts]), np.concatenate([q[5] for q in parts])
            lengths = np.concatenate([q[3] for q in parts])
            if len(vals) > SPARSE_SHARE * len(y) * p:
                whole = np.zeros((len(y), p))
                whole[np.repeat(np.arange(len(y)), lengths), cols] = vals
                ends, cols, vals = None, None, whole
            else:
                ends, cols = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tobytes(), cols.astype(np.int32).tobytes()
            row = [*key, len(y), p, y.tobytes(), m.tobytes(), ends, cols, vals.tobytes()]
            kinds = [*kind, pa.int32(), pa.int32(), *[pa.binary()] * len(PARTS)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind[:] = [batch.schema.field(k).type for k in keys]
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            times = batch.column("multiplicity")
            if pa.types.is_list(times.type):
                flat = times.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                times = flat.reshape(batch.num_rows, -1)
            else:
                times = times.to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
            x = batch.column("x")
            starts, values = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            frame = batch.select(keys).to_pandas()
            for key, places in frame.groupby(keys).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                p = int(starts[places[0] + 1] - starts[places[0]])
                if np.any(starts[places + 1] - starts[places] != p):
                    raise ValueError(f"rows of different lengths under one key: {key}")
                for a in range(0, len(places), some := max(1, BLOCK_VALUES // max(p, 1))):
                    own = places[a:a + some]
                    whole = values[starts[own][:, None] + np.arange(p)]
                    row, col = np.nonzero(whole)
                    lengths = np.bincount(row, minlength=len(own))
                    size = min(own.size * p, int(SPARSE_COST * len(row)))
                    size += len(own) * (1 + times.shape[1])
                    known = waiting.setdefault(key, [[], 0])
                    known[0].append((y[own], times[own], p, lengths, col, whole[row, col]))
                    known[1] += size
                    held += size
                    if known[1] >= BLOCK_VALUES:
                        held -= known[1]
                        yield flush(key)
            if held >= HELD_VALUES:
                for key in list(waiting):
                    yield flush(key)
                held = 0
        for key in list(waiting):
            yield flush(key)

    return rows.select(*keys, "y", "multiplicity", "x").mapInArrow(run, schema)


def unpacked(y, multiplicity, ends, cols, vals, n: int, p: int):
    """(labels, multiplicities by draw, matrix with a last column of ones) of one block; arguments are bytes or buffers."""
    y = np.frombuffer(y, np.float64)
    multiplicity = np.frombuffer(multiplicity, np.float64).reshape(n, -1)
    vals = np.frombuffer(vals, np.float64)
    if ends is not None:
        return y, multiplicity, Sparse(np.frombuffer(ends, np.int64), np.frombuffer(cols, np.int32), vals, p)
    return y, multiplicity, np.column_stack([vals.reshape(n, p), np.ones(n)])


def together(blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray | Sparse]:
    """The blocks of one key, a table with a row each, as one."""
    p, n = int(blocks["p"].max()), int(blocks["n"].sum())
    if (blocks["p"] != p).any():
        raise ValueError("rows of different lengths under one key")
    y = np.concatenate([np.frombuffer(b, np.float64) for b in blocks["y"]])
    multiplicity = np.concatenate([np.frombuffer(b, np.float64).reshape(k, -1) for b, k in zip(blocks["multiplicity"], blocks["n"])])
    few = [e is not None for e in blocks["ends"]]
    if all(few):
        ends, base = [np.zeros(1, np.int64)], 0
        for e in blocks["ends"]:
            own = np.frombuffer(e, np.int64)[1:] + base
            base = own[-1]
            ends.append(own)
        cols = np.concatenate([np.frombuffer(b, np.int32) for b in blocks["cols"]])
        return y, multiplicity, Sparse(np.concatenate(ends), cols, np.concatenate([np.frombuffer(b, np.float64) for b in blocks["vals"]]), p)
    whole, at = np.ones((n, p + 1)), 0
    for k, e, c, v in zip(blocks["n"], blocks["ends"], blocks["cols"], blocks["vals"]):
        v = np.frombuffer(v, np.float64)
        part = v.reshape(k, p) if e is None else Sparse(np.frombuffer(e, np.int64), np.frombuffer(c, np.int32), v, p).dense(np.arange(p))
        whole[at:at + k, :p] = part
        at += k
    return y, multiplicity, whole
