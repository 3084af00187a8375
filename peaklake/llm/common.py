"""Reading and staging shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peaklake.workspace import Workspace

ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def workspace(spark: SparkSession, name: str) -> Workspace:
    return Workspace(spark, name)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the memory of a task follows a few hundred texts, not ten thousand."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


BROADCAST_ROWS = 500_000


def broadcast_if_small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged, narrow side for broadcast if it has at most ``rows`` rows; beyond that the join is shuffled."""
    return F.broadcast(side) if side.count() <= rows else side


ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Jobs started inside send at most ``rows`` rows at once to Python: for rows of whole texts or sets."""
    before = spark.conf.get(ROWS_KEY)
    spark.conf.set(ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS_KEY, before)


BATCH_BYTES = 1 << 20


def byte_batches(batches: Iterable[pa.RecordBatch], column: str = "t", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of the string ``column``; a longer text is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.add(pc.binary_length(batch.column(column)), 8).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            held = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, held + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def text_slices(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` bytes as Python strings, so that a task never holds a whole Arrow batch of them."""
    named = pa.RecordBatch.from_arrays([texts], ["t"])
    for part in byte_batches([named], limit=limit):
        yield part.column("t").to_pylist()
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes of a string column without nulls, where each text begins and the last one ends)."""
    column = column.cast(pa.large_string())
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    joined = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return joined, cuts - cuts[0]


def labelled_sample(work: Workspace, docs: DataFrame, known: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """At most ``rows`` distinct (id, text) of the documents named by ``known`` (id, ...), with its columns; staged.

    The bound holds for joined rows: they are chosen by the hash of id and text, as narrow rows, before any text moves, so
    an id that a third of the documents share gives as many rows as it has texts among the chosen.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("t")).where("id is not null").withColumn("h", F.xxhash64("t"))
    named = texts.select("id", "h").distinct().join(known.select("id"), "id")
    keys = work.stage(named.orderBy(F.md5(F.concat_ws(":", "id", "h")), "id", "h").limit(rows), "keys")
    chosen = texts.join(F.broadcast(keys), ["id", "h"]).groupBy("id", "h").agg(F.min("t").alias("t"))
    return work.stage(chosen.join(F.broadcast(keys.join(known, "id")), ["id", "h"]), "sample")
