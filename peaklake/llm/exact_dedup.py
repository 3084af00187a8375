"""Operator 2: exact deduplication with disk-backed keyed streaming state.

Documents are read as a file stream. Keyed state without expiry (RocksDB on the executors, snapshots in the shared
checkpoint folder) holds for each digest how many rows had it and, of the row with the largest id, the stable
identifier and the content locator (file and row index). Aggregation is partial before the shuffle, so a group with a
third of all rows arrives as one row per task. Passing the same ``state_dir`` again goes on with new files only.

A digest is only a hint: every row of a digest seen more than once is compared byte by byte with the text at the
locator. Digests under which texts differ are grouped again by whole text.

Defined results: a null text counts as empty; null ids sort below all others; rows that repeat id and text are
copies of each other, of which the one at the largest locator stays; an empty table gives no rows; extra columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql import types as T

from peaklake.llm.common import broadcast_if_small, text_or_empty, workspace

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(frame: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = text_or_empty(text_col)
    locator = F.struct(
        F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return frame.select(digest(text).alias("digest"), locator.alias("at"), text.alias("t"))


def _columns(spark: SparkSession, path: str, id_col: str, text_col: str) -> StructType:
    """Both columns alone, so that no other column of the files can hide the file's own place and row."""
    return StructType([f for f in spark.read.parquet(path).schema if f.name in (id_col, text_col)])


def keyed_state(
    spark: SparkSession, path: str, state_dir: str, id_col: str, text_col: str,
    digest: Callable[[Column], Column] = sha256, batch_bytes: int = 64 << 30,
) -> DataFrame:
    """Run the stream to the end of the files; the state as (digest, keep struct<id, file, row>, n)."""
    path = path.rstrip("/")
    schema = _columns(spark, path, id_col, text_col)
    # a file source takes folders or patterns; as a pattern the path may also be a single file
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(pattern)
    state = (
        _rows(stream, id_col, text_col, digest).groupBy("digest")
        .agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    )
    updates = f"{state_dir}/updates"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{updates}/{number:09d}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        run = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint")
            .trigger(availableNow=True).foreachBatch(write).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(updates)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # an empty table starts no batch
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema])
    seen = spark.read.schema(schema).parquet(f"{updates}/*")
    latest = seen.groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("last"))
    return latest.select("digest", "last.keep", "last.n")


def deduplicate(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    work = workspace(spark, "exact-dedup")
    state = work.stage(keyed_state(spark, path, state_dir or work.path, id_col, text_col, digest), "state")
    rows = _rows(spark.read.schema(_columns(spark, path, id_col, text_col)).parquet(path), id_col, text_col, digest)
    hits = broadcast_if_small(state.where("n > 1"))
    same_row = F.col("at").eqNullSafe(F.col("keep"))

    hit_rows = rows.join(hits, "digest")
    others = hit_rows.where(~same_row)
    keepers = hit_rows.where(same_row).select("digest", F.col("t").alias("keep_t"))
    checked = work.stage(
        others.join(keepers, "digest").select("digest", "at", "keep", "n", (F.col("t") == F.col("keep_t")).alias("same")),
        "checked",
    )
    singles = rows.join(hits.select("digest"), "digest", "left_anti").select(
        "at", F.col("at").alias("keep"), F.lit(1).cast("bigint").alias("n"), _hex("t")
    )
    if digest is sha256 and checked.where("NOT same").isEmpty():
        known = state.where("n > 1").select("digest", F.col("keep").alias("at"), "keep", "n")
        copies = checked.drop("same").unionByName(known).select("at", "keep", "n", F.lower(F.hex("digest")).alias("text_sha256"))
    else:
        copies = _by_text(hit_rows)
    return singles.unionByName(copies).select(
        F.col("at.id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("at").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256",
    )


def _hex(text: str) -> Column:
    return F.sha2(F.col(text), 256).alias("text_sha256")


def _by_text(hit_rows: DataFrame) -> DataFrame:
    """All rows of digests seen more than once, grouped by digest and whole text."""
    again = hit_rows.select("digest", "at", "t")
    groups = again.groupBy("digest", "t").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    return again.join(groups, ["digest", "t"]).select("at", "keep", "n", _hex("t"))


def oracle_sql() -> str:
    return """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
