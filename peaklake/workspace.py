"""Staging of intermediate tables.

Studies reuse intermediate tables many times (one preprocessed matrix serves every C, feature set and
iteration). They are written once as Parquet in the folder named by ``spark.checkpoint.dir`` and read back:
that cuts the lineage, survives the loss of executors, computes the plan once (``checkpoint()`` computes it
twice unless cached) and gives the optimizer real file sizes, so broadcast decisions rest on measured bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``, or a folder beside the session's warehouse tables.

    Both are shared between driver and executors; a machine-local temporary folder is never made up.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


class Workspace:
    """A private sub-folder of the checkpoint folder for one study."""

    def __init__(self, spark: SparkSession, name: str = "study"):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the table read back."""
        self._n += 1
        path = f"{self.path}/{self._n:04d}-{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Remove the staged tables. Results that still read them become unreadable."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(path, True)
