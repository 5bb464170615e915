"""Written tables in the cluster's shared folder, used to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Only a plain ``local``
session (tests) may run without that setting; a folder of its own is then made.
Tables are Parquet, so a lost executor costs a reread and no recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors both see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = "file://" + tempfile.mkdtemp(prefix="offerlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows of an Arrow batch while a table is written: with texts of some kilobytes, a few megabytes on either side of the pipe.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Names and writes the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.live: dict[str, DataFrame] = {}

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        self.count += 1
        path = f"{self.root}/t{self.count}"
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        self.live[path] = out
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self.live.pop(path, None)
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write an operator's result and delete all other tables of the call: what stays is one table of results."""
        out = self.save(df)
        for path, other in list(self.live.items()):
            if path != out._scratch_path:  # type: ignore[attr-defined]
                self.drop(other)
        return out
