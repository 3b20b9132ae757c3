"""Tables that cut lineage: Parquet in the folder that the cluster names in spark.checkpoint.dir.

All executors see that folder, so a lost executor costs a re-read and never a re-run of what came before.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset in local mode (tests), a temporary folder, set once.

    A cluster without that setting is an error: its executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("wakeline.scratch", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("wakeline.scratch", found)
    return found.rstrip("/")


#: Folders of this driver, with what is needed to delete them.
_open: list = []


def _close() -> None:
    """When the driver ends, its results have been read: the tables they were read from go."""
    for jvm, conf, folder in _open:
        try:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM may have ended first
            return


class Scratch:
    """A folder for one call of an operator, deleted when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if not _open:
            atexit.register(_close)
        _open.append((spark._jvm, spark._jsc.hadoopConfiguration(), self.folder))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it again, after the files of steps before it have gone."""
        self.free()
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Let the executors delete shuffle files that no DataFrame refers to any more.

        Spark deletes them when the driver's JVM collects what refers to them, which a driver with little to do may not do for
        half an hour; by then the files of all steps would have piled up on the executors' disks.  A listener of Spark's refers to the
        last query it was told of until it is told of the next, so a query without files of its own goes first.
        """
        self.spark.range(0, 1, numPartitions=1).collect()
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
