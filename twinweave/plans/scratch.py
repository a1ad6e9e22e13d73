"""Intermediate tables in the folder that the cluster shares.

Iterative and multi-pass operators cut their lineage by writing a Parquet table
and reading it again: it survives the loss of executors, carries statistics for
the next join and lets Spark drop the shuffle files of the step that wrote it.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_DEFAULT = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _LOCAL_DEFAULT
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/twinweave/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, by Hadoop's file system, as PySpark has no call for it; a failure is a warning."""
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception as e:
        warnings.warn(f"{path} stays: {e}", stacklevel=2)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has stashed; results that aren't written yet can't be read after it."""
    delete(spark, _own_folder(spark))


class Scratch:
    """A private subfolder of the shared folder; ``stash`` writes a table and reads it back.

    Tables lie below a folder of the application. An operator drops those that
    its result doesn't read; ``clear`` removes the others after use.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def stash(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete stashed tables that no later step reads."""
        for df in tables:
            path = getattr(df, "_stash_path", None)
            if path:
                delete(self.spark, path)

    def drop_all(self) -> None:
        """Delete all that was stashed here."""
        delete(self.spark, self.root)
