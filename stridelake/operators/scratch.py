"""Intermediate tables in the folder that a cluster shares.

``spark.checkpoint.dir`` names it.  Writing an intermediate there cuts the
lineage: a lost executor costs a re-read, not a recomputation, and the reread
table has a known size, so that the planner's broadcast threshold is honest.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where it is unset and the master is local (tests).

    RuntimeError on a cluster without the setting: its machines would not see each other's files.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = getattr(spark, "_stridelake_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="stridelake-")
        spark._stridelake_shared = own
    return own


class Scratch:
    """Tables written once, read many times, and dropped by name; what is left goes when the driver ends.

    Results are plans over these tables, so that they can't go before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        path, store = self._at(self.root)
        store.mkdirs(path)
        store.deleteOnExit(path)

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.remove(df._scratch_path)

    def remove(self, at: str | None = None) -> None:
        path, store = self._at(at or self.root)
        store.delete(path, True)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; exact enough for tables read from files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
