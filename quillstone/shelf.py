"""Intermediate tables in the folder that every executor shares.

A table written here cuts the lineage: later readers see the same rows however
often a task is run again, and nothing is lost with an executor.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only where that is unset and all tasks run in the driver's own process (tests), a
    local one; a cluster without a shared folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Shelf:
    """A run's own subfolder of the shared folder, holding Parquet tables by name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/quillstone-{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self.clear)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df under name and return it as read back."""
        where = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(where)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.path}/{name}")
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*(self.names - set(names)))

    def clear(self) -> None:
        """Delete the whole subfolder; at exit the session may already be gone."""
        try:
            self._delete(self.path)
        except (Py4JError, OSError, AttributeError, AssertionError):
            return

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
