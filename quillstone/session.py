"""Session factory for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A UTC session on this machine, with adaptive execution on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its rows lie in fewer: for expressions that cost far more than moving their rows.

    A file is split by its bytes, but a split has rows only if one of the file's row groups is
    in it; which splits have any, a count without columns tells.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < cores or df.select(F.spark_partition_id().alias("p")).distinct().count() < cores
    return df.repartition(cores) if few else df
