"""Writers: upserts into Parquet snapshots, exports and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_snapshot(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A new snapshot in a folder of its own: the store that is being read is never overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns have to be flattened before."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
