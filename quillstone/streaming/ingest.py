"""Incremental ingest and windows as Structured Streaming; the batch forms share the expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.relational import keep_last, upsert
from quillstone.sources.sinks import write_snapshot


def landing(spark: SparkSession, path: str, schema, files_per_trigger: int = 100, fmt: str = "parquet") -> DataFrame:
    """Files that arrive in a folder; what was read is kept in the checkpoint, which takes the place of acknowledging."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def unseen_urls(stream: DataFrame, url: str, event_time: str, lateness: str = "30 days") -> DataFrame:
    """The first row of each URL; state older than the lateness is dropped."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([url])


def tumbling(df: DataFrame, time: str, width: str, *by: str) -> DataFrame:
    return df.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(df: DataFrame, time: str, width: str, slide: str, *by: str) -> DataFrame:
    return df.groupBy(F.window(time, width, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def replace_groups(folder: str, keys: list[str]):
    """A micro-batch writer: each batch's updated groups go to a folder of its own number, which a retry overwrites."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={epoch}")

    return write


def latest_groups(spark: SparkSession, folder: str, keys: list[str], schema) -> DataFrame:
    """The groups as their last batch left them."""
    rows = spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch=*")
    return keep_last(rows, keys, "batch").drop("batch")


def merge_batches(stream: DataFrame, folder: str, key: str, order: str, keep_if_null: list[str], checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into a series of snapshots folder/0, folder/1, ...

    A batch that is retried finds its snapshot and does nothing, so that each counts once.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = fs.Path(f"{folder}/{epoch}/_SUCCESS")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return
        now = F.current_timestamp().cast("timestamp_ntz")
        latest = keep_last(batch, [key], order)
        if epoch == 0:
            out = latest.withColumns({"first_seen": now, "last_seen": now})
        else:
            out = upsert(spark.read.parquet(f"{folder}/{epoch - 1}"), latest, key, keep_if_null, now)
        write_snapshot(out, f"{folder}/{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
