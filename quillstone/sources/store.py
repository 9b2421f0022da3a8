"""Tables that are updated in place, and what is known of registered ones."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.shelf import Shelf

#: Name of the column that places a row in a partition.
PART = "part"


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_parted(df: DataFrame, where: str, key: str, parts: int = 64) -> None:
    """Writes df as a table of so many partitions by a hash of key."""
    df.withColumn(PART, part_of(key, parts)).repartition(PART).write.partitionBy(PART).parquet(where)


def bulk_update(spark: SparkSession, where: str, updates: DataFrame, key: str, columns: list[str], only: Column | None = None, parts: int = 64) -> list[int]:
    """Sets columns to those of updates wherever the key is equal; returns the partitions that were written anew.

    Only partitions with a key of updates are read and written: a row's other values, and rows
    that only is not true for, stay as they are. Of rows that repeat a key in updates the
    greatest counts, a null key updates nothing, and null values are set like any other. What
    is to be written goes to the shared folder first, so that a write that fails halfway is
    run again with the same result. Without updates nothing is touched.
    """
    shelf = Shelf(spark, "update")
    new = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias("set_to"))
    new = shelf.put(new.withColumn(PART, part_of(key, parts)), "updates")
    touched = sorted(r[0] for r in new.select(PART).distinct().collect())  # as many rows as there are partitions at most
    if not touched:
        return []
    table = spark.read.parquet(where)
    kept = table.filter(F.col(PART).isin(touched))  # a list of numbers: other partitions aren't opened
    joined = kept.join(new.drop(PART), key, "left")
    held = F.col("set_to").isNotNull() & (F.coalesce(only, F.lit(False)) if only is not None else F.lit(True))
    merged = joined.select(*(F.when(held, F.col(f"set_to.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))
    merged = shelf.put(merged, "merged")
    merged.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(where)
    shelf.clear()
    return touched


@contextmanager
def registered(spark: SparkSession, sf_dir: str, tables: list[str]) -> Iterator[str]:
    """A database of external tables over the files of a folder, with statistics of all columns; dropped at the end, the files not."""
    name = f"quillstone_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        for t in tables:
            spark.sql(f"CREATE TABLE {name}.{t} USING parquet OPTIONS (path '{sf_dir}/{t}.parquet')")
            columns = ", ".join(f"`{c}`" for c, kind in spark.table(f"{name}.{t}").dtypes if not kind.startswith(("array", "map", "struct", "variant")))
            spark.sql(f"ANALYZE TABLE {name}.{t} COMPUTE STATISTICS FOR COLUMNS {columns}")
        yield name
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def statistics(spark: SparkSession, database: str) -> DataFrame:
    """One row for each column of each table of a database: rows of the table, its columns, type, nulls, distinct values (an estimate).

    Read from the catalogue alone. Columns without statistics, nested ones, have null counts.
    """
    rows = []
    for t in spark.catalog.listTables(database):
        table = f"{database}.{t.name}"
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
        n_rows = int(told["Statistics"].split("bytes, ")[1].split(" rows")[0])
        columns = spark.catalog.listColumns(table)
        for c in columns:
            own = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {table} `{c.name}`").collect()}
            number = lambda k: int(own[k]) if own.get(k, "NULL") != "NULL" else None  # noqa: B023, E731
            rows.append((t.name, c.name, c.dataType, n_rows, len(columns), number("num_nulls"), number("distinct_count")))
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string, n_rows long, n_columns int, n_nulls long, n_distinct long")
