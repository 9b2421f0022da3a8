"""A file whose rows lie in one row group is spread, although it is split into as many parts as there are cores."""

import duckdb

from quillstone.session import spread


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    where = f"{tmp_path}/t.parquet"
    duckdb.sql(f"COPY (SELECT range AS i, sha256(CAST(range AS VARCHAR)) AS s FROM range(20000)) TO '{where}' (FORMAT parquet, ROW_GROUP_SIZE 100000)")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        df = spark.read.parquet(where)
        cores = spark.sparkContext.defaultParallelism
        held = lambda x: sum(n > 0 for n in x.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        assert df.rdd.getNumPartitions() >= cores and held(df) == 1 and (cores == 1 or held(spread(df)) == cores) and spread(df).count() == 20_000
    finally:
        spark.conf.set(name, before)
