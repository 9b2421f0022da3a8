"""Tables updated in place, statistics, and a cache's state against plain models."""

import os

import pytest
from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.shelf import Shelf
from quillstone.sources import store
from quillstone.streaming.cache import lookups

WHERE = "/root/testdata/sf0.001"


def files(where):
    return {os.path.join(d, f) for d, _, names in os.walk(where.removeprefix("file://")) for f in names if f.endswith(".parquet")}


def rows(spark, where):
    return sorted(tuple(r) for r in spark.read.parquet(where).select("k", "v", "w", "keep").collect())


def test_only_touched_partitions_are_written(spark):
    where = f"{Shelf(spark, 'test').path}/t"
    store.write_parted(spark.createDataFrame([(f"k{i % 40}", i, "old", i % 3 == 0) for i in range(400)] + [(None, -1, "old", True)], "k string, v int, w string, keep boolean"), where, "k", 16)
    before = files(where)
    updates = spark.createDataFrame([("k3", 100, "a"), ("k3", 200, "b"), ("k7", None, "n"), ("nowhere", 1, "x"), (None, 5, "y")], "k string, v int, w string")
    touched = store.bulk_update(spark, where, updates, "k", ["v", "w"], ~F.col("keep"), 16)
    after = files(where)
    assert 0 < len(touched) < 10
    assert {f for f in before if not any(f"part={p}/" in f for p in touched)} == {f for f in after if not any(f"part={p}/" in f for p in touched)}
    want = sorted(((f"k{i % 40}", *({3: (200, "b"), 7: (None, "n")}.get(i % 40, (i, "old")) if i % 3 else (i, "old")), i % 3 == 0) for i in range(400)), key=str)
    got = sorted((x for x in rows_of(spark, where) if x[0] is not None), key=str)
    assert got == want and sum(x[0] is None for x in rows_of(spark, where)) == 1
    store.bulk_update(spark, where, updates, "k", ["v", "w"], ~F.col("keep"), 16)  # a second time: the same table
    assert sorted((x for x in rows_of(spark, where) if x[0] is not None), key=str) == want
    held = files(where)
    assert store.bulk_update(spark, where, updates.limit(0), "k", ["v", "w"], None, 16) == [] and files(where) == held


def rows_of(spark, where):
    return [tuple(r) for r in spark.read.parquet(where).select("k", "v", "w", "keep").collect()]


def test_update_reads_touched_partitions_alone(spark):
    where = f"{Shelf(spark, 'test').path}/t"
    store.write_parted(spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("v")), where, "k", 8)
    pruned = spark.read.parquet(where).filter(F.col(store.PART).isin([1, 2]))
    filters = pruned._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    assert "part#" in filters and "IN (1,2)" in filters


def test_statistics_are_read_back_and_change_a_plan(spark):
    with store.registered(spark, WHERE, ["orders", "lineitem", "customer"]) as name:
        told = {(r["table_name"], r["column_name"]): r for r in store.statistics(spark, name).collect()}
        n = spark.table(f"{name}.orders").count()
        assert told["orders", "o_orderkey"]["n_rows"] == n and abs(told["orders", "o_orderkey"]["n_distinct"] - n) < 0.1 * n
        text = f"SELECT count(*) FROM {name}.lineitem, {name}.orders, {name}.customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = 3"
        plain = f"SELECT count(*) FROM parquet.`{WHERE}/lineitem.parquet`, parquet.`{WHERE}/orders.parquet`, parquet.`{WHERE}/customer.parquet` WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = 3"
        order = lambda q: [t for line in spark.sql(q)._jdf.queryExecution().optimizedPlan().toString().splitlines() for t in ("l_orderkey", "o_orderkey", "c_custkey") if "Relation" in line and t in line]
        for k in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"):
            spark.conf.set(k, "true")
        try:
            assert order(plain)[0] == "l_orderkey" and order(text)[-1] == "l_orderkey" or order(plain) != order(text)
            assert spark.sql(text).collect() == spark.sql(plain).collect()
        finally:
            for k in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"):
                spark.conf.unset(k)
    assert not [d for d in spark.catalog.listDatabases() if d.name == name]


def model(events, lifetime):
    held, out = {}, {}
    for t, i, u in sorted(events):
        out[i] = u in held and t - held[u] < lifetime
        if not out[i]:
            held[u] = t
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cache_is_the_model_and_outlives_a_restart(spark, seed):
    import random
    from datetime import datetime, timedelta

    r, start = random.Random(seed), datetime(2020, 1, 1)
    times = sorted(r.randrange(4 * 86_400) for _ in range(400))
    rows = [(i, r.choice([1, 1, 1, 2, 3, 4]), start + timedelta(seconds=t)) for i, t in enumerate(times)]
    shelf = Shelf(spark, "test")
    schema = "event_id long, user_id long, ts timestamp"
    paths = [f"{shelf.path}/{x}" for x in ("landing", "out", "checkpoint")]
    for part in (rows[:150], rows[150:160], [], rows[160:]):
        frame = spark.createDataFrame(r.sample(part, len(part)), schema).repartition(3)
        frame.write.mode("append").parquet(paths[0])
        lookups(spark, paths[0], frame.schema, *paths[1:])
    got = {x["event_id"]: x["hit"] for x in spark.read.parquet(f"{paths[1]}/batch=*").collect()}
    assert got == model([(t, i, u) for i, u, t in rows], timedelta(hours=6)) and 0 < sum(got.values()) < 400


def test_catalogue_query_has_all_columns(spark):
    assert catalog.queries()["table_catalogue"](spark, WHERE).count() == sum(len(c.split()) for c in __import__("quillstone.plans.stored", fromlist=["COLUMNS"]).COLUMNS.values())


def test_keys_of_a_bucket_share_a_state(spark, monkeypatch):
    """With one bucket all keys are asked for at once, and each is answered by itself; what no hit can come from goes."""
    from datetime import datetime, timedelta

    from quillstone.streaming import cache

    assert cache.BUCKETS == 1024
    monkeypatch.setattr(cache, "BUCKETS", 1)
    start = datetime(2020, 1, 1)
    rows = [(i, f"k{i % 7}" if i % 11 else "", start + timedelta(minutes=37 * i)) for i in range(120)]
    shelf = Shelf(spark, "test")
    paths = [f"{shelf.path}/{x}" for x in ("landing", "out", "checkpoint")]
    for part in (rows[:50], rows[50:]):
        frame = spark.createDataFrame(part, "event_id long, user_id string, ts timestamp")
        frame.write.mode("append").parquet(paths[0])
        lookups(spark, paths[0], frame.schema, *paths[1:])
    got = {x["event_id"]: x["hit"] for x in spark.read.parquet(f"{paths[1]}/batch=*").collect()}
    assert got == model([(t, i, u) for i, u, t in rows], timedelta(hours=6)) and 0 < sum(got.values()) < 120
