"""Tables updated in place, the catalogue, caches with a lifetime."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.registry import QUERIES, ORACLES, query
from quillstone.shelf import Shelf
from quillstone.sources import store
from quillstone.streaming.cache import lookups

UPDATE_SQL = """
WITH u AS (SELECT p_brand, max(p_retailprice) / 100 AS rating, max(p_type) AS source FROM part WHERE CAST(substring(p_brand, 7) AS INT) % 7 = 1 GROUP BY 1)
SELECT p_partkey, p.p_brand, CASE WHEN u.p_brand IS NOT NULL AND p_size > 10 THEN u.rating END AS rating, CASE WHEN u.p_brand IS NOT NULL AND p_size > 10 THEN u.source ELSE 'none' END AS source
FROM part p LEFT JOIN u ON u.p_brand = p.p_brand
"""


@query("bulk_update", UPDATE_SQL)
def bulk_update(spark, read):
    """Ratings of some brands written to all their larger parts, in the partitions of those brands alone."""
    parts = read("part")
    where = f"{Shelf(spark, 'rated').path}/table"
    store.write_parted(parts.select("p_partkey", "p_brand", "p_size", F.lit(None).cast("double").alias("rating"), F.lit("none").alias("source")), where, "p_brand", 16)
    chosen = parts.filter(F.substring("p_brand", 7, 9).cast("int") % 7 == 1)
    updates = chosen.groupBy("p_brand").agg((F.max("p_retailprice") / 100).alias("rating"), F.max("p_type").alias("source"))
    store.bulk_update(spark, where, updates, "p_brand", ["rating", "source"], F.col("p_size") > 10, 16)
    return spark.read.parquet(where).select("p_partkey", "p_brand", "rating", "source")


CATALOGUED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")


#: The tables' columns, typed for the SQL.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "benchmark": "item_id text",
}


def _counted(table: str, columns: list[str]) -> str:
    return f"SELECT '{table}' AS table_name, unnest({columns}) AS column_name, count(*) AS n_rows, CAST({len(columns)} AS INT) AS n_columns, unnest([{', '.join(f'count(*) - count({c})' for c in columns)}]) AS n_nulls FROM {table}"


def table_catalogue(spark, sf_dir):
    """Rows, columns and nulls of the tables, from the statistics that ANALYZE leaves in the catalogue."""
    with store.registered(spark, sf_dir, list(CATALOGUED)) as name:
        found = store.statistics(spark, name)
    return found.select("table_name", "column_name", "n_rows", "n_columns", "n_nulls")


QUERIES["table_catalogue"] = table_catalogue
ORACLES["table_catalogue"] = " UNION ALL ".join(_counted(t, COLUMNS[t].split()) for t in CATALOGUED)

CACHE_SQL = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, k, us AS fetched, false AS hit FROM e WHERE k = 1
      UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.us - r.fetched < 21600000000 THEN r.fetched ELSE e.us END, e.us - r.fetched < 21600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, hit FROM r
"""


@query("cached_lookups", CACHE_SQL)
def cached_lookups(spark, read):
    """Events as look-ups of their users against a cache with a lifetime of six hours: a stream with keyed state, stopped and started again twice."""
    events = read("events").select("event_id", "user_id", "ts")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    shelf = Shelf(spark, "lookups")
    landing, out, checkpoint = (f"{shelf.path}/{x}" for x in ("landing", "out", "checkpoint"))
    if first is None:
        return events.select("event_id", F.lit(False).alias("hit"))
    step = (last - first) / 3
    for i in range(3):
        inside = (F.col("ts") >= F.lit(first + i * step)) & (F.col("ts") < F.lit(first + (i + 1) * step)) if i < 2 else F.col("ts") >= F.lit(first + 2 * step)
        events.filter(inside).write.mode("append").parquet(landing)
        lookups(spark, landing, events.schema, out, checkpoint)
    return spark.read.parquet(f"{out}/batch=*").select("event_id", "hit")
