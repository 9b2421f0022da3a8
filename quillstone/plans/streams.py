"""Windows over events: what the streams compute, in batch form, and a stream run to its end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators.relational import circuit_states
from quillstone.registry import query
from quillstone.shelf import Shelf
from quillstone.streaming import ingest


@query("tumbling_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, read):
    return ingest.tumbling(read("events"), "ts", "1 day", "event_type")


@query("sliding_counts", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, ts, time_bucket(INTERVAL '6 hours', ts) - to_hours(6 * CAST(i AS INT)) AS start FROM events, unnest(range(4)) AS t(i)) GROUP BY 1, 2")
def sliding_counts(spark, read):
    return ingest.sliding(read("events"), "ts", "24 hours", "6 hours", "event_type")


SESSION_SQL = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '8 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid"


@query("session_counts", SESSION_SQL)
def session_counts(spark, read):
    return ingest.sessions(read("events"), "ts", "8 hours", "user_id")


@query("rate_limiter", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM events")
def rate_limiter(spark, read):
    e = read("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-21_600_000_000, 0)).alias("recent"))


CIRCUIT_SQL = """
WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, event_id % 3 <> 0 AS failed FROM events),
r AS (SELECT *, count(*) FILTER (NOT failed) OVER w AS run, max(CASE WHEN failed THEN t END) OVER w AS last, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM r)
SELECT event_id, failures, CASE WHEN failures >= 3 THEN 'OPEN' ELSE 'CLOSED' END AS state, CASE WHEN next IS NOT NULL THEN CAST(failures < 3 OR next - last > 36000 AS INT) END AS next_may_go FROM f
"""


@query("circuit_breaker", CIRCUIT_SQL)
def circuit_breaker(spark, read):
    """Events as calls of their users; two of three fail."""
    calls = read("events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), (F.col("event_id") % 3 != 0).alias("failed"))
    return circuit_states(calls, "user_id", "t", "event_id", "failed", 3, 36_000.0).select("event_id", "failures", "state", F.col("next_may_go").cast("int").alias("next_may_go"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, read):
    """The same counts from a file stream that is run until all input is read."""
    schema = read("events").schema
    shelf = Shelf(spark, "stream")
    source = shelf.put(read("events"), "landing")
    stream = ingest.landing(spark, f"{shelf.path}/landing", schema)
    counts = ingest.tumbling(stream, "ts", "1 day", "event_type")
    sink = counts.writeStream.outputMode("update").foreachBatch(ingest.replace_groups(f"{shelf.path}/counts", ["start", "event_type"]))
    sink.option("checkpointLocation", f"{shelf.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    del source
    return ingest.latest_groups(spark, f"{shelf.path}/counts", ["start", "event_type"], counts.schema)
