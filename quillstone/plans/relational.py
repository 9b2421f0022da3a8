"""Filters, joins, aggregates, windows, sets and maintenance on the star schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions.dates import age_days, days_between, week_label
from quillstone.functions.numbers import band
from quillstone.operators import relational as R
from quillstone.operators.filters import contains_any, recent_or_unknown
from quillstone.operators.similarity import small
from quillstone.registry import query
from quillstone.session import spread

AS_OF = datetime(2001, 8, 1)
EVENTS_AS_OF = datetime(2024, 1, 30)
#: Rows of two numbers that are broadcast, some 16 MB.
PAIRED_ROWS = 1_000_000
BANDS = ((400000, "e"), (300000, "d"), (200000, "c"), (100000, "b"))
BAND_SQL = "CASE WHEN o_totalprice >= 400000 THEN 'e' WHEN o_totalprice >= 300000 THEN 'd' WHEN o_totalprice >= 200000 THEN 'c' WHEN o_totalprice >= 100000 THEN 'b' ELSE 'a' END"


def price_band():
    return band(F.col("o_totalprice"), BANDS, "a")


@query("filter_recent_nullable", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY AND (nullif(o_orderpriority, '5-LOW') IS NULL OR o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY)")
def filter_recent_nullable(spark, read):
    o = read("orders").filter(F.col("o_orderdate") >= F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(365)))
    second = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    return o.filter(recent_or_unknown(second, AS_OF, 90)).select("o_orderkey", "o_orderpriority")


@query("filter_composite_ranked", "SELECT o_orderkey, c_name, o_totalprice, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank FROM orders JOIN customer ON o_custkey = c_custkey WHERE coalesce(o_totalprice, 0) >= 100000 AND c_acctbal > 0 ORDER BY rank, o_totalprice DESC, o_orderkey LIMIT 50")
def filter_composite_ranked(spark, read):
    o = read("orders").filter(F.coalesce("o_totalprice", F.lit(0)) >= 100000)
    c = read("customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    out = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "o_totalprice", rank.alias("rank"))
    return out.orderBy("rank", F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("page_offset", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%1%' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def page_offset(spark, read):
    return read("customer").filter(contains_any(F.col("c_name"), ("1",))).orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@query("search_ilike", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%red%'")
def search_ilike(spark, read):
    return read("part").filter(contains_any(F.col("p_name"), ("RED",)) | contains_any(F.col("p_brand"), ("red",))).select("p_partkey", "p_name", "p_brand")


@query("region_predicate", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name ILIKE '%an%' OR n_name ILIKE '%us%' OR r_name ILIKE '%eur%'")
def region_predicate(spark, read):
    n, r = read("nation"), read("region")
    return n.join(small(r), F.col("n_regionkey") == F.col("r_regionkey")).filter(contains_any(F.col("n_name"), ("an", "us")) | contains_any(F.col("r_name"), ("eur",))).select("n_nationkey", "n_name", "r_name")


@query("stats_one_pass", "SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount > 0) AS discounted, round(avg(l_extendedprice), 1) AS avg_price, max(l_extendedprice) AS max_price, round(avg(l_quantity) FILTER (l_quantity > 0), 1) AS avg_quantity FROM lineitem")
def stats_one_pass(spark, read):
    return read("lineitem").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0).alias("discounted"),
        F.round(F.avg("l_extendedprice"), 1).alias("avg_price"), F.max("l_extendedprice").alias("max_price"), F.round(F.avg(F.when(F.col("l_quantity") > 0, F.col("l_quantity"))), 1).alias("avg_quantity"),
    )


@query("group_count_desc", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def group_count_desc(spark, read):
    return read("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderstatus")


@query("distinct_sources", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source <> '' ORDER BY 1")
def distinct_sources(spark, read):
    return read("documents").filter("source is not null and source <> ''").select("source").distinct().orderBy("source")


@query("response_rate_by_segment", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS total, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN c_custkey END) AS responded, round(100.0 * count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN c_custkey END) / count(DISTINCT c_custkey), 1) AS rate FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def response_rate_by_segment(spark, read):
    # One row for each customer first: two plain sums instead of two distinct counts, and no Expand.
    flags = read("orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"))
    c = read("customer").select("c_custkey", "c_mktsegment").distinct()
    out = c.join(flags, c["c_custkey"] == flags["o_custkey"], "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce("f", F.lit(0))).alias("responded"))
    return out.withColumn("rate", F.round(100.0 * F.col("responded") / F.col("total"), 1))


@query("avg_latency_days", "SELECT o_orderpriority, count(*) AS n, round(avg((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0), 3) AS avg_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def avg_latency_days(spark, read):
    j = read("lineitem").select("l_orderkey", "l_shipdate").join(read("orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(days_between(F.col("l_shipdate"), F.col("o_orderdate"))), 3).alias("avg_days"))


@query("usage_by_type", "SELECT event_type, count(*) AS calls, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS ok, round(sum(value), 2) AS cost FROM events GROUP BY 1")
def usage_by_type(spark, read):
    return read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") != "error").alias("ok"), F.round(F.sum("value"), 2).alias("cost"))


@query("usage_by_day", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def usage_by_day(spark, read):
    return read("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("company_rollup_topn", "SELECT l_suppkey, count(*) AS n, max(coalesce(l_extendedprice, 0)) AS best, max(l_shipdate) AS latest FROM lineitem GROUP BY 1 ORDER BY n DESC, best DESC, l_suppkey LIMIT 25")
def company_rollup_topn(spark, read):
    out = read("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("l_extendedprice", F.lit(0.0))).alias("best"), F.max("l_shipdate").alias("latest"))
    return out.orderBy(F.desc("n"), F.desc("best"), "l_suppkey").limit(25)


@query("status_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def status_semi(spark, read):
    return read("customer").join(read("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("status_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def status_anti(spark, read):
    return read("customer").join(read("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("join_same_key_other_row", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def join_same_key_other_row(spark, read):
    """Every supplier with each other one of its nation; same_key_other_rows counts them without listing the pairs."""
    a, b = (read("supplier").select("s_nationkey", F.col("s_suppkey").alias(x)) for x in "ab")
    # Two numbers a row, so that many rows are small; the left side is spread, as nations are few.
    return spread(a).join(small(b, PAIRED_ROWS), "s_nationkey").filter("a <> b").select("a", "b")


@query("same_key_other_rows", "SELECT a.s_suppkey AS a, count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1")
def same_key_other_rows(spark, read):
    """How many other suppliers share each one's nation, without listing the pairs; s_suppkey is unique."""
    s = read("supplier").filter("s_suppkey IS NOT NULL")
    n = s.groupBy("s_nationkey").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0")
    return s.join(n, "s_nationkey").select(F.col("s_suppkey").alias("a"), "n")


@query("case_insensitive_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) = lower('Nation_3')")
def case_insensitive_lookup(spark, read):
    n = read("nation").filter(F.lower("n_name") == "nation_3")
    return read("customer").join(small(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("membership_flag", "SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') AS listed FROM customer")
def membership_flag(spark, read):
    listed = read("nation").join(small(read("region").filter("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lit(True).alias("hit"))
    return read("customer").join(small(listed), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("listed"))


@query("latest_event_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_per_user(spark, read):
    # max_by is aggregated before the shuffle; a window would ship every row
    best = read("events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("b"))
    return best.select("user_id", "b.*")


@query("topk_per_group", "SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def topk_per_group(spark, read):
    return R.top_per_group(read("orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query("daily_lags", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), l AS (SELECT day, n, lag(n, 1) OVER (ORDER BY day) AS lag1, lag(n, 2) OVER (ORDER BY day) AS lag2 FROM d) SELECT day, n, lag1, lag2, n - lag1 AS delta FROM l WHERE lag1 IS NOT NULL AND lag2 IS NOT NULL")
def daily_lags(spark, read):
    # The window has no key, but holds one row for each day only.
    d = read("events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day")
    return d.withColumns({"lag1": F.lag("n", 1).over(w), "lag2": F.lag("n", 2).over(w)}).dropna().withColumn("delta", F.col("n") - F.col("lag1"))


@query("share_within_band", f"WITH c AS (SELECT {BAND_SQL} AS band, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) SELECT band, o_orderstatus, n, round(n / sum(n) OVER (PARTITION BY band), 4) AS share FROM c")
def share_within_band(spark, read):
    return R.shares(read("orders").withColumn("band", price_band()), ["band"], ["o_orderstatus"])


@query("histogram_bands", f"SELECT {BAND_SQL} AS band, count(*) AS n, min(o_totalprice) AS low FROM orders GROUP BY 1 ORDER BY low")
def histogram_bands(spark, read):
    return read("orders").groupBy(price_band().alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low")).orderBy("low")


@query("week_type_counts", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, strftime(ts, '%Y-W%W') AS label, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def week_type_counts(spark, read):
    return read("events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), week_label(F.col("ts")).alias("label"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("having_rollup", "SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 2) AS avg_bal FROM supplier GROUP BY 1 HAVING count(*) >= 3")
def having_rollup(spark, read):
    return read("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 2).alias("avg_bal")).filter("n >= 3")


@query("pct_of_total", "SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2) AS pct FROM orders GROUP BY 1")
def pct_of_total(spark, read):
    g = read("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


@query("value_counts_top", "SELECT c_mktsegment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM customer GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def value_counts_top(spark, read):
    g = read("customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1)).orderBy(F.desc("n"), "c_mktsegment").limit(3)


NULLED_SQL = "SELECT nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority, o_totalprice AS price FROM orders"


def nulled(read):
    return read("orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.col("o_totalprice").alias("price"))


PROFILE_SQL = f"WITH t AS ({NULLED_SQL}), p AS (SELECT 'status' AS column_name, count(*) - count(status) AS null_count, count(*) AS n FROM t UNION ALL SELECT 'priority', count(*) - count(priority), count(*) FROM t UNION ALL SELECT 'price', count(*) - count(price), count(*) FROM t) SELECT column_name, null_count, round(100 * null_count / n, 2) AS null_pct FROM p"


@query("null_profile", PROFILE_SQL)
def null_profile(spark, read):
    return R.null_profile(nulled(read))


@query("completeness", f"SELECT round(1 - avg(null_pct) / 100, 4) AS completeness, round((2 - avg(null_pct) / 100) / 2, 4) AS overall, count(*) FILTER (null_pct > 10) AS issues FROM ({PROFILE_SQL})")
def completeness(spark, read):
    return R.completeness(R.null_profile(nulled(read)))


@query("table_population", "SELECT t AS table_name, n, n > 0 AS populated FROM (SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'part', count(*) FROM part) ORDER BY n DESC, t")
def table_population(spark, read):
    counts = R.union_all(*(read(t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t in ("orders", "events", "documents", "part")))
    return counts.withColumn("populated", F.col("n") > 0).orderBy(F.desc("n"), "table_name")


@query("union_periods", "SELECT 'old' AS period, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT 'new', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def union_periods(spark, read):
    cut = F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz")
    agg = lambda df, name: df.agg(F.lit(name).alias("period"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    o = read("orders")
    return R.union_all(agg(o.filter(F.col("o_orderdate") < cut), "old"), agg(o.filter(F.col("o_orderdate") >= cut), "new"))


@query("json_props_rollup", "SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n, round(avg(value), 3) AS avg_value FROM events GROUP BY 1")
def json_props_rollup(spark, read):
    return read("events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 3).alias("avg_value"))


@query("dedup_two_key", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang, source, n_chars ORDER BY doc_id) AS s FROM a WHERE r = 1) SELECT doc_id FROM b WHERE s = 1")
def dedup_two_key(spark, read):
    d = read("documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("h"))
    return R.dedup_two_keys(d, ["h"], ["lang", "source", "n_chars"], "doc_id").select("doc_id")


@query("dedup_keep_last", "SELECT max(doc_id) AS doc_id, lang, source FROM documents GROUP BY lang, source")
def dedup_keep_last(spark, read):
    return R.keep_last(read("documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id").select("doc_id", "lang", "source")


@query("dedup_anti", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def dedup_anti(spark, read):
    d = read("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return R.unseen(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "h").select("doc_id")


@query("upsert_merge", """
WITH store AS (SELECT user_id, max(event_id) AS last_event, max(value) AS best, DATE '2024-01-01' AS first_seen, DATE '2024-01-10' AS last_seen FROM events WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1),
batch AS (SELECT user_id, max(event_id) AS last_event, nullif(max(value) FILTER (event_type = 'purchase'), 0) AS best FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)
SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(b.last_event, s.last_event) AS last_event, round(coalesce(b.best, s.best), 6) AS best,
       coalesce(s.first_seen, DATE '2024-01-30') AS first_seen, CASE WHEN b.user_id IS NULL THEN s.last_seen ELSE DATE '2024-01-30' END AS last_seen
FROM store s FULL JOIN batch b ON s.user_id = b.user_id""")
def upsert_merge(spark, read):
    e = read("events")
    store = e.filter(F.col("ts") < F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")).groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max("value").alias("best"))
    store = store.withColumn("first_seen", F.lit("2024-01-01").cast("date")).withColumn("last_seen", F.lit("2024-01-10").cast("date"))
    batch = e.filter(F.col("ts") >= F.lit(datetime(2024, 1, 29)).cast("timestamp_ntz")).groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.nullif(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("best"))
    return R.upsert(store, batch, "user_id", ["best"], F.lit("2024-01-30").cast("date")).withColumn("best", F.round("best", 6))


@query("insert_or_ignore", "SELECT user_id, min(event_id) AS first_event FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view') GROUP BY 1")
def insert_or_ignore(spark, read):
    kind = lambda k: read("events").filter(F.col("event_type") == k).groupBy("user_id").agg(F.min("event_id").alias("first_event"))
    return R.insert_missing(kind("view"), kind("error"), "user_id")


@query("replaced_rows", "SELECT user_id, min(event_id) AS event FROM events WHERE event_type = 'error' GROUP BY 1 UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1")
def replaced_rows(spark, read):
    """Rows of one kind put in the place of another kind's with the same key."""
    kind = lambda k: read("events").filter(F.col("event_type") == k).groupBy("user_id").agg(F.min("event_id").alias("event"))
    return R.replace_all(kind("view"), kind("error"), "user_id")


@query("ttl_lookup", "WITH c AS (SELECT user_id, max(ts) AS cached FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, cached, cached > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AS fresh FROM c")
def ttl_lookup(spark, read):
    c = read("events").filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("cached"))
    return c.withColumn("fresh", F.col("cached") > F.lit(EVENTS_AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(7)))


@query("as_of_state", "SELECT p.event_id, (SELECT max(s.ts) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts) AS signup_ts FROM events p WHERE p.event_type = 'purchase'")
def as_of_state(spark, read):
    e = read("events")
    states = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("s_ts"), F.col("ts").alias("signup_ts"))
    return R.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), states, "user_id", "ts", "s_ts", ["signup_ts"]).select("event_id", "signup_ts")


RANGE_SQL = "(SELECT 'small' AS name, 0.0 AS low, 120000.0 AS high UNION ALL SELECT 'middle', 100000.0, 300000.0 UNION ALL SELECT 'large', 250000.0, 600000.0)"


@query("interval_join", f"SELECT name, count(*) AS n FROM orders JOIN {RANGE_SQL} r ON o_totalprice >= low AND o_totalprice <= high GROUP BY 1")
def interval_join(spark, read):
    ranges = spark.createDataFrame([("small", 0.0, 120000.0), ("middle", 100000.0, 300000.0), ("large", 250000.0, 600000.0)], "name string, low double, high double")
    return R.interval_matches(read("orders"), F.col("o_totalprice"), "low", "high", ranges, 100000.0).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("outcome_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 3) AS f_rate FROM orders GROUP BY 1")
def outcome_pivot(spark, read):
    g = read("orders").groupBy("o_orderpriority").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"), F.count(F.lit(1)).alias("all"))
    return g.withColumn("f_rate", F.round(F.col("f") / F.col("all"), 3)).drop("all")


@query("cluster_rollup", "SELECT s_nationkey, count(*) AS n, array_to_string(list_sort(list(s_suppkey)), ',') AS members, count(DISTINCT CAST(floor(s_acctbal / 1000) AS BIGINT)) AS kinds FROM supplier GROUP BY 1")
def cluster_rollup(spark, read):
    return read("supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",").alias("members"), F.count_distinct(F.floor(F.col("s_acctbal") / 1000)).alias("kinds"))


@query("concentration", "WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT round(max(n) / sum(n), 4) AS concentration, round(count(*) / (0.1 * sum(n)), 4) AS diversity FROM g")
def concentration(spark, read):
    g = read("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(F.max("n") / F.sum("n"), 4).alias("concentration"), F.round(F.count(F.lit(1)) / (0.1 * F.sum("n")), 4).alias("diversity"))


NETWORK_SQL = """
WITH c AS (SELECT c_nationkey, CASE c_custkey % 19 WHEN 0 THEN 'Google LLC' WHEN 1 THEN 'Meta Platforms' ELSE c_mktsegment || ' ' || CAST(c_custkey % 40 AS VARCHAR) END AS company,
                  CASE WHEN c_custkey % 10 <> 9 THEN CAST(c_custkey % 6 AS VARCHAR) END AS place, CASE c_custkey % 23 WHEN 0 THEN 'VP of Data' WHEN 5 THEN 'Head of Platform' WHEN 9 THEN NULL ELSE 'Engineer' END AS title FROM customer),
n AS (SELECT c_nationkey, least(20, count(DISTINCT company) / count(*) * 20) + least(15, count(DISTINCT place) * 3)
        + least(25, 5 * count(*) FILTER (regexp_matches(lower(company), 'airbnb|uber|google|microsoft|amazon|apple|meta')))
        + least(20, count(*) * 2) + least(20, 4 * count(*) FILTER (regexp_matches(lower(title), 'director|vp|ceo|cto|head of|chief'))) AS s FROM c GROUP BY 1)
SELECT c_nationkey, CAST(round(s, 1) AS DOUBLE) AS score, CASE WHEN s >= 80 THEN 'Excellent' WHEN s >= 60 THEN 'Very Good' WHEN s >= 40 THEN 'Good' ELSE 'Building' END AS rating FROM n
"""


@query("network_quality", NETWORK_SQL)
def network_quality(spark, read):
    """The contacts of each nation; companies, places and titles come by the key."""
    key = F.col("c_custkey")
    company = F.when(key % 19 == 0, "Google LLC").when(key % 19 == 1, "Meta Platforms").otherwise(F.concat_ws(" ", "c_mktsegment", (key % 40).cast("string")))
    title = F.when(key % 23 == 0, "VP of Data").when(key % 23 == 5, "Head of Platform").when(key % 23 != 9, "Engineer")
    contacts = read("customer").select("c_nationkey", company.alias("company"), F.when(key % 10 != 9, (key % 6).cast("string")).alias("place"), title.alias("title"))
    return R.network_quality(contacts, ["c_nationkey"], "company", "place", "title")


@query("priority_bands", "SELECT count(*) FILTER (l_discount >= 0.09) AS high, count(*) FILTER (l_discount >= 0.05 AND l_discount < 0.09) AS middle, count(*) FILTER (l_discount < 0.05) AS low, round(avg(l_discount), 4) AS mean FROM lineitem")
def priority_bands(spark, read):
    d = F.col("l_discount")
    return read("lineitem").agg(F.count_if(d >= 0.09).alias("high"), F.count_if((d >= 0.05) & (d < 0.09)).alias("middle"), F.count_if(d < 0.05).alias("low"), F.round(F.avg(d), 4).alias("mean"))


@query("age_days", "SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '2001-08-01 12:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS age FROM orders")
def age_of_orders(spark, read):
    return read("orders").select("o_orderkey", age_days(F.lit(datetime(2001, 8, 1, 12)).cast("timestamp_ntz"), F.col("o_orderdate")).alias("age"))


@query("rolling_week", "WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT day, event_type, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM d")
def rolling_week(spark, read):
    d = read("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("d", F.unix_date("day"))
    return d.select("day", "event_type", F.sum("n").over(Window.partitionBy("event_type").orderBy("d").rangeBetween(-6, 0)).alias("week"))


@query("tiered_queue", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS tier, o_totalprice FROM orders ORDER BY tier, o_totalprice DESC, o_orderkey LIMIT 30")
def tiered_queue(spark, read):
    tier = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return read("orders").select("o_orderkey", tier.alias("tier"), "o_totalprice").orderBy("tier", F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("latest_two_rollup", "SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (o_orderstatus, c_mktsegment)")
def rollup_extension(spark, read):
    j = read("orders").join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return j.rollup("o_orderstatus", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("delete_and_deactivate", "SELECT event_id, ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AS is_active FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAY")
def delete_and_deactivate(spark, read):
    now = F.lit(EVENTS_AS_OF).cast("timestamp_ntz")
    return read("events").filter(F.col("ts") >= now - F.make_dt_interval(F.lit(20))).select("event_id", (F.col("ts") >= now - F.make_dt_interval(F.lit(7))).alias("is_active"))


@query("seeded_sample")
def seeded_sample(spark, read):
    """A repeatable random sample: the feature is the limit."""
    return read("documents").select("doc_id", "lang").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(50)
