"""Relational operators that SQL spells awkwardly: latest rows, deduplication, upserts, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order; the order has to end with a unique column."""
    return top_per_group(df, keys, order, 1).drop("rank")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank. Spark keeps only k rows of a key in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: list[str], ingest: str) -> DataFrame:
    """One row of each key, the first in ingest order: a pre-aggregated minimum, with no sort."""
    return _keep(df, keys, F.min_by, ingest)


def keep_last(df: DataFrame, keys: list[str], ingest: str) -> DataFrame:
    return _keep(df, keys, F.max_by, ingest)


def _keep(df: DataFrame, keys: list[str], pick, ingest: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(ingest)).alias("__best"))
    return best.select(*keys, "__best.*").select(*df.columns)


def dedup_two_keys(df: DataFrame, first: list[str], second: list[str], ingest: str) -> DataFrame:
    """Duplicates by the first key go, then of what is left those by the second; earlier rows stay."""
    return keep_first(keep_first(df, first, ingest), second, ingest)


def unseen(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key the store lacks; within the batch nothing is removed."""
    return batch.join(store.select(key), key, "left_anti")


def upsert(store: DataFrame, batch: DataFrame, key: str, keep_if_null: list[str], now: Column, first_seen: str = "first_seen", last_seen: str = "last_seen") -> DataFrame:
    """The store with a batch merged in by key; the batch has each key once.

    A known key takes the batch's values, but keeps the old ones of keep_if_null columns
    where the batch has null, and its first_seen. last_seen becomes now for all keys of the batch.
    """
    columns = [c for c in store.columns if c not in (key, first_seen, last_seen)]
    s, b = store.alias("s"), batch.withColumn("__new", F.lit(True)).alias("b")
    both = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer")
    new = F.coalesce(F.col("b.__new"), F.lit(False))

    def merged(c: str) -> Column:
        fresh = F.col(f"b.{c}") if c in batch.columns else F.lit(None)
        return (F.coalesce(fresh, F.col(f"s.{c}")) if c in keep_if_null else F.when(new, fresh).otherwise(F.col(f"s.{c}"))).alias(c)

    return both.select(
        F.coalesce(f"s.{key}", f"b.{key}").alias(key),
        *map(merged, columns),
        F.coalesce(F.col(f"s.{first_seen}"), now).alias(first_seen),
        F.when(new, now).otherwise(F.col(f"s.{last_seen}")).alias(last_seen),
    )


def insert_missing(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return store.unionByName(unseen(batch, store, key), allowMissingColumns=True)


def replace_all(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return store.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and share of every column, in one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns)))
    return sums.select("__n", each.alias("p")).select("p.column_name", "p.null_count", F.round(100 * F.col("p.null_count") / F.nullif("__n", F.lit(0)), 2).alias("null_pct"))


def completeness(profile: DataFrame, limit_pct: float = 10.0) -> DataFrame:
    """One row: completeness, overall quality, and how many columns exceed the limit of nulls."""
    share = 1 - F.avg("null_pct") / 100
    return profile.agg(F.round(share, 4).alias("completeness"), F.round((share + 1) / 2, 4).alias("overall"), F.count_if(F.col("null_pct") > limit_pct).alias("issues"))


def shares(df: DataFrame, within: list[str], by: list[str]) -> DataFrame:
    """Counts by within and by, and the share of each among its within group."""
    counts = df.groupBy(*within, *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*within)), 4))


def interval_matches(rows: DataFrame, value: Column, low: str, high: str, ranges: DataFrame, width: float) -> DataFrame:
    """Rows joined to all ranges that hold their value, by equal buckets of a width about that of a range."""
    bucketed = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return rows.withColumn("__bucket", F.floor(value / width)).join(bucketed, "__bucket").filter((value >= F.col(low)) & (value <= F.col(high))).drop("__bucket")


def as_of(events: DataFrame, states: DataFrame, key: str, event_time: str, state_time: str, values: list[str]) -> DataFrame:
    """Each event with the values of its key's latest state not after it: a union and one window, no pairs."""
    left = events.select("*", F.col(event_time).alias("__t"), F.lit(1).alias("__side"), *(F.lit(None).cast(states.schema[v].dataType).alias(v) for v in values))
    right = states.select(key, F.col(state_time).alias("__t"), F.lit(0).alias("__side"), *values)
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({v: F.last(v, True).over(w) for v in values}).filter("__side = 1").drop("__t", "__side")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def circuit_states(calls: DataFrame, key: str, time: str, order: str, failed: str, threshold: int = 3, recovery: float = 60.0) -> DataFrame:
    """calls with what a circuit breaker of each key holds after each: failures, state and whether the next call may go out.

    Failures in a row open the circuit from the threshold on, a success closes it; the next
    call may try again once the last failure is longer ago than recovery (in seconds).
    time is a number of seconds; ties go by order. The last call of a key has no next one: null.
    """
    line = Window.partitionBy(key).orderBy(time, order)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    staged = calls.withColumn("__run", F.count_if(~F.col(failed)).over(upto)).withColumn("__last", F.max(F.when(F.col(failed), F.col(time))).over(upto)).withColumn("__next", F.lead(time).over(line))
    in_a_row = Window.partitionBy(key, "__run").orderBy(time, order).rowsBetween(Window.unboundedPreceding, 0)
    out = staged.withColumn("failures", F.count_if(F.col(failed)).over(in_a_row))
    out = out.withColumn("state", F.when(F.col("failures") >= threshold, "OPEN").otherwise("CLOSED"))
    may = F.when(F.col("__next").isNotNull(), (F.col("state") == "CLOSED") | (F.col("__next") - F.col("__last") > recovery))
    return out.withColumn("next_may_go", may).drop("__run", "__last", "__next")


def blocks(df: DataFrame, key: str, rows: int, text: str | None = None, most: int = 1 << 24) -> list[DataFrame]:
    """df itself if it has at most so many rows, and at most so many bytes in text; otherwise disjoint parts by a hash of key, about half as large each, that make the whole."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)).first()
    parts = max(1 if n <= rows else -(-2 * n // rows), 1 if size <= most else -(-2 * size // most))
    return [df] if parts == 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


# Companies that count as valued contacts, and words of leading titles.
VALUED_COMPANIES = ("airbnb", "uber", "google", "microsoft", "amazon", "apple", "meta")
LEADING_TITLES = ("director", "vp", "ceo", "cto", "head of", "chief")


def network_quality(contacts: DataFrame, keys: list[str], company: str, place: str, title: str) -> DataFrame:
    """Score up to 100 and rating of each group of contacts.

    Five parts: 20 times the share of distinct companies, 3 a place up to 15, 5 a contact at a
    valued company up to 25, 2 a contact up to 20, 4 a leading title up to 20. Null values
    count as no company, place or title, but their rows as contacts.
    """
    has = lambda c, terms: F.count_if(reduce(lambda x, y: x | y, (F.contains(F.lower(c), F.lit(t)) for t in terms)))
    n, capped = F.count(F.lit(1)), lambda most, x: F.least(F.lit(float(most)), x.cast("double"))
    score = capped(20, 20 * F.count_distinct(company) / n) + capped(15, 3 * F.count_distinct(place)) + capped(25, 5 * has(company, VALUED_COMPANIES)) + capped(20, 2 * n) + capped(20, 4 * has(title, LEADING_TITLES))
    rating = F.when(F.col("s") >= 80, "Excellent").when(F.col("s") >= 60, "Very Good").when(F.col("s") >= 40, "Good").otherwise("Building")
    return contacts.groupBy(*keys).agg(score.alias("s")).select(*keys, F.round("s", 1).alias("score"), rating.alias("rating"))
