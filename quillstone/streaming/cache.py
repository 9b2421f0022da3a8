"""A cache whose entries live for a while, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillstone.streaming.ingest import landing, replace_groups

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lifetime of an entry.
LIFETIME_US = 6 * 3_600_000_000


#: Keys share the states of so many buckets: what a batch asks of the state store grows with the buckets that it meets, not with its keys.
BUCKETS = 1024


def fetches(start: np.ndarray, us: np.ndarray, held: np.ndarray, known: np.ndarray, lifetime_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Which look-ups fetch, and the last fetch of each key.

    us are the times of the look-ups key by key, in order; start says where each key's begin,
    held when it was fetched before, if it is among the known ones.
    """
    n, keys = len(us), len(start)
    end, key = np.append(start[1:], n), np.repeat(np.arange(keys), np.diff(np.append(start, n)))
    after = np.empty(n, np.int64)
    # The next look-up of the key that is too late for one: all keys at once, by times that are shifted apart.
    low = int(us.min())
    span = int(us.max()) - low + lifetime_us + 1
    step = max(1, (1 << 62) // span)
    for a in range(0, keys, step):
        rows = slice(start[a], end[min(a + step, keys) - 1])
        apart = (key[rows] - a) * span + (us[rows] - low)
        after[rows] = np.searchsorted(apart, apart + lifetime_us) + rows.start
    after = np.minimum(after, end[key])
    first = start.copy()
    for k in np.flatnonzero(known):
        first[k] += np.searchsorted(us[start[k] : end[k]], held[k] + lifetime_us)
    fetched, last = np.zeros(n, bool), held.copy()
    live = np.flatnonzero(first < end)
    at = first[live]
    while len(live):  # once for each fetch of the key with most of them
        fetched[at], last[live] = True, us[at]
        at = after[at]
        more = at < end[live]
        live, at = live[more], at[more]
    return fetched, last


class Lookups(StatefulProcessor):
    """Of each key the time of its last fetch; a look-up within the lifetime is a hit, any other fetches again.

    A batch's look-ups of a key are taken in the order of time, then of id. A state is that of
    a bucket of keys. A key goes from it when the watermark shows that no hit can come from it,
    and the state when no key is left.
    """

    def __init__(self, key_type: str, lifetime_us: int = LIFETIME_US):
        self.key_type, self.lifetime_us = key_type, lifetime_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetched = handle.getValueState("fetched", f"keys array<{self.key_type}>, us array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        code, names = pd.factorize(batch["key"], use_na_sentinel=False)
        order = np.lexsort((batch["event_id"].to_numpy(), batch["us"].to_numpy(), code))
        code, us = code[order], batch["us"].to_numpy()[order]
        state = self.fetched.get()
        before = dict(zip(*state)) if state is not None else {}
        names = list(pd.Series(names).astype(object))
        known = np.array([name in before for name in names])
        held = np.array([before.get(name, 0) for name in names], np.int64)
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        fetched, last = fetches(start, us, held, known, self.lifetime_us)
        after = before | dict(zip(names, last.tolist()))
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        after = {name: t for name, t in after.items() if t + self.lifetime_us > seen}
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if after:
            self.fetched.update((list(after), list(after.values())))
            self.handle.registerTimer((max(after.values()) + self.lifetime_us) // 1000 + 1)
        else:
            self.fetched.clear()
        yield pd.DataFrame({"event_id": batch["event_id"].to_numpy()[order], "hit": ~fetched})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fetched.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "hit": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def cached(stream: DataFrame, key: str, time: str, event_id: str, lifetime_us: int = LIFETIME_US) -> DataFrame:
    """event_id and hit of every look-up of a stream; rows without a key or a time are passed over."""
    rows = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col(time).cast("timestamp").alias("at")).withColumn("us", F.unix_micros("at"))
    marked = rows.withWatermark("at", "0 seconds").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return marked.groupBy("bucket").transformWithStateInPandas(Lookups(rows.schema["key"].dataType.simpleString(), lifetime_us), "event_id long, hit boolean", "Append", "EventTime")


def lookups(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str) -> None:
    """Runs the stream over what has arrived in folder since it ran last, and stops; what it knows is in the checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        found = cached(landing(spark, folder, schema, 100_000), "user_id", "ts", "event_id")
        sink = found.writeStream.outputMode("append").foreachBatch(replace_groups(out, ["event_id"])).option("checkpointLocation", checkpoint)
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
