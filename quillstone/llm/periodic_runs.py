"""Maximal periodic runs of words, found with string synchronising sets.

A run is a stretch of words that repeats with a period, at least MIN_EXPONENT times. Periods
are searched for at dyadic scales. At scale t, a position is synchronising if the least hash
among the t-word windows that start in the t + 1 positions from it on is that of the first or
the last of them; windows with a period of t / 4 or less take no part. Whether a position is
chosen depends on its next 2t words alone, so that equal contexts are chosen alike, and a run
with a period from t to 2t - 1 has a chosen position whose context comes again one period on.
Chosen positions with equal contexts next to each other propose periods, and each proposal is
carried to both sides as far as the words themselves allow.

The windows that take no part lie in highly periodic regions. Those are known by then: their
runs have periods of t / 4 or less, and come from smaller scales. Periods under FIRST_SCALE
are read off directly, by comparing the words with themselves a few words on.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shingles import mix

#: A run is so many words long at least, and so many periods.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: The smallest scale; smaller periods are compared directly.
FIRST_SCALE = 4
#: Words of short texts that are searched together; a longer text goes alone.
WORDS_AT_ONCE = 1 << 17
#: Words compared at once when a run is carried on.
STEP = 64

RUNS = "array<struct<start:long,length:long,period:long>>"


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def _small_periods(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) with periods under FIRST_SCALE and MIN_EXPONENT periods at least."""
    found = []
    for p in range(1, min(FIRST_SCALE, len(ids))):
        starts, ends = _stretches(ids[p:] == ids[:-p])
        long = ends - starts >= (MIN_EXPONENT - 1) * p
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            # A smaller period of such a stretch divides p.
            if not any(p % q == 0 and (ids[a : a + p] == ids[a + q : a + p + q]).all() for q in range(1, p)):
                found.append((a, b + p, p))
    return found


def _carried(ids: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """Start and end of the longest stretch around at in which words p apart are equal."""
    n, lo, hi, step = len(ids), at, at + p, STEP
    while hi < n:
        far = min(n, hi + step)
        differ = np.flatnonzero(ids[hi:far] != ids[hi - p : far - p])
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = far, 2 * step
    step = STEP
    while lo > 0:
        far = max(0, lo - step)
        differ = np.flatnonzero(ids[far:lo] != ids[far + p : lo + p])
        if len(differ):
            lo = far + int(differ[-1]) + 1
            break
        lo, step = far, 2 * step
    return lo, hi


def _least_over(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values next to each other."""
    out, have = values, 1
    while have < width:
        more = min(have, width - have)
        out = np.minimum(out[: len(out) - more], out[more:])
        have += more
    return out


def synchronising(hashes: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """The chosen positions; hashes and periodic are those of the scale-word windows from each position on."""
    last = np.uint64(2**64 - 1)
    key = np.where(periodic, last, np.minimum(hashes, last - np.uint64(1)))
    if len(key) <= scale:
        return np.zeros(0, np.int64)
    least = _least_over(key, scale + 1)
    return np.flatnonzero((least < last) & ((key[: len(least)] == least) | (key[scale:] == least)))


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of stretches of 2 * width words, from those of width words."""
    if len(hashes) <= width:
        return hashes[:0]
    return mix(hashes[:-width] * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[width:]))


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of at least MIN_EXPONENT periods in ids, in any order.

    Numbers stand for words. Several texts may follow each other with a number between them
    that comes once; longest is the length of the longest.
    """
    runs = _small_periods(ids)
    hashes, scale = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while 2 * scale <= FIRST_SCALE and len(hashes):
        hashes, scale = _windows(hashes, scale), 2 * scale
    while MIN_EXPONENT * scale <= longest:
        wider = _windows(hashes, scale)
        inside = np.zeros(len(hashes) + 1, np.int32)
        for a, b, p in runs:
            if 4 * p <= scale <= b - a:
                inside[a] += 1
                inside[b - scale + 1] -= 1
        chosen = synchronising(hashes, np.cumsum(inside[:-1]) > 0, scale)
        order = chosen[np.argsort(wider[chosen], kind="stable")]
        apart = order[1:] - order[:-1]
        proposed = np.flatnonzero((wider[order[1:]] == wider[order[:-1]]) & (apart >= scale) & (apart < 2 * scale))
        by_period: dict[int, list[int]] = defaultdict(list)
        for at, p in zip(order[proposed].tolist(), apart[proposed].tolist()):
            by_period[p].append(at)
        for p, places in by_period.items():
            places.sort()
            k = 0
            while k < len(places):
                lo, hi = _carried(ids, places[k], p)
                if hi - lo >= MIN_EXPONENT * p:
                    runs.append((lo, hi, p))
                # What else lies in the same run proposes it again.
                k = max(k + 1, bisect_left(places, hi - p))
        hashes, scale = wider, 2 * scale
    return runs


def _batch_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period) by start, then period."""
    numbers: dict[bytes, int] = defaultdict(count(len(texts)).__next__)
    # The numbers under len(texts) come once each and keep texts apart.
    ids = np.fromiter((x for k, words in enumerate(texts) for x in (*map(numbers.__getitem__, words), k)), np.int64, sum(map(len, texts)) + len(texts))
    starts = np.cumsum([0, *(len(w) + 1 for w in texts)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for lo, hi, p in find_runs(ids, max(map(len, texts), default=0)):
        if hi - lo >= MIN_LENGTH:
            k = int(np.searchsorted(starts, lo, "right")) - 1
            out[k].append((lo - int(starts[k]), hi - lo, p))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([w for w, g in zip(words, gone) if not g])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = _batch_runs(texts)
        runs = pa.array([[{"start": a, "length": b, "period": p} for a, b, p in r] for r in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
        kept = pa.array([_kept(w, r).decode() for w, r in zip(texts, found)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), runs, kept], names=["doc_id", "n_words", "runs", "collapsed"])

    for b in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            # bytes.split() cuts at the blanks of ASCII alone, which are those of the definition of words.
            words = t.as_buffer().to_pybytes().split() if t.is_valid else []
            if ids and size + len(words) > WORDS_AT_ONCE:
                yield answer(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(words)
            size += len(words) + 1
        if ids:
            yield answer(ids, texts)


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, runs and collapsed for every row.

    runs are all maximal runs of MIN_LENGTH words and MIN_EXPONENT periods at least, by start
    and period; collapsed is the text without the words that some run has after its first
    period, joined by one space. Words are what ASCII blanks separate, and equal if all their
    bytes are. Null and empty texts have no words and no runs. Rows are searched by
    themselves, so that repeated rows and rows without doc_id have their own results, an
    empty table gives no rows, and other columns are ignored, whatever their names. Texts are
    taken whole: a long one alone, in memory that grows with its words.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_searched, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def words_of(text: Column) -> Column:
    """The words of a text, cut at ASCII blanks."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def with_planted_periods(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and text of every row, where some documents' ends repeat one stretch of their words.

    With h the crc32 of the id as text and g its tenth, the words of a document with h % 10 = 0
    that has some repeat from word a = g % n on with a period of 1 + (n - a) div (3 + g % 8).
    Other texts, and those without id or words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # One projection after the other, so that a text is cut once and not again for each of its words.
    rows = rows.select("*", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("words"))
    rows = rows.select("*", F.when(F.size("words") > 0, F.size("words").cast("long")).alias("n"))
    rows = rows.select("*", (F.col("g") % F.col("n")).alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: the number of runs, the one of greatest exponent, and digests of the runs and the collapsed text.

    Exponents are compared as fractions; ties go to the smallest start, then the smallest
    period. Without runs the run's columns are null. Texts are rewritten by
    with_planted_periods() first; for nulls, repeated rows and so on see periodic_runs().
    """
    found = periodic_runs(with_planted_periods(docs, text, doc_id))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start and period, so that of equal ones the first stays.
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    spelt = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(spelt.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
