"""Packing token sequences into windows by non-negative least squares.

Every document is cut at multiples of the window; what is left of it is shorter than the
window. The lengths of these rests make one histogram, whose size is the window's and
not the corpus's. Combinations of up to three grid lengths, the first two repeated up to
eight times, that fill the window are enumerated, and non-negative least squares finds
how often each should be used so that together they use up the histogram. The counts are
rounded down, no more is taken than there is, and what remains is solved again, as long
as that places anything. The residue is packed greedily, longest first, still on the
histogram. Rows are only numbered within their length and looked up in the plan.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.forced_bpe import ForcedBoundaryEncoder, shared_encoder, shared_table, uncollected
from quillstone.shelf import Shelf

WINDOW, END_ID = 4096, 2
#: Lengths are rounded up to multiples of this for the least squares; how often a combination repeats a length.
GRID, TIMES = 8, (1, 2, 4, 8)
#: The least squares is solved anew on what is left at most so often.
ROUNDS = 12
#: Rows that one numbering task takes about.
ROWS_A_TASK = 50_000


def combinations(units: int, times: tuple[int, ...] = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """All a * x + b * y + z = units with lengths x < y, z and a, b among times: rows (x, y, z) and rows (a, b, 1), 0 where a part is missing."""
    parts, counts = [np.array([[0, 0, units]])], [np.array([[0, 0, 1]])]
    for a in times:
        x = np.arange(1, units // a + 1)
        z = units - a * x
        parts.append(np.stack([x, 0 * x, z], 1))
        counts.append(np.stack([0 * x + a, 0 * x, z > 0], 1))
        for b in times:
            x, y = np.meshgrid(np.arange(1, units // a + 1), np.arange(1, units // b + 1), indexing="ij")
            fits = (x < y) & (a * x + b * y <= units)
            x, y = x[fits], y[fits]
            z = units - a * x - b * y
            parts.append(np.stack([x, y, z], 1))
            counts.append(np.stack([0 * x + a, 0 * x + b, z > 0], 1))
    return np.concatenate(parts), np.concatenate(counts)


def nnls(parts: np.ndarray, counts: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative x that minimises the squared distance of the columns' sum from target.

    Column j has counts[j] in the rows parts[j] (row 0 is ignored). The active-set method:
    the column with the steepest gain enters, the least squares on the entered columns is
    solved, and columns that would turn negative leave.
    """
    n, m = len(parts), len(target)
    target = target.astype(float)
    target[0] = 0
    sides = [(np.ascontiguousarray(parts[:, k]), counts[:, k] / np.sqrt((counts**2).sum(1))) for k in range(parts.shape[1])]
    x, order = np.zeros(n), []
    most = min(n, m)  # no more columns are independent
    dense, gram = np.zeros((most, m)), np.zeros((most, most))  # the entered columns as rows, in order, and their products
    tolerance = 1e-9 * max(1.0, np.abs(target).max())
    for _ in range(rounds):
        k = len(order)
        rest = target - x[order] @ dense[:k]
        gain = sum(rest[p] * c for p, c in sides)
        gain[order] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance or k == most:
            break
        dense[k] = np.bincount(parts[j], weights=counts[j], minlength=m)
        dense[k, 0] = 0
        gram[k, : k + 1] = gram[: k + 1, k] = dense[: k + 1] @ dense[k]
        order.append(j)
        while order:
            k = len(order)
            z = np.linalg.solve(gram[:k, :k] + 1e-10 * np.eye(k), dense[:k] @ target)
            if z.min() > 0:
                x[order] = z
                break
            old, bad = x[order], z <= 0
            step = np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300))
            now = old + step * (z - old)
            keep = ~(bad & (now <= tolerance))
            if keep.all():
                keep[int(np.argmin(now))] = False
            x[order] = np.where(keep, np.maximum(now, 0), 0)
            stay = np.flatnonzero(keep)
            dense[: len(stay)] = dense[stay]
            gram[: len(stay), : len(stay)] = gram[np.ix_(stay, stay)]
            order = [order[i] for i in stay]
    return x


def solve(coarse: np.ndarray, units: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Combinations, as counts by grid length, with how often each is used, and what is left of the histogram."""
    parts, counts = combinations(units)
    left, chosen = coarse.astype(np.int64), []
    left[0] = 0
    for _ in range(ROUNDS):
        repeats = np.floor(nnls(parts, counts, left) + 1e-6).astype(np.int64)
        placed = 0
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] <= 0:
                break
            need = np.bincount(parts[j], weights=counts[j], minlength=len(left)).astype(np.int64)
            used = np.flatnonzero(need)
            used = used[used > 0]
            times = int(min(repeats[j], (left[used] // need[used]).min()))
            if times:
                left[used] -= need[used] * times
                chosen.append(({int(b): int(need[b]) for b in used}, times))
                placed += times
        if not placed:
            break
    return chosen, left


def plan(histogram: np.ndarray, window: int = WINDOW, grid: int = GRID) -> list[tuple[int, int, int, int, int, int]]:
    """Where the rests go: rows (length, first, count, sequence, span, shift).

    Of the rests of this length, the one with the number first + k, k under count, goes to
    the sequence sequence + (shift + k) % span. Sequences are numbered from 0. The plan has
    as many rows as the histogram and the window allow, however many documents there are.
    """
    units = window // grid
    bins = -(-np.arange(len(histogram)) // grid)
    chosen, _ = solve(np.bincount(bins, weights=histogram, minlength=units + 1), units)
    # Within a grid cell the longest rests are used first.
    supply = {b: [[int(length), 0, int(histogram[length])] for length in range(min(b * grid, len(histogram) - 1), (b - 1) * grid, -1) if histogram[length]] for b in range(1, units + 1)}
    rows, sequence = [], 0

    def take(b: int, count: int) -> Iterator[tuple[int, int, int]]:
        while count:
            cell = supply[b][0]
            n = min(count, cell[2])
            yield cell[0], cell[1], n
            cell[1] += n
            cell[2] -= n
            count -= n
            if not cell[2]:
                supply[b].pop(0)

    for combo, times in chosen:
        for b, each in combo.items():
            shift = 0
            for length, first, n in take(b, each * times):
                rows.append((length, first, n, sequence, times, shift % times))
                shift += n
        sequence += times
    # What remains, longest first; equal sequences are laid out together.
    rest = np.zeros(len(histogram), np.int64)
    used = np.zeros(len(histogram), np.int64)
    for cells in supply.values():
        for length, first, n in cells:
            rest[length], used[length] = n, first
    used[rest == 0] = 0
    while rest.any():
        room, pattern = window, []
        top = int(np.flatnonzero(rest)[-1])
        while room:
            fits = np.flatnonzero(rest[: min(room, top) + 1])
            if not len(fits):
                break
            length = int(fits[-1])
            n = int(min(rest[length], room // length))
            pattern.append((length, n))
            room -= n * length
            top = length - 1
        times = int(min(rest[length] // n for length, n in pattern))
        for length, n in pattern:
            rows.append((length, int(used[length]), n * times, sequence, times, 0))
            rest[length] -= n * times
            used[length] += n * times
        sequence += times
    return rows


def _packed(_: ForcedBoundaryEncoder, ids: tuple[int, ...]) -> bytes:
    """ids as little-endian numbers of 32 bits."""
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


TOKENISED = "doc_id long, doc_tokens long, crcs array<long>"


def tokenised(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token count, with the closing id, and the checksum of each piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, render = shared_encoder(path), shared_table(path, _packed).__getitem__
        end, width = end_id.to_bytes(4, "little"), 4 * window
        for b in batches:
            counts, crcs = [], []
            with uncollected():
                for value in b.column(1).to_pylist():
                    parts: list[bytes] = []
                    for words, special in encoder.pieces(value):
                        parts.extend(map(render, words))
                        if special is not None:
                            parts.append(special.to_bytes(4, "little"))
                    parts.append(end)
                    raw = memoryview(b"".join(parts))
                    counts.append(len(raw) // 4)
                    crcs.append([zlib.crc32(raw[i : i + width]) for i in range(0, len(raw), width)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, TOKENISED)


def pack(docs: DataFrame, path: str, window: int = WINDOW, grid: int = GRID, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece, and padding of its sequence.

    Documents are cut only at multiples of the window, so that all but a document's last
    piece fill a sequence of their own. Padding reaches up to the window; a sequence whose
    filling is a power of two needs none, and its padding is 0. A null text counts as empty,
    and an empty text is one piece with the closing id alone. Null and repeated doc_ids take
    pieces of their own each, texts of any length are cut whole, an empty table gives no
    rows and other columns are ignored.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "pack")
    # The written table pins the row numbers, which deal repeated rows out as well.
    rows = shelf.put(tokenised(docs, path, window, end_id, text, doc_id).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = rows.count()
    salts = max(1, total // ROWS_A_TASK)
    rests = rows.withColumn("rest", (F.col("doc_tokens") % window).cast("int")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = rests.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("doc_tokens") / window).cast("long")).alias("whole"))
    counts = shelf.put(counts, "counts")
    # At most one row for each length of the window.
    histogram = np.zeros(window, np.int64)
    for r in counts.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"]
    placed = plan(histogram, window, grid)
    sequences = max((at + span for _, _, _, at, span, _ in placed), default=0)

    # Numbers within a length, and of whole windows over all rows: by length and salt, each task on its own, then shifted.
    order = Window.partitionBy("rest", "salt").orderBy("row")
    upto = Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(upto.partitionBy("rest")), F.lit(0)))
        .withColumn("salt_whole", F.sum("whole").over(Window.partitionBy("salt")))
        .withColumn("whole_in_salt", F.coalesce(F.sum("whole").over(Window.partitionBy("salt").orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    # One row for each salt: as many as there are tasks.
    by_salt = counts.groupBy("salt").agg(F.sum("whole").alias("w")).select("salt", F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("whole_before_salt"))
    shifts = shifts.join(F.broadcast(by_salt), "salt").select("rest", "salt", "before", (F.col("whole_before_salt") + F.col("whole_in_salt")).alias("whole_before"))
    wholes = F.floor(F.col("doc_tokens") / window).cast("long")
    numbered = (
        rests.join(shifts, ["rest", "salt"])
        .withColumn("number", F.col("before") + F.row_number().over(order) - 1)
        .withColumn("whole_at", F.col("whole_before") + F.coalesce(F.sum(wholes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    numbered = shelf.put(numbered, "numbered")

    full = numbered.filter(F.col("doc_tokens") >= window).select("doc_id", "doc_tokens", "whole_at", F.posexplode(F.slice("crcs", 1, F.greatest(F.floor(F.col("doc_tokens") / window).cast("int"), F.lit(1)))).alias("k", "ids_crc32"))
    full = full.select(
        "doc_id",
        (F.col("k").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("whole_at") + F.col("k") + sequences).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(0).cast("long").alias("padding"),
    )
    # The plan's size depends on the window alone.
    slots = F.broadcast(spark.createDataFrame(placed or [(0, 0, 0, 0, 1, 0)], "rest int, first long, n long, sequence long, span long, shift long"))
    last = numbered.filter("rest > 0").join(slots, "rest").filter("number >= first and number < first + n")
    last = last.select(
        "doc_id",
        (F.col("doc_tokens") - F.col("rest")).alias("start"),
        F.col("rest").cast("long").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + (F.col("shift") + F.col("number") - F.col("first")) % F.col("span")).alias("sequence_id"),
    )
    # A sequence holds at most as many pieces as the window has tokens.
    inside = Window.partitionBy("sequence_id")
    last = last.withColumn("offset", F.coalesce(F.sum("length").over(inside.orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    filled = F.sum("length").over(inside)
    last = last.withColumn("padding", F.when(filled.bitwiseAND(filled - 1) == 0, 0).otherwise(window - filled))
    return full.unionByName(last)
