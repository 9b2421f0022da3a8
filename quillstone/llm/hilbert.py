"""Sharding along a Hilbert curve.

Several metadata columns are quantised to a few bits each, the cells are numbered along
a Hilbert curve, rows are sorted by that number, and the sorted run is cut into shards.
Neighbours on the curve are neighbours in every dimension, so each shard covers a small
box and a reader can skip shards by the minimum and maximum of any of the dimensions.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.shelf import Shelf

BITS = 7
SHARDS = 24
#: So many strings of a dimension are broadcast with their cells at most; more are joined by shuffle.
BROADCAST_VALUES = 250_000


@lru_cache
def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """Step and next state by state * 2**dims + cell, for the Hilbert curve in that many dimensions.

    A state is an entry corner and a direction. The cell of the corner grid, turned back
    by both, is a Gray code whose rank is the step; the step's own entry and direction
    then lead to the next state.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    rank = {gray(i): i for i in range(size)}

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    def direction(i: int) -> int:
        return 0 if i == 0 else (ones(i - 1) if i % 2 == 0 else ones(i)) % dims

    steps, follow = [], []
    for state in range(size * dims):
        corner, way = divmod(state, dims)
        for cell in range(size):
            step = rank[turn(cell ^ corner, -(way + 1))]
            steps.append(step)
            follow.append((corner ^ turn(entry(step), way + 1)) * dims + (way + direction(step) + 1) % dims)
    return steps, follow


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of a cell whose coordinates have so many bits each."""
    dims = len(cells)
    steps, follow = (F.array(*map(F.lit, x)) for x in curve_table(dims))
    planes = F.array(*(sum(((F.shiftright(c, b).bitwiseAND(1)) * (1 << d) for d, c in enumerate(cells)), F.lit(0)) for b in reversed(range(bits))))

    def walk(at: Column, plane: Column) -> Column:
        key = at["state"] * (1 << dims) + plane
        return F.struct(F.get(follow, key).alias("state"), (F.shiftleft(at["place"], dims) + F.get(steps, key)).alias("place"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("place"))
    return F.aggregate(planes, start, walk, lambda at: at["place"])


def name_cells(docs: DataFrame, column: str, shelf: Shelf, bits: int = BITS) -> DataFrame:
    """The distinct strings of a column and their cells, which follow the strings' order; as many strings share a cell as have to.

    The written table pins the cells: a recomputed range partitioning could choose others.
    """
    values = docs.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct()
    ranged = shelf.put(values.repartitionByRange(1 << bits, column).withColumn("part", F.spark_partition_id()), f"values_{column}")
    parts = (ranged.agg(F.max("part")).first()[0] or 0) + 1
    return ranged.select(column, F.floor(F.col("part") * (1 << bits) / parts).cast("int").alias(f"cell_{column}"))


def by_size(c: Column, bits: int = BITS) -> Column:
    """A size's cell: quarters of powers of two, which need no look at the other rows."""
    return F.least(F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) * 4), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the cells for every row.

    The cells of dims follow the order of the strings, those of sizes their logarithm.

    Rows are sorted by place on the curve, then by text checksums, then by doc_id, so that
    equal texts of one place stand together. The run is cut where the running sum of sizes
    passes a multiple of total / shards: a shard's bytes differ from the mean by less than
    the largest row. A null text has size 8 and checksum 0, null dimensions cell 0, a null
    doc_id comes first; repeated rows take a slot each. Fewer rows than shards leave shards empty,
    an empty table gives no rows, texts of any length count whole and other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "hilbert")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(whole) + 8).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("mark"),
        *(F.col(d).cast("string").alias(d) for d in dims),
    ).withColumn("cell_size", by_size(F.col("size")))
    for d in dims:
        cells_of = name_cells(docs, d, shelf)
        few = cells_of.count() <= BROADCAST_VALUES
        rows = rows.join(F.broadcast(cells_of) if few else cells_of, d, "left").withColumn(f"cell_{d}", F.coalesce(f"cell_{d}", F.lit(0))).drop(d)
    cells = [*(f"cell_{d}" for d in dims), "cell_size"]
    order = ["curve", "text_crc32", "mark", "doc_id"]
    # The written table pins which task holds which stretch of the run.
    run = shelf.put(
        rows.withColumn("curve", curve_index([F.col(c) for c in cells])).repartitionByRange(*order).withColumn("stretch", F.spark_partition_id()), "run"
    )
    # One row for each stretch, as many as there are shuffle partitions, however large the input.
    sums = run.groupBy("stretch").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    starts = sums.select(
        "stretch",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("stretch").orderBy(*order)
    placed = (
        run.join(F.broadcast(starts), "stretch")
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside))
        .withColumn("upto", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        # whole numbers only: the row's middle byte, times shards, over the total
        .withColumn("shard", F.expr(f"cast((2 * upto - size) * cast({shards} as decimal(10, 0)) div (2 * total) as int)"))
    )
    placed = shelf.put(placed.select("doc_id", "size", "text_crc32", "shard", "place", "curve", *cells), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        *cells,
    )


def zone_map(placed: DataFrame, cells: list[str]) -> DataFrame:
    """Least and greatest cell of each dimension by shard: what a reader prunes files with."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{n}_{c}") for c in cells for n, f in (("min", F.min), ("max", F.max))))


def shards_for(zones: DataFrame, cell: str, low: int, high: int) -> DataFrame:
    """The shards that can hold rows whose cell lies between low and high."""
    return zones.filter((F.col(f"max_{cell}") >= low) & (F.col(f"min_{cell}") <= high)).select("shard")
