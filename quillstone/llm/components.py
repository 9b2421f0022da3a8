"""Connected components of an edge table, without gathering anything on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.columns import shuffled
from quillstone.shelf import Shelf

#: Edges that are contracted at once, and that one contracting task takes about.
EDGES_A_TASK = 250_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (u, v) that isn't the least one of its component, and that least one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return ids[tied], ids[root[tied]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, EDGES_A_TASK at a time, as ties to the least nodes that they lead to."""
    held: list[pa.RecordBatch] = []
    size = 0

    def told() -> pa.RecordBatch:
        u, v = forest(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= EDGES_A_TASK:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def _done(edges: DataFrame) -> bool:
    """Whether every node is tied to one other at most, and to one that itself is tied to none."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count_if(F.col("to").isNull()).alias("n_led"))
    return seen.agg(F.count_if((F.col("low") < F.col("high")) | (F.col("low").isNotNull() & (F.col("n_led") > 0)))).first()[0] == 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half step: each node's neighbours are tied to the least node among them and it.

    large ties those above the node, the other half those below it and the node itself.
    The least neighbour is aggregated before it is shuffled, and joined back by node.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        tied = both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        tied = both.join(shuffled(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.filter("u <> v").distinct()


def components(edges: DataFrame, shelf: Shelf, label: str) -> DataFrame:
    """node and component (its least node) for every node with an edge (u, v).

    Tasks contract some EDGES_A_TASK edges each, which leaves stars; the two half steps then
    alternate until every edge leads from a node to the least one of its component: a number of
    rounds that grows with the logarithm of the longest path, none where one task had all
    edges. Only counts come to the driver. Repeated edges, edges of a node with itself and
    either direction are the same; edges must have no nulls, and without edges there are no rows.
    """
    edges = shelf.put(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), f"{label}_edges")
    tasks = max(1, -(-edges.count() // EDGES_A_TASK))
    now, k = shelf.put(edges.coalesce(tasks).mapInArrow(_contracted, "u long, v long"), f"{label}_0"), 0
    shelf.drop(f"{label}_edges")
    while not _done(now):
        k += 1
        after = shelf.put(_star(_star(now, True), False), f"{label}_{k}")
        shelf.drop(f"{label}_{k - 1}")
        now = after
    # Tasks may have told the same tie.
    now = now.distinct() if tasks > 1 else now
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
