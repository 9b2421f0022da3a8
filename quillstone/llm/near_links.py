"""From keys that candidates share to exact components of links, in work that grows with a cluster's size.

Rows that share a key are tied to the key's first row; ties make clusters, and every link is
inside a cluster. A small cluster is searched in one task. A large one is cut into chunks:
each chunk is searched by itself and sends on one representative of each component it found,
and representatives are searched the same way until one chunk of them is left. What all this
leaves in more than one component is decided by its members: rows outside the cluster's
largest component are held against all others of the cluster, so that no link is lost.

The sets of a large cluster are sent once, those of representatives once more. Only rows
outside the largest component are sent to every chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.columns import shuffled
from quillstone.llm.components import components, forest
from quillstone.llm.shingles import shingle_sets
from quillstone.llm.worker import release
from quillstone.shelf import Shelf

#: linked(nodes, sets, marks): for each node the least node that links lead to; marks are the rows' own binary values.
Linker = Callable[[np.ndarray, list[np.ndarray], list], np.ndarray]
#: pairs(components, is_rest, sets, marks): pairs of components that a link between a row with is_rest and another one joins.
Pairs = Callable[[np.ndarray, np.ndarray, list[np.ndarray], list], list[tuple[int, int]]]
#: Keys that one task of the bucket stage sorts, about.
KEYS_A_TASK = 250_000
#: Texts that are hashed, and nodes whose keys are made, at once.
TEXTS_AT_ONCE, NODES_AT_ONCE = 500, 2500
_RECORD = np.dtype([("key", "<u8"), ("node", "<i8")])


def stretches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ties_in_buckets(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that tie each member of a bucket to its first one, and the order that keeps buckets together."""
    order = np.lexsort((nodes, keys))
    k, v = keys[order], nodes[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    head = np.repeat(first, np.diff(np.append(first, len(k))))
    apart = v[head] != v
    low, high = v[head][apart], v[apart]
    pairs = np.unique(np.stack([low, high]), axis=1) if len(low) else np.zeros((2, 0), np.int64)
    return pairs, order


def ties(rows: DataFrame, keyed: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, at_once: int, shelf: Shelf) -> DataFrame:
    """Pairs (u, v) of nodes that tie the members of every bucket; keyed gives the nodes of some rows, all their keys, and how many each has."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ties within a stretch of nodes, as bucket -1; of each bucket, the first member goes on."""
        for b in stretches(batches, at_once):
            node, keys, counts = keyed(b)
            if not len(node):
                continue
            node = np.repeat(node, counts)
            pairs, order = ties_in_buckets(keys, node)
            records = np.empty(len(order), _RECORD)
            records["key"], records["node"] = keys[order], node[order]
            lead = np.ones(len(records), bool)
            lead[1:] = records["key"][1:] != records["key"][:-1]
            sent = records[lead]
            where = (sent["key"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            sent, where = sent[order], where[order]
            cut = np.searchsorted(where, np.arange(buckets + 1))
            out = [(-1, pairs.T.astype("<i8").tobytes())] if pairs.shape[1] else []
            out += [(i, sent[x:y].tobytes()) for i, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([r for _, r in out], pa.binary())], names=["bucket", "records"])

    def joined(table: pa.Table) -> pa.Table:
        records = np.frombuffer(b"".join(table.column("records").to_pylist()), _RECORD)
        pairs, _ = ties_in_buckets(records["key"].copy(), records["node"].copy())
        u, v = forest(*pairs)
        return pa.table({"u": u, "v": v})

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    sent = shelf.put(rows.mapInArrow(local, "bucket int, records binary"), "sent")
    across = sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(joined, "u long, v long")
    return across.unionByName(sent.filter("bucket < 0").select("records").mapInArrow(spelt, "u long, v long"))


def _mark(members: bytes) -> bytes:
    return hashlib.blake2b(members, digest_size=16).digest()


def _members(ids: DataFrame, docs: DataFrame, width: int, broadcast_ids: int) -> DataFrame:
    """first, mark and full set of the rows of docs whose doc_id is among ids (first)."""
    few = ids.count() <= broadcast_ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stretches(batches, TEXTS_AT_ONCE):
            found = [s.tobytes() for s in shingle_sets(b.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_mark(x) for x in found], pa.binary()), pa.array(found, pa.binary())], names=["first", "mark", "members"])

    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else shuffled(ids), docs["doc_id"] == ids["first"], "left_semi")
    return texts.mapInArrow(sets, "first long, mark binary, members binary")


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members")]


def _chunks(n: Column, shingles: Column, nodes: int, most: int) -> Column:
    """How many chunks a cluster of n sets takes: one up to twice the size of a chunk."""
    alone = (n <= 2 * nodes) & (shingles <= 2 * most)
    return F.when(alone, F.lit(1)).otherwise(F.greatest(F.ceil(n / nodes), F.ceil(shingles / most)).cast("int"))


_FOUND = "cluster long, node long, component long, k int, members binary, extra binary"


def _searcher(linked: Linker) -> Callable[[pa.Table], pa.Table]:
    def search(table: pa.Table) -> pa.Table:
        """The component of each row of a chunk; of a cluster that is cut, the set of each component's least node."""
        nodes = table.column("node").to_numpy()
        extra = table.column("extra").to_pylist()
        found = linked(nodes, _sets(table), extra)
        keep = (nodes == found) & (table.column("k").to_numpy() > 1)
        sent = [x if y else None for x, y in zip(table.column("members").to_pylist(), keep)]
        return pa.table(
            {
                "cluster": table.column("cluster"),
                "node": nodes,
                "component": found,
                "k": table.column("k"),
                "members": pa.array(sent, pa.binary()),
                "extra": pa.array([x if y else None for x, y in zip(extra, keep)], pa.binary()),
            }
        )

    return search


def _searched(rows: DataFrame, linked: Linker, nodes: int, shingles: int, shelf: Shelf, label: str, salt: int) -> DataFrame:
    """rows (cluster, node, size, members, extra) searched chunk by chunk."""
    # Sums are written before they are joined back, so that the rows of a hot cluster are split there.
    sized = shelf.put(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")), f"{label}_sized")
    sized = sized.select("cluster", _chunks(F.col("n"), F.col("s"), nodes, shingles).alias("k"))
    cut = rows.join(shuffled(sized), "cluster").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("k").cast("long")).cast("int"))
    return shelf.put(cut.groupBy("cluster", "chunk").applyInArrow(_searcher(linked), _FOUND), label)


def _across(pairs: Pairs) -> Callable[[pa.Table], pa.Table]:
    def search(table: pa.Table) -> pa.Table:
        rest = table.column("is_rest").to_numpy(zero_copy_only=False)
        found = pairs(table.column("component").to_numpy(), rest, _sets(table), table.column("extra").to_pylist())
        u, v = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
        return pa.table({"u": u, "v": v})

    return search


def resolve(placed: DataFrame, sets: Callable[[DataFrame], DataFrame], linked: Linker, pairs: Pairs, nodes: int, shingles: int, shelf: Shelf) -> DataFrame:
    """node and component (its least node) for every node of placed that a link ties to a smaller one.

    placed (cluster, node, size, extra, and what sets reads) are the rows of all clusters;
    sets() puts members, the full set, beside its rows. linked(nodes, sets, extra) searches a
    chunk; pairs(components, is_rest, sets, extra) gives the pairs of components that some link
    between a row with is_rest and another one joins. The bounds of a chunk decide about cost
    alone: the components are those of all links.
    """
    found = _searched(sets(placed).select("cluster", "node", "size", "members", "extra"), linked, nodes, shingles, shelf, "found", 0)
    whole = found.filter("k = 1 and node <> component").select("node", "component")
    cut = found.filter("k > 1")
    links = [cut.select(F.col("node").alias("u"), F.col("component").alias("v"))]
    heads = cut.filter("members is not null").withColumn("size", F.expr("octet_length(members) div 8")).select("cluster", "node", "size", "members", "extra")
    count, level = heads.count(), 0
    if not count:
        return whole
    while True:
        level += 1
        after = _searched(heads, linked, nodes, shingles, shelf, f"heads_{level}", level)
        links.append(after.select(F.col("node").alias("u"), F.col("component").alias("v")))
        heads = after.filter("k > 1 and members is not null").withColumn("size", F.expr("octet_length(members) div 8")).select("cluster", "node", "size", "members", "extra")
        left = heads.count()
        # No representatives left: each cluster's last ones met in one chunk. Or they hardly get fewer.
        if 2 * left > count or not left:
            break
        count = left
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    joined = components(every, shelf, "joined")
    labelled = cut.select("cluster", "node").join(shuffled(joined), "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("component"))
    labelled = shelf.put(labelled, "labelled")
    final = labelled.select("node", "component")
    open_ = _open(labelled, nodes, shelf)
    if not open_.isEmpty():
        between = shelf.put(_between(placed, sets, labelled, open_, pairs, nodes), "between")
        merged = components(between, shelf, "merged").withColumnRenamed("node", "c").withColumnRenamed("component", "least")
        final = final.join(shuffled(merged), F.col("component") == F.col("c"), "left").select("node", F.coalesce("least", "component").alias("component"))
    return whole.unionByName(final.filter("node <> component"))


def _open(labelled: DataFrame, nodes: int, shelf: Shelf) -> DataFrame:
    """cluster, its largest component, and the numbers of chunks of its rows and of those outside that component; clusters of several components only."""
    sizes = shelf.put(labelled.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return largest.filter("most < n").select("cluster", "largest", F.ceil(F.col("n") / nodes).cast("int").alias("k_all"), F.ceil((F.col("n") - F.col("most")) / nodes).cast("int").alias("k_rest"))


def _between(placed: DataFrame, sets: Callable[[DataFrame], DataFrame], labelled: DataFrame, open_: DataFrame, pairs: Pairs, nodes: int) -> DataFrame:
    """Pairs (u, v) of components that a link between their members joins."""
    rows = labelled.join(shuffled(open_), "cluster").withColumn("is_rest", F.col("component") != F.col("largest"))
    own_all, own_rest = (F.pmod(F.xxhash64("node", F.lit(s)), F.col(k).cast("long")).cast("int") for s, k in ((-1, "k_all"), (-2, "k_rest")))
    upto = lambda k, f: F.transform(F.sequence(F.lit(0), F.col(k) - 1), f)
    place = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    # A row outside the largest component goes to every chunk, any row to every chunk of those.
    as_all = upto("k_rest", lambda i: place(i, own_all, False))
    as_rest = F.when(F.col("is_rest"), upto("k_all", lambda j: place(own_rest, j, True))).otherwise(F.array().cast("array<struct<i:int,j:int,role:boolean>>"))
    rows = rows.withColumn("places", F.concat(as_all, as_rest)).select("node", "component", "places")
    full = sets(placed.join(shuffled(rows), "node"))
    sent = full.withColumn("at", F.explode("places")).select("cluster", "at.i", "at.j", F.col("at.role").alias("is_rest"), "component", "members", "extra")
    return sent.groupBy("cluster", "i", "j").applyInArrow(_across(pairs), "u long, v long").distinct()


@dataclass(frozen=True)
class Search:
    """How a kind of link is searched for: words of a shingle, the keys of candidates, and the two searches of resolve()."""

    width: int
    #: For some non-empty sets what their keys are made from, and the keys themselves: all of them, and how many a row has.
    keyed: Callable[[list[np.ndarray]], list[bytes]]
    keys_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    #: Keys of a row, about: decides on the number of buckets.
    keys_each: int
    linked: Linker
    pairs: Pairs
    #: Whether the searches read what keys are made from. If not, that isn't kept: keys come from the texts again.
    reads_keys: bool


def _code(mark: bytes) -> int:
    return int.from_bytes(mark[:7], "big")


def _keyed_texts(search: Search) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    def keyed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a batch of texts the codes of their sets, and the keys."""
        nodes, keys, counts, held, size = [], [], [], [], 0

        def told() -> None:
            more, each = search.keys_of(search.keyed(held))
            nodes.extend(_code(_mark(s.tobytes())) for s in held)
            keys.append(more)
            counts.append(each)

        for s in shingle_sets(b.column(0).to_pylist(), search.width):
            if len(s):
                held.append(s)
                size += len(s)
            if size > 100_000:
                told()
                held, size = [], 0
        if held:
            told()
        none = np.zeros(0, np.int64)
        return np.array(nodes, np.int64), np.concatenate(keys) if keys else none, np.concatenate(counts) if counts else none

    return keyed


def _keyed_nodes(search: Search) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return lambda b: (b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *search.keys_of(b.column(1).to_pylist()))


def _signer(search: Search) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def described(sets: list[np.ndarray]) -> tuple[list[int], list, list]:
        full = [i for i, s in enumerate(sets) if len(s)]
        marks, keys = [None] * len(sets), [None] * len(sets)
        if full:
            made = search.keyed([sets[i] for i in full]) if search.reads_keys else [None] * len(full)
            for i, k in zip(full, made):
                marks[i], keys[i] = _mark(sets[i].tobytes()), k
        return [len(s) for s in sets], marks, keys

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in stretches(batches, TEXTS_AT_ONCE):
            counts, marks, keys, held, size = [], [], [], [], 0
            for s in shingle_sets(b.column(2).to_pylist(), search.width):
                held.append(s)
                size += len(s)
                if size > 100_000:
                    for out, new in zip((counts, marks, keys), described(held)):
                        out.extend(new)
                    held, size = [], 0
            for out, new in zip((counts, marks, keys), described(held)):
                out.extend(new)
            columns = [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sha", "n_shingles", "mark", "keys"])

    return signed


def linked_rows(docs: DataFrame, text: str, doc_id: str, search: Search, label: str, nodes: int, shingles: int, broadcast_ids: int) -> DataFrame:
    """doc_id, sha (the digest of the text), n_shingles, component_id and kept for every row of docs.

    A component is what links tie together; its id is the smallest doc_id in it. Texts
    without shingles and rows without doc_id link with nothing; a null doc_id has a null
    component_id and is kept.
    """
    shelf = Shelf(docs.sparkSession, label)
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(whole, 256)).alias("sha"), whole.alias("text"))
    signed = shelf.put(rows.mapInArrow(_signer(search), "doc_id long, sha binary, n_shingles long, mark binary, keys binary"), "signed")
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    # Equal sets are one node, whose row is that of the smallest doc_id. The written table pins the numbers.
    classes = shelf.put(linked.groupBy("mark").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "classes")
    firsts = linked.join(shuffled(classes), "mark").filter("doc_id = first").groupBy("node", "first", "mark")
    distinct = firsts.agg(F.max(F.struct("n_shingles", "keys")).alias("s"), F.count(F.lit(1)).alias("n")).select("node", "first", "mark", "s.n_shingles", "s.keys", "n")
    distinct = shelf.put(distinct, "nodes")
    count, repeats = distinct.agg(F.count(F.lit(1)), F.max("n")).first()
    buckets = max(1, count * search.keys_each // KEYS_A_TASK)
    if search.reads_keys:
        code, tied = F.col("node"), ties(distinct.select("node", "keys"), _keyed_nodes(search), buckets, NODES_AT_ONCE, shelf)
    else:
        # Codes stand for sets until clusters are known. If two sets had one code, they would share a cluster and no more.
        code, tied = F.expr("cast(conv(hex(substring(mark, 1, 7)), 16, 10) AS bigint)"), ties(rows.filter("doc_id is not null").select("text"), _keyed_texts(search), buckets, TEXTS_AT_ONCE, shelf)
    clusters = components(tied, shelf, "clusters").select(F.col("node").alias("code"), F.col("component").alias("cluster"))
    placed = clusters.join(shuffled(distinct.withColumn("code", code)), "code").select("cluster", "node", F.col("n_shingles").alias("size"), "first", "mark", F.col("keys").alias("extra"))
    placed = shelf.put(placed, "placed")
    shelf.drop("sent", "nodes")

    def sets(of: DataFrame) -> DataFrame:
        found = _members(of.select("first").distinct(), rows, search.width, broadcast_ids)
        if repeats is not None and repeats > 1:
            found = found.dropDuplicates(["first", "mark"])
        return found.join(shuffled(of), ["first", "mark"])

    joined = resolve(placed, sets, search.linked, search.pairs, nodes, shingles, shelf)
    grouped = classes.join(shuffled(joined), "node", "left").select("mark", "first", F.coalesce("component", "node").alias("component"))
    grouped = shelf.put(grouped, "grouped")
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    out = signed.select("doc_id", "sha", "n_shingles", "mark").join(shuffled(grouped.join(shuffled(least), "component").select("mark", "component_id")), "mark", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "sha", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out = shelf.put(out, "result")
    shelf.keep("result")
    return out
