"""Near-duplicate detection with tensored MinHash tables.

Two small collections of MinHash blocks are computed for each distinct shingle set, and
a table's key joins one block of either: 8 and 8 blocks of 2 make 64 tables of 4 from 32
MinHashes, where plain banding would take 256. Sets that meet in a table are candidates,
and candidates are confirmed on the full sets of 64-bit shingle hashes.

A table never lists all pairs of a bucket: ties, clusters and the search of a large cluster
by chunks and representatives are those of near_links. Which pairs count is the same at any
size of cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quillstone.llm.near_links import Search, linked_rows
from quillstone.llm.shingles import WIDTH, mix

#: Blocks of each collection, MinHashes of a block.
BLOCKS, DEPTH = 8, 2
#: Similarity of a link, in percent, unless a caller asks for another.
PERCENT = 85
#: Sets of a chunk of a cluster, and shingles in them, about; clusters of up to twice as much are one chunk.
CHUNK_NODES, CHUNK_SHINGLES = 256, 1 << 18
#: So many ids are broadcast at most (some 40 bytes each in memory); more are joined by shuffle.
BROADCAST_IDS = 250_000
_HASHES = 2 * BLOCKS * DEPTH
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(1, 2**63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, _HASHES, dtype=np.uint64)


def block_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set a row with the hashes of its 2 * BLOCKS blocks of MinHashes."""
    sizes = np.array([len(s) for s in sets])
    at, values = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate(sets)
    out = np.zeros((len(sets), 2 * BLOCKS), np.uint64)
    for k in range(_HASHES):
        out[:, k // DEPTH] = mix(out[:, k // DEPTH] * np.uint64(31) + np.minimum.reduceat((values * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32), at) + np.uint64(1))
    return out


def table_keys(blocks: np.ndarray) -> np.ndarray:
    """The keys of all tables for rows of block hashes: one block of either collection each."""
    left, right = blocks[:, :BLOCKS, None], blocks[:, None, BLOCKS:]
    tables = np.arange(BLOCKS * BLOCKS, dtype=np.uint64).reshape(BLOCKS, BLOCKS)
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right + tables)).reshape(len(blocks), -1)


def _keys_of(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys = table_keys(_blocks(blocks))
    return keys.reshape(-1), np.full(len(blocks), keys.shape[1])


def _blocks(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def linked_components(nodes: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each node the least node that links lead to, all links between sets that meet in a table counted."""
    sizes = np.array([len(s) for s in sets])
    tokens_of = np.concatenate(sets)
    order = np.argsort(tokens_of, kind="stable")
    ids = np.empty(len(order), np.int32)
    ordered = tokens_of[order]
    ids[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]), dtype=np.int32)
    del tokens_of, ordered, order
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, bool)
    first, second = blocks[:, :BLOCKS], blocks[:, BLOCKS:]
    found = nodes.copy()
    left = np.argsort(nodes, kind="stable")
    while len(left):
        root, frontier, left = nodes[left[0]], [left[0]], left[1:]
        tokens, offsets = None, None
        while frontier and len(left):
            x = frontier.pop()
            if tokens is None:
                tokens = np.concatenate([ids[starts[y] : starts[y] + sizes[y]] for y in left])
                offsets = np.cumsum(sizes[left]) - sizes[left]
            meets = (first[left] == first[x]).any(1) & (second[left] == second[x]).any(1)
            if not meets.any():
                continue
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            common = np.add.reduceat(mark[tokens], offsets, dtype=np.int64)
            mark[own] = False
            near = meets & (100 * common >= percent * (sizes[left] + sizes[x] - common))
            if near.any():
                found[left[near]] = root
                frontier.extend(left[near])
                left, tokens = left[~near], None
    return found


def linked_across(components: np.ndarray, is_rest: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of components joined by a link between a row with is_rest and a row without, of sets that meet in a table."""
    others = np.flatnonzero(~is_rest)
    if not len(others):
        return []
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(ids.max()) + 1, bool)
    first, second = blocks[:, :BLOCKS], blocks[:, BLOCKS:]
    tokens = np.concatenate([ids[starts[y] : starts[y] + sizes[y]] for y in others])
    offsets = np.cumsum(sizes[others]) - sizes[others]
    found = set()
    for x in np.flatnonzero(is_rest):
        meets = (components[others] != components[x]) & (first[others] == first[x]).any(1) & (second[others] == second[x]).any(1)
        if meets.any():
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = True
            common = np.add.reduceat(mark[tokens], offsets, dtype=np.int64)
            mark[own] = False
            near = meets & (100 * common >= percent * (sizes[others] + sizes[x] - common))
            found.update((int(components[x]), int(c)) for c in np.unique(components[others[near]]))
    return list(found)


def _search(percent: int) -> Search:
    return Search(
        width=WIDTH,
        keyed=lambda sets: [row.tobytes() for row in block_hashes(sets)],
        keys_of=_keys_of,
        keys_each=BLOCKS * BLOCKS,
        linked=lambda nodes, sets, extra: linked_components(nodes, sets, _blocks(extra), percent),
        pairs=lambda components, is_rest, sets, extra: linked_across(components, is_rest, sets, _blocks(extra), percent),
        reads_keys=True,
    )


def near_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """What near_duplicates gives, and sha, the digest of the row's text."""
    return linked_rows(docs, text, doc_id, _search(percent), "near", CHUNK_NODES, CHUNK_SHINGLES, BROADCAST_IDS)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; a Jaccard similarity of percent or more is a link.

    Texts without words, null texts included, have no shingles and link with nothing, and
    so does a row with a null doc_id: its component_id is null, and it is kept. Ties go to
    the smallest doc_id. Links are between texts: rows that repeat a doc_id with another
    text have a component each, and repeated rows have the same one. Texts of any length
    are taken whole. An empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    return near_rows(docs, text, doc_id, percent).drop("sha")
