"""Exact Jaccard join of shingle sets with a token-group matrix.

Similar sets are put into groups, and a group's row of the matrix is the union of its sets'
tokens. What a query shares with a group's row bounds what it shares with any of its sets:
only groups whose bound reaches the similarity asked for are opened, set by set.

Which rows of the matrix a query is held against is found without looking at all of them.
Two sets that are similar enough differ in no more than d tokens, d given by their sizes.
Tokens are dealt to d + 1 parts by a hash, so that the sets agree on one whole part at
least; its tokens' sum is a key that both have. Parts of fewer than two tokens say little:
a set with such a part goes by a second deal as well, and so on, and only the last deal
takes every part. Two similar sets agree either on a part that counts or on one that sends
both on to the next deal, so that no pair is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from quillstone.llm.near_links import Search, linked_rows
from quillstone.llm.shingles import mix

#: Words of a shingle, similarity of a link in percent.
WIDTH, PERCENT = 3, 90
#: Sets of a group at most.
GROUP_SETS = 16
#: Tokens of a part that counts, deals.
PART_TOKENS, DEALS = 2, 8
#: Sets of a chunk of a cluster, and tokens in them, about; clusters of up to twice as much are one chunk.
CHUNK_NODES, CHUNK_SHINGLES = 256, 1 << 18
#: So many ids are broadcast at most (some 40 bytes each in memory); more are joined by shuffle.
BROADCAST_IDS = 250_000
_RNG = np.random.default_rng(13)
_SALT = _RNG.integers(1, 2**63, DEALS, dtype=np.uint64)
_MULTIPLY = _RNG.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEVEL, _PART, _DEAL = (_RNG.integers(1, 2**63, dtype=np.uint64) | np.uint64(1) for _ in range(3))


@lru_cache(maxsize=64)
def size_classes(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The least size of each class up to that of upto and two more, and the parts of each class's deals.

    Sets that are similar enough are of one class or of two next to each other. A class's
    deals are those of its sets and of the class below it.
    """
    least = [1]
    while len(least) < 4 or least[-3] <= upto:
        least.append(max(least[-1] + 1, 100 * (least[-1] - 1) // percent + 1))
    bounds = np.array(least, np.int64)
    differ = 2 * (bounds[1:] - 1) * (100 - percent) // (100 + percent)
    return bounds[:-1], differ + 1


def part_keys(sets: list[np.ndarray], percent: int = PERCENT) -> list[bytes]:
    """For each non-empty set the keys of its parts, that of its own size class and of the next one."""
    sizes = np.array([len(s) for s in sets])
    bounds, parts = size_classes(percent, 1 << max(6, int(sizes.max()).bit_length()))
    tokens, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    spread = mix(tokens + _PART)
    owners, keys = [], []
    for above in (0, 1):
        level = np.searchsorted(bounds, sizes, "right") - 1 + above
        number = parts[level]
        left = number > 1  # equal sets are one already
        for deal in range(DEALS):
            if not left.any():
                break
            among = left[own]
            of = own[among]
            start = np.cumsum(np.where(left, number, 0)) - np.where(left, number, 0)
            part = ((mix(tokens[among] ^ _SALT[deal]) >> np.uint64(32)) * number[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            slot, total = start[of] + part, np.where(left, number, 0)
            sums = np.zeros(int(total.sum()), np.uint64)
            np.add.at(sums, slot, spread[among])
            counts = np.bincount(slot, minlength=len(sums))
            whose = np.repeat(np.arange(len(sets)), total)
            name = level[whose].astype(np.uint64) * _LEVEL + (np.arange(len(sums)) - start[whose]).astype(np.uint64) * _PART + np.uint64(deal) * _DEAL
            key, full = mix(sums ^ mix(name)), counts >= PART_TOKENS
            told = full | (deal == DEALS - 1)
            owners.append(whose[told])
            keys.append(key[told])
            left = np.zeros(len(sets), bool)
            left[whose[~full]] = True
    if not owners:
        return [b""] * len(sets)
    whose, key = np.concatenate(owners), np.concatenate(keys)
    key = key[np.argsort(whose, kind="stable")]
    cut = np.cumsum([0, *np.bincount(whose, minlength=len(sets))])
    return [key[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def _keys_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.uint64), np.array([len(r) // 8 for r in rows], np.int64)


class TokenGroups:
    """Groups of similar sets with the union of each group's tokens."""

    def __init__(self, sets: list[np.ndarray], grouped: np.ndarray, percent: int):
        """sets are those of queries and of members; grouped says which ones are members of groups."""
        self.sizes, self.percent = np.array([len(s) for s in sets]), percent
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(int(self.ids.max()) + 1, bool)
        values = np.concatenate(sets)
        low = [np.minimum.reduceat(mix(values * m), self.starts)[grouped] for m in _MULTIPLY]
        order = np.lexsort((low[1], low[0]))
        #: Members, similar ones next to each other, and the first of each group: where the first MinHash changes, or so many are reached.
        self.members = grouped[order]
        new = np.concatenate([[True], low[0][order][1:] != low[0][order][:-1]])
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        self.first = np.flatnonzero(run % GROUP_SETS == 0)
        self.last = np.append(self.first[1:], len(order))
        self.tokens = [np.concatenate([self.of(m) for m in self.members[a:b]]) for a, b in zip(self.first, self.last)]
        unions = [np.unique(t) for t in self.tokens]
        self.union, widths = np.concatenate(unions), np.array([len(u) for u in unions])
        self.union_at = np.cumsum(widths) - widths
        self.least = np.minimum.reduceat(self.sizes[self.members], self.first)

    def of(self, k: int) -> np.ndarray:
        return self.ids[self.starts[k] : self.starts[k] + self.sizes[k]]

    def near(self, query: int, wanted: np.ndarray) -> np.ndarray:
        """The members linked with query, among those that wanted (by place in members) asks for."""
        self.mark[self.of(query)] = True
        size, p = self.sizes[query], self.percent
        overlap = np.add.reduceat(self.mark[self.union], self.union_at, dtype=np.int64)
        opened = ((100 + p) * overlap >= p * (size + self.least)) & np.logical_or.reduceat(wanted, self.first)
        found = []
        for g in np.flatnonzero(opened):
            own = self.members[self.first[g] : self.last[g]]
            widths = self.sizes[own]
            common = np.add.reduceat(self.mark[self.tokens[g]], np.cumsum(widths) - widths, dtype=np.int64)
            found.append(own[wanted[self.first[g] : self.last[g]] & (100 * common >= p * (size + widths - common))])
        self.mark[self.of(query)] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def linked_in_groups(nodes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each node the least node that links lead to."""
    groups = TokenGroups(sets, np.arange(len(sets)), percent)
    found = nodes.copy()
    for x in groups.members:
        wanted = found[groups.members] != found[x]
        for y in groups.near(x, wanted) if wanted.any() else ():
            a, b = sorted((found[x], found[y]))
            found[found == b] = a
    return found


def linked_across_groups(components: np.ndarray, is_rest: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of components joined by a link between a row with is_rest and a row without."""
    if is_rest.all():
        return []
    groups, found = TokenGroups(sets, np.flatnonzero(~is_rest), percent), set()
    for x in np.flatnonzero(is_rest):
        near = groups.near(x, components[groups.members] != components[x])
        found.update((int(components[x]), int(c)) for c in np.unique(components[near]))
    return list(found)


def _search(percent: int, width: int) -> Search:
    return Search(
        width=width,
        keyed=lambda sets: part_keys(sets, percent),
        keys_of=_keys_of,
        keys_each=80,
        linked=lambda nodes, sets, extra: linked_in_groups(nodes, sets, percent),
        pairs=lambda components, is_rest, sets, extra: linked_across_groups(components, is_rest, sets, percent),
        reads_keys=False,
    )


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; a Jaccard similarity of percent or more of two sets of shingles is a link.

    No link is lost. Texts without words, null texts included, have no shingles and link with
    nothing, and so does a row with a null doc_id: its component_id is null. Ties go to the
    smallest doc_id. Links are between texts: rows that repeat a doc_id with another text have
    a component each, and repeated rows have the same one. Texts of any length are taken
    whole. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    return linked_rows(docs, text, doc_id, _search(percent, width), "jaccard", CHUNK_NODES, CHUNK_SHINGLES, BROADCAST_IDS).drop("sha")
