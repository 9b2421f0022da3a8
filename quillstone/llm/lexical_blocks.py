"""Ranked lexical search with posting lists blocked by document similarity.

Documents are indexed a chunk at a time, in the task that holds them. Each posting list of a
chunk is clustered: its documents are put to the most similar of some of them, by the angle
of their projected term vectors, and each cluster is a block with a summary, the greatest
contribution of each term to any of its documents. A query visits its lists in the order of
what their terms can give at most. The product of its term counts with a block's summary
bounds the score of every document in the block: a block whose bound stays under the query's
tenth best score is skipped, any other is opened and its documents are scored exactly. Once
the terms that are left can't reach that score together, no list is visited any more. All
numbers are integers, so that bounds and scores are exact and nothing is lost.

The tenth best scores go from one chunk of a task to the next. A block is built when the
first query asks for it, so that terms which no bound makes worth visiting cost nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.shelf import Shelf

#: Queries, and bytes of their texts, that go to the tasks at once; more are searched in several passes.
QUERIES_AT_ONCE, QUERY_BYTES = 1000, 4 << 20
#: Documents and postings of a chunk, documents of a block, about.
CHUNK_DOCS, CHUNK_POSTINGS, BLOCK_DOCS = 2048, 1 << 20, 16
#: Numbers that the summaries of a chunk hold at most; beyond that they are built again when asked for.
SUMMARY_NUMBERS = 1 << 23
#: Dimensions in which documents are compared when lists are clustered.
DIMENSIONS = 16
#: Stands for a null doc_id, which comes last among equal scores.
NO_ID = 2**63 - 1
#: Letters A-Z lowered; bytes that are no part of a term, ASCII other than letters and digits, are blanks.
_FOLDED = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


@dataclass(frozen=True)
class Queries:
    """A block of queries: numbers of terms, and each query's terms with their counts, or nothing for a query without terms."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    counts: list[np.ndarray]

    def beside(self) -> list[np.ndarray]:
        """For each term the terms of all queries that have it."""
        out: list[list[np.ndarray]] = [[] for _ in self.vocabulary]
        for terms in self.terms:
            for t in terms:
                out[t].append(terms)
        return [np.unique(np.concatenate(x)) for x in out]


def queries_of(texts: list[str | None]) -> Queries:
    counts = [Counter(terms_of((t or "").encode())) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    return Queries(vocabulary, [np.array([vocabulary[w] for w in c], np.int64) for c in counts], [np.array(list(c.values()), np.int64) for c in counts])


class Chunk:
    """Documents (each with at least one term of the vocabulary) and their blocked posting lists."""

    def __init__(self, ids: np.ndarray, terms: list[np.ndarray], values: list[np.ndarray], beside: list[np.ndarray], directions: np.ndarray):
        self.ids, self.beside, self.size = ids, beside, len(beside)
        self.term, self.value = np.concatenate(terms), np.concatenate(values)
        widths = np.array([len(t) for t in terms])
        self.start, self.width = np.cumsum(widths) - widths, widths
        self.most = np.zeros(self.size, np.int64)
        np.maximum.at(self.most, self.term, self.value)
        vectors = np.add.reduceat(directions[self.term] * self.value[:, None].astype(np.float32), self.start)
        self.place = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        order = np.argsort(self.term, kind="stable")
        self.posted = np.repeat(np.arange(len(ids)), widths)[order]
        self.list_at = np.searchsorted(self.term[order], np.arange(self.size + 1))
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.held = 0

    def rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all postings of docs, and where those of each begin."""
        widths = self.width[docs]
        begin = np.cumsum(widths) - widths
        return np.arange(widths.sum()) + np.repeat(self.start[docs] - begin, widths), begin

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at, begin = self.rows(docs)
        return np.add.reduceat(asked[self.term[at]] * self.value[at], begin)

    def list_of(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents with term t block by block, where each block begins, and the blocks' summaries over the terms beside t."""
        if t not in self.blocks:
            docs = self.posted[self.list_at[t] : self.list_at[t + 1]]
            number = -(-len(docs) // BLOCK_DOCS)
            heads = docs[np.arange(number) * len(docs) // number]
            block = np.argmax(self.place[docs] @ self.place[heads].T, axis=1)
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
            _, first, block = np.unique(block, return_index=True, return_inverse=True)
            columns = np.full(self.size, -1)
            columns[self.beside[t]] = np.arange(len(self.beside[t]))
            at, _ = self.rows(docs)
            column, whose = columns[self.term[at]], np.repeat(block, self.width[docs])
            known = column >= 0
            summary = np.zeros((len(first), len(self.beside[t])), np.int64)
            np.maximum.at(summary, (whose[known], column[known]), self.value[at[known]])
            if self.held + summary.size > SUMMARY_NUMBERS:
                self.blocks, self.held = {}, 0
            self.blocks[t] = docs, np.append(first, len(docs)), summary
            self.held += summary.size
        return self.blocks[t]

    def search(self, terms: np.ndarray, counts: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """best (scores and ids of the k best documents so far, in order) with those of this chunk that belong there."""
        give = counts * self.most[terms]
        order = np.argsort(-give, kind="stable")
        left = np.cumsum(give[order][::-1])[::-1]
        if left[0] < _least(best, k):
            return best
        asked = np.zeros(self.size, np.int64)
        asked[terms] = counts
        seen = np.zeros(len(self.ids), bool)
        for i, t in enumerate(terms[order]):
            # What has none of the terms so far scores no more than the others give together.
            if left[i] < _least(best, k):
                break
            docs, first, summary = self.list_of(int(t))
            bounds = summary @ asked[self.beside[t]]
            at, by = 0, np.argsort(-bounds, kind="stable")
            # Blocks of the highest bounds come first, few at a time in the beginning, so that the score to reach rises early.
            step = 1
            while at < len(by) and bounds[by[at]] >= _least(best, k):
                some = by[at : at + step]
                some = some[bounds[some] >= _least(best, k)]
                opened = np.concatenate([docs[first[b] : first[b + 1]] for b in some])
                opened = opened[~seen[opened]]
                seen[opened] = True
                if len(opened):
                    best = _better(best, self.scores(opened, asked), self.ids[opened], k)
                at, step = at + step, 2 * step
        return best


def _least(best: tuple[np.ndarray, np.ndarray], k: int) -> int:
    """The score from which a document may be among the best: 1, or the last one's of k."""
    return int(best[0][-1]) if len(best[0]) == k else 1


def _better(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return scores[order], ids[order]


def _forward(vocabulary: dict[bytes, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n, the terms of each document, and those of the vocabulary with their counts."""
        for b in batches:
            n, terms, counts = [], [], []
            for t in b.column(1):
                words = terms_of(t.as_buffer().to_pybytes()) if t.is_valid else []
                known = Counter(filter(vocabulary.__contains__, words))
                n.append(len(words))
                terms.append(np.array([vocabulary[w] for w in known], np.int32).tobytes())
                counts.append(np.array(list(known.values()), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])

    return rows


def _frequencies(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many of a task's documents have each term."""
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["term", "df"])

    return rows


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _best(queries: Queries, weight: np.ndarray, documents: int, total: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best documents of a task for each query."""
        beside = queries.beside()
        directions = np.random.default_rng(12).standard_normal((len(beside), DIMENSIONS)).astype(np.float32)
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = [nothing for _ in queries.terms]
        asked = [i for i, t in enumerate(queries.terms) if len(t)]
        ids, terms, values, postings = [], [], [], 0

        def searched() -> None:
            chunk = Chunk(np.array(ids, np.int64), terms, values, beside, directions)
            for i in asked:
                best[i] = chunk.search(queries.terms[i], queries.counts[i], k, best[i])

        for b in batches:
            for i, n, t, c in zip(*(b.column(j).to_pylist() for j in range(4))):
                term, count = np.frombuffer(t, np.int32).astype(np.int64), np.frombuffer(c, np.int32).astype(np.int64)
                if not len(term):
                    continue
                m = 25 + 75 * n * documents // total
                ids.append(NO_ID if i is None else i)
                terms.append(term)
                values.append(weight[term] * (1_000_000_000 * count // (1000 * count + 8 * m)))
                postings += len(term)
                if len(ids) >= CHUNK_DOCS or postings >= CHUNK_POSTINGS:
                    searched()
                    ids, terms, values, postings = [], [], [], 0
        if ids:
            searched()
        q = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        found = [np.concatenate([x[j] for x in best]) if best else nothing[0] for j in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(found[0]), pa.array(found[1])], names=["query", "score", "id"])

    return rows


def _ranked(rows: DataFrame, asked: list, key: T.DataType, k: int, shelf: Shelf, label: str) -> DataFrame:
    """item_id, rank, doc_id and score for one block of queries (item_id, text)."""
    spark = rows.sparkSession
    queries = queries_of([t for _, t in asked])
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", key)])
    items = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(asked)], schema)
    forward = shelf.put(rows.mapInArrow(_forward(queries.vocabulary), "doc_id long, n long, terms binary, counts binary"), f"forward_{label}")
    documents, total = forward.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(queries.vocabulary)
    partial = forward.select("terms").mapInArrow(_frequencies(size), "term int, df long")
    df = np.zeros(size, np.int64)
    for r in partial.groupBy("term").agg(F.sum("df").alias("df")).collect():  # as many rows as the block's queries have terms
        df[r["term"]] = r["df"]
    best = forward.mapInArrow(_best(queries, weights(documents, df), documents, total, k), "query int, score long, id long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    best = best.join(F.broadcast(items), "query")  # one row for each query of the block
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k documents that score highest for each item, those that score at all.

    Terms are the stretches of letters, digits and characters beyond ASCII, letters A-Z
    lowered. Equal scores rank by doc_id, rows without doc_id last. Null and empty texts have
    no terms: such items have no rows, such documents aren't found and don't count. Items that
    repeat in full are one, other rows with the same item_id are ranked by themselves; a
    document's repeated rows are documents of their own. Texts are taken whole. Empty tables
    give no rows; other columns are ignored, whatever their names.
    """
    shelf = Shelf(docs.sparkSession, "lexical")
    asked = shelf.put(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct(), "items")
    number, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-number // QUERIES_AT_ONCE), -(-size // QUERY_BYTES))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    key = asked.schema["item_id"].dataType
    found = []
    for i in range(parts):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        block = [(r["item_id"], r["text"]) for r in part.collect()]  # QUERIES_AT_ONCE rows and QUERY_BYTES, about
        found.append(shelf.put(_ranked(rows, block, key, k, shelf, str(i)), f"ranked_{i}"))
        shelf.drop(f"forward_{i}")
    return reduce(DataFrame.unionByName, found)
