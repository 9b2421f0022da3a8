"""Ranked search with blocked posting lists against scoring every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillstone.llm import lexical_blocks as L
from quillstone.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WHERE = "/root/testdata/sf0.001"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """docs and items are pairs of id and text."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if score > 0:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 200]))) for _ in range(300)]
    texts += [texts[i] for i in range(0, 60, 3)] + ["", None, "é É w1", "W1-w2_w3", "...", "w1 " * 3000]
    items = [" ".join(texts[r.randrange(300)].split()[:30]) + " w1 w1 W2" for _ in range(25)] + ["", None, "not there at all", "é", "w1"]
    return list(enumerate(texts)), list(enumerate(items))


@pytest.mark.parametrize(("chunk", "block", "numbers"), [(2048, 16, 1 << 23), (1, 1, 1 << 23), (50, 4, 100), (97, 16, 1 << 23)])
@pytest.mark.parametrize("k", [10, 1])
def test_search_is_brute_force(spark, corpus, monkeypatch, chunk, block, numbers, k):
    monkeypatch.setattr(L, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(L, "BLOCK_DOCS", block)
    monkeypatch.setattr(L, "SUMMARY_NUMBERS", numbers)
    docs, items = (spark.createDataFrame(x, f"{name} long, text string").repartition(3) for x, name in zip(corpus, ("doc_id", "item_id")))
    assert rows_of(L.ranked_search(docs, items, k)) == brute(*corpus, k)


def test_queries_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(L, "QUERIES_AT_ONCE", 7)
    docs, items = (spark.createDataFrame(x, f"{name} long, text string") for x, name in zip(corpus, ("doc_id", "item_id")))
    assert rows_of(L.ranked_search(docs, items)) == brute(*corpus)


def test_summaries_bound_and_blocks_are_skipped(monkeypatch):
    """A summary is at least each of its documents; most documents of a list are never scored."""
    r = np.random.default_rng(4)
    topics = [r.choice(300, 25, replace=False) for _ in range(12)]
    terms = [np.unique(np.append(r.choice(topics[i % 12], 15), 299)) for i in range(1200)]
    values = [r.integers(1, 1000, len(t)) * np.where(t == 299, 1, 50) for t in terms]
    asked = np.append(topics[3][topics[3] != 299][:8], 299)
    beside = [asked if t in asked else np.array([t]) for t in range(300)]
    chunk = L.Chunk(np.arange(1200), terms, values, beside, np.random.default_rng(1).standard_normal((300, 16)).astype(np.float32))
    for t in asked:
        docs, first, summary = chunk.list_of(int(t))
        assert sorted(docs) == [i for i in range(1200) if t in terms[i]]
        for b in range(len(first) - 1):
            for i in docs[first[b] : first[b + 1]]:
                own = dict(zip(terms[i].tolist(), values[i].tolist()))
                assert all(summary[b, j] >= own.get(int(u), 0) for j, u in enumerate(beside[t]))
    scored, original = [], L.Chunk.scores
    monkeypatch.setattr(L.Chunk, "scores", lambda self, docs, x: scored.extend(docs) or original(self, docs, x))
    counts = np.ones(len(asked), np.int64)
    got = chunk.search(asked, counts, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    every = original(chunk, np.arange(1200), np.isin(np.arange(300), asked).astype(np.int64))
    order = np.lexsort((np.arange(1200), -every))[:10]
    assert (got[0] == every[order]).all() and (got[1] == order).all()
    assert len(scored) == len(set(scored)) < 600


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (30, 7, 22, 5)] + [(None, "same words here"), (1, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(0, "words"), (0, "words"), (0, "other")], "item_id int, text string")
    got = rows_of(L.ranked_search(docs, items, 3))
    assert [(a, b, c) for a, b, c, _ in got] == [(0, 1, 1), (0, 1, 5), (0, 2, 7), (0, 3, 22)]
    assert L.ranked_search(docs, items, 10).filter("doc_id is null").first()["rank"] == 5


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "word5 tail7 end"), (2, None), (3, "日本語 ünïcode"), (4, "null id text")], "item_id long, text string")
    docs = [(10**6 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = [(a, b, 10**6 if c is None else c, d) for a, b, c, d in ((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in L.ranked_search(odd_documents, items).collect())]
    assert sorted(got) == brute(docs, [(1, "word5 tail7 end"), (3, "日本語 ünïcode"), (4, "null id text")])
    assert L.ranked_search(no_documents, items).count() == 0 and L.ranked_search(odd_documents, items.limit(0)).count() == 0


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{WHERE}/{table}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.oracle_sql()['op12_geometric_blocks']}) ORDER BY ALL").fetchall()
    assert rows_of(queries.op12_geometric_blocks(spark, WHERE)) == want and len(want) > 300
