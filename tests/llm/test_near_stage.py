"""The pipeline's stage near against brute force at its own similarity."""

import random

import pytest

import corpus_pipeline
from quillstone.llm import minhash_tensor

WIDTH = 5


def brute_kept(texts, percent):
    """The least index of each component of texts whose sets of word runs reach the similarity."""
    sets = [{tuple(w[k : k + WIDTH]) for k in range(len(w) - WIDTH + 1)} for w in (t.split() for t in texts)]
    up = list(range(len(sets)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for b in range(len(sets)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i for i in range(len(sets)) if find(i) == i}


@pytest.mark.parametrize("chunk", [None, 1])
def test_near_is_brute_force_at_80(spark, monkeypatch, chunk):
    """Pairs on both sides of 0.8 and of 0.85, and chains of them."""
    if chunk:
        monkeypatch.setattr(minhash_tensor, "CHUNK_NODES", chunk)
    r = random.Random(5)
    texts = []
    for i in range(60):
        base = [f"w{i}x{k}" for k in range(100)]
        texts += [" ".join(base[: 100 - cut]) for cut in (0, *r.sample(range(10, 27), 2))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {row["doc_id"] for row in corpus_pipeline.near(spark, docs, "").collect()}
    assert got == brute_kept(texts, 80) and len(got) < len(brute_kept(texts, 85))
