"""Joins by a token-group matrix, and what a large cluster sends, against brute force."""

import random
import re

import numpy as np
import pytest

from quillstone.llm import group_matrix as G
from quillstone.llm import minhash_tensor, near_links
from quillstone.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles_of(text, width=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, percent=90, width=3):
    sets = {i: shingles_of(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.fixture(scope="module")
def texts():
    """Short and long texts with words changed, added and cut, chains of small changes, and shared passages."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    out = [make(r.choice([1, 2, 3, 8, 10, 11, 12, 20, 21, 40, 90, 300])) for _ in range(60)]
    for _ in range(120):
        t = list(out[r.randrange(len(out))])
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            at = r.randrange(len(t) + 1)
            t = r.choice([t[:at] + make(1) + t[at:], t[:at] + make(1) + t[at + 1 :], t[: max(1, len(t) - 1)]])
        out.append(t)
    passage = make(30)
    out += [passage + make(r.choice([0, 1, 2, 5])) for _ in range(20)]
    return [" ".join(t) for t in out] + [None, "", " \t", "W1 w2", "w1  W2"]


@pytest.mark.parametrize(("chunk", "percent", "width"), [(256, 90, 3), (1, 90, 3), (3, 90, 3), (2, 80, 3), (256, 70, 2)])
def test_join_is_brute_force(spark, texts, monkeypatch, chunk, percent, width):
    monkeypatch.setattr(G, "CHUNK_NODES", chunk)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = G.jaccard_components(docs, percent=percent, width=width).collect()
    want = brute(list(enumerate(texts)), percent, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(texts) - 30


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_similar_sets_have_a_key_in_common(percent):
    """All pairs just similar enough, of every size up to 300 and some beyond."""
    r = np.random.default_rng(percent)
    for size in [*range(1, 300, 3), 1000, 5000]:
        pool = r.integers(0, 2**63, 3 * size + 10, dtype=np.uint64)
        for _ in range(3):
            both = int(r.integers(0, size + 1))
            rest = [(a, b) for a in range(size - both + 1) for b in (0, a, size) if 100 * both >= percent * (both + a + b) and a + b and both]
            if not rest:
                continue
            a, b = rest[-1]
            x, y = (np.unique(np.concatenate([pool[:both], t])) for t in (pool[size : size + a], pool[2 * size + 5 : 2 * size + 5 + b]))
            if (100 * both >= percent * (len(x) + len(y) - both)) and not (len(x) == len(y) == both):
                p, q = (set(np.frombuffer(k, np.uint64).tolist()) for k in G.part_keys([x, y], percent))
                assert p & q, (size, both, a, b)


def test_sparse_parts_go_to_further_deals(monkeypatch):
    """With parts that hardly ever count, every deal is used and no pair is lost."""
    monkeypatch.setattr(G, "PART_TOKENS", 50)
    r = np.random.default_rng(3)
    for size in (12, 60, 200):
        x = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        p, q = (set(np.frombuffer(k, np.uint64).tolist()) for k in G.part_keys([x, x[:-1]], 90))
        assert p & q


def test_bounds_open_the_right_groups():
    """What groups find is what comparing all pairs finds, and few groups are opened."""
    r = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, 80, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[int(r.integers(0, 6)) :], r.integers(0, 2**63, int(r.integers(0, 5)), dtype=np.uint64)])) for _ in range(6)]
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    groups = G.TokenGroups(sets, np.arange(len(sets)), 90)
    for x in range(0, len(sets), 7):
        assert set(groups.near(x, np.ones(len(sets), bool)).tolist()) == {y for y in range(len(sets)) if near(sets[x], sets[y])}
    assert all(set(groups.of(m)) <= set(groups.union[a : a + n]) for g, (a, n) in enumerate(zip(groups.union_at, np.diff(np.append(groups.union_at, len(groups.union))))) for m in groups.members[groups.first[g] : groups.last[g]])


def test_representatives_that_do_not_decide(spark, monkeypatch):
    """Chains whose ends are far apart: members link components whose representatives are not similar."""
    words = [f"c{k}" for k in range(200)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for module, f in ((G, G.jaccard_components), (minhash_tensor, minhash_tensor.near_duplicates)):
        monkeypatch.setattr(module, "CHUNK_NODES", 2)
        assert {r["component_id"] for r in f(docs).collect()} == {0}


@pytest.mark.parametrize("kind", ["minhash", "groups"])
def test_rows_sent_for_one_cluster_grow_in_proportion(spark, monkeypatch, kind):
    """Near copies of one text: four times the sets send four times the rows, not sixteen times."""
    module, f = (minhash_tensor, minhash_tensor.near_duplicates) if kind == "minhash" else (G, G.jaccard_components)
    monkeypatch.setattr(module, "CHUNK_NODES", 16)
    sent, original, across = [], near_links._searched, near_links._between

    def counted(rows, *a):
        sent[-1] += rows.count()
        return original(rows, *a)

    def between(placed, sets, labelled, open_, *a):
        sent[-1] += labelled.join(open_, "cluster").selectExpr("sum(k_rest + if(component <> largest, k_all, 0))").first()[0]
        return across(placed, sets, labelled, open_, *a)

    monkeypatch.setattr(near_links, "_searched", counted)
    monkeypatch.setattr(near_links, "_between", between)
    r = random.Random(6)
    template = [f"t{k}" for k in range(120)]
    for n in (600, 2400):
        sent.append(0)
        rows = []
        for i in range(n):
            t = list(template)
            t[r.randrange(120)] = f"x{i}"
            rows.append((i, " ".join(t)))
        got = f(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert {x["component_id"] for x in got.collect()} == {0}
    assert sent[0] >= 600 and sent[1] < 6 * sent[0]


def test_odd_rows(odd_documents, no_documents):
    got = G.jaccard_components(odd_documents).collect()
    assert len(got) == odd_documents.count() and G.jaccard_components(no_documents).count() == 0
    want = brute([(r["doc_id"], r["text"]) for r in odd_documents.dropDuplicates(["doc_id"]).collect() if r["doc_id"] is not None])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)


def test_ids_are_joined_where_they_are_too_many(spark, texts, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_IDS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in G.jaccard_components(docs).collect()} == brute(list(enumerate(texts)))


def test_width_of_shingles():
    sets = [s for w in (1, 3, 5) for s in shingle_sets([b"a b c d e f a b c"], w)]
    assert [len(s) for s in sets] == [6, 6, 5]


def test_same_rows_as_sql(spark):
    import duckdb

    from quillstone.llm import queries

    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    got = queries.op13_group_matrix(spark, where)
    want = con.sql(queries.oracle_sql()["op13_group_matrix"])
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(want.project(", ".join(sorted(want.columns))).fetchall())
