"""Exact, near and passage deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quillstone.llm import block_naming, minhash_tensor, suffix_dedup
from quillstone.llm.components import components
from quillstone.llm.induced_sort import suffix_array
from quillstone.llm.shingles import shingle_sets
from quillstone.shelf import Shelf

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies and shared passages among random word texts."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [make(r.choice([1, 3, 4, 5, 30, 120, 400])) for _ in range(60)]
    passage = make(40)
    for i in range(40):
        base = texts[r.randrange(60)].split(" ")
        for _ in range(r.choice([0, 1, 1, 2, 6])):
            base[r.randrange(len(base))] = r.choice(words)
        texts.append(" ".join(base))
    for i in range(12):
        at = r.randrange(len(texts))
        texts[at] = texts[at] + " " + passage + " " + make(5)
    texts += [texts[3].replace(" ", "\n  "), texts[4].upper(), None, "", "é" * 80, "x" + "é" * 80]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def collected(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_exact_is_brute_force(spark, corpus, block):
    groups = defaultdict(list)
    for i, t in collected(corpus):
        groups[BLANK.sub("", t)].append((len(t), -i))
    want = {(i, -max(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in [-x for _, x in g]}
    got = block_naming.exact_duplicates(corpus, block=block).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_identities_do_not_trust_digests(spark):
    """Rows that a broken digest takes for equal still get different names."""
    rows = [(1, b"s", "abcd"), (2, b"s", "abce"), (3, b"s", "abcd"), (4, b"s", "ab"), (5, b"s", ""), (6, b"s", "")]
    shelf = Shelf(spark, "test")
    got = {r["k"]: (r["level"], r["name"]) for r in block_naming.identities(spark.createDataFrame(rows, "k long, sha binary, norm string"), shelf, 1).collect()}
    assert got[1] == got[3] and got[5] == got[6] and len(set(got.values())) == 4


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def in_chunks(monkeypatch, nodes):
    """Clusters of more than twice so many sets are cut up."""
    if nodes:
        monkeypatch.setattr(minhash_tensor, "CHUNK_NODES", nodes)


@pytest.mark.parametrize("chunk", [None, 1, 4])
def test_near_is_brute_force(corpus, monkeypatch, chunk):
    in_chunks(monkeypatch, chunk)
    got = minhash_tensor.near_duplicates(corpus).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(collected(corpus))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("chunk", [None, 3])
def test_rows_that_repeat_a_doc_id(spark, monkeypatch, chunk):
    """Links are between texts, whatever their rows' doc_ids."""
    in_chunks(monkeypatch, chunk)
    base = {c: [f"{c}{k}" for k in range(60)] for c in "abcd"}
    text = lambda c, cut=0: " ".join(base[c][: 60 - cut])
    rows = [(9, text("a")), (9, text("b")), (9, text("b")), (4, text("a", 2)), (5, text("b", 2)), (7, text("c")), (7, "alone"), (8, text("c", 1)), (3, text("d")), (3, text("d")), (2, text("d")), (1, "alone again")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in minhash_tensor.near_duplicates(docs).collect()}
    assert got == {(9, 4), (9, 5), (4, 4), (5, 5), (7, 7), (8, 7), (3, 2), (2, 2), (1, 1)}


def test_many_near_copies_have_the_classes_of_brute_force(spark):
    """30,000 texts from one template, with up to two words changed each, in over a hundred chunks."""
    r = np.random.default_rng(17)
    template = [f"t{k}" for k in range(72)]
    texts = []
    for i in range(30_000):
        words = list(template)
        for at in r.integers(0, len(words), r.integers(0, 3)):
            words[at] = f"x{r.integers(0, 4)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {row["doc_id"]: row["component_id"] for row in minhash_tensor.near_duplicates(docs).collect()}
    # brute force over the distinct sets, each against all later ones that aren't in its class yet
    sets = {}
    for i, s in enumerate(shingle_sets([t.encode() for t in texts])):
        sets.setdefault(s.tobytes(), i)
    first, values = np.array(list(sets.values())), [np.frombuffer(s, np.uint64) for s in sets]
    assert len(first) > 60 * minhash_tensor.CHUNK_NODES // 2
    sizes = np.array([len(v) for v in values])
    _, ids = np.unique(np.concatenate(values), return_inverse=True)
    rows = [ids[a : a + n] for a, n in zip(np.cumsum(sizes) - sizes, sizes)]
    mark, want, left = np.zeros(ids.max() + 1, bool), first.copy(), np.arange(len(first))
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        tokens, offsets = np.concatenate([rows[i] for i in left] or [ids[:0]]), np.cumsum(sizes[left]) - sizes[left]
        while frontier and len(left):
            x = frontier.pop()
            mark[rows[x]] = True
            common = np.add.reduceat(mark[tokens], offsets, dtype=np.int64)
            mark[rows[x]] = False
            near = 100 * common >= 85 * (sizes[left] + sizes[x] - common)
            if near.any():
                want[left[near]] = first[root]
                frontier.extend(left[near])
                left = left[~near]
                tokens, offsets = np.concatenate([rows[i] for i in left] or [ids[:0]]), np.cumsum(sizes[left]) - sizes[left]
    assert len(set(want)) < len(want) // 2
    assert {k: got[k] for k in first.tolist()} == dict(zip(first.tolist(), want.tolist()))


def test_recall_is_the_same_for_one_chunk_and_for_many(spark, monkeypatch):
    """Pairs a little over the similarity: the tables find nearly all, and the same ones however clusters are cut."""
    r = random.Random(3)
    texts = []
    for i in range(400):
        words = [f"w{i}x{k}" for k in range(100)]
        texts += [" ".join(words), " ".join(words[r.randint(0, 7) : 100 - r.randint(0, 7)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = {(x["doc_id"], x["component_id"]) for x in minhash_tensor.near_duplicates(docs).collect()}
    in_chunks(monkeypatch, 1)
    assert whole == {(x["doc_id"], x["component_id"]) for x in minhash_tensor.near_duplicates(docs).collect()}
    assert sum(c == 2 * (i // 2) for i, c in whole if i % 2) >= 0.99 * 400


def test_linked_components_of_a_chain():
    sets = [np.arange(i, i + 40, dtype=np.uint64) for i in range(0, 40, 3)] + [np.arange(500, 540, dtype=np.uint64)]
    nodes = np.arange(len(sets))[::-1].copy()
    found = minhash_tensor.linked_components(nodes, sets, np.zeros((len(sets), 16), np.uint64))
    assert set(found[:-1]) == {1} and found[-1] == 0
    apart = minhash_tensor.linked_components(nodes, sets, np.arange(16 * len(sets), dtype=np.uint64).reshape(-1, 16))
    assert (apart == nodes).all()


def test_shingle_sets_of_pieces_are_those_of_the_whole(monkeypatch):
    from quillstone.llm import shingles

    texts = [b"", b" ", b"One two", b"a b c d e f", b"A b C d e\tf", b"w%d " * 5 % (1, 2, 3, 4, 5) * 300]
    whole = list(shingle_sets(texts))
    monkeypatch.setattr(shingles, "PIECE", 16)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, shingle_sets(texts)))
    assert [len(s) for s in whole[:5]] == [0, 0, 1, 2, 2] and (whole[3] == whole[4]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 5), (5, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Shelf(spark, "test"), "c").collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 100: 5, 5: 5, 101: 5}


def brute_removal(docs):
    first, out = {}, {}
    raw = sorted((i, t.encode()) for i, t in docs)
    for i, b in raw:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize(("batch", "hot"), [(2000, 1000), (2000, 3), (1 << 20, 1000), (1 << 20, 0)])
def test_passages_are_brute_force(corpus, monkeypatch, batch, hot):
    """Of hot minimisers, the windows are sent one by one."""
    monkeypatch.setattr(suffix_dedup, "HOT_DOCS", hot)
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda *a, _f=suffix_dedup.repeated_spans: _f(*a, batch_bytes=batch, shard_bytes=batch))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    want = brute_removal(collected(corpus))
    got = suffix_dedup.removal_digests(corpus).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {i: w[:4] for i, w in want.items()}
    assert sum(w[1] for w in want.values()) > 5000
    texts = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(corpus).collect()}
    assert {i: t or "" for i, t in texts.items()} == {i: w[4].decode("utf-8", "ignore") for i, w in want.items()}


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed, tmp_path):
    """Small memory and base force spilling and recursion."""
    r = random.Random(seed)
    n, letters, cap = r.choice([1, 2, 5, 40, 300]), r.choice([1, 2, 4, 60]), r.choice([3, 8, 50])
    t = bytes(r.choice(range(97, 97 + letters)) for _ in range(n))
    t = (t[: max(1, n // 4)] * 6)[:n] if seed % 3 == 0 else t
    order, common = suffix_array(t, cap, memory=r.choice([10, 1000]), base=r.choice([2, 8]), folder=str(tmp_path))
    assert sorted(order) == list(range(n))
    for i in range(1, n):
        a, b = t[order[i - 1] :][:cap], t[order[i] :][:cap]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert a <= b and common[i] == same
    assert not list(tmp_path.iterdir())


def test_odd_rows(odd_documents, no_documents):
    n = odd_documents.count()
    exact = block_naming.exact_duplicates(odd_documents).collect()
    near = minhash_tensor.near_duplicates(odd_documents).collect()
    cut = suffix_dedup.removal_digests(odd_documents).collect()
    assert len(exact) == len(near) == len(cut) == n
    assert {r["doc_id"]: r["keep_id"] for r in exact if r["doc_id"] in (0, 1, 2, 3, 4, 6, 7)} == {0: 2, 1: 2, 2: 2, 3: 3, 4: 3, 6: 7, 7: 7}
    assert all(r["kept"] for r in near if r["doc_id"] is None)
    assert all(r["n_removed"] == 0 for r in cut if r["doc_id"] in (None, 0, 1, 3, 4, 8))
    assert next(r for r in cut if r["doc_id"] == 9)["n_removed"] == 3000
    assert suffix_dedup.without_repeats(odd_documents).columns == odd_documents.columns
    for f in (block_naming.exact_duplicates, minhash_tensor.near_duplicates, suffix_dedup.removal_digests, suffix_dedup.without_repeats):
        assert f(no_documents).count() == 0


@pytest.mark.parametrize("at_once", [250_000, 5])
def test_long_paths_need_few_rounds(spark, monkeypatch, at_once):
    """Ties that one task has are contracted there, so that not even a long path takes rounds of shuffles."""
    from quillstone.llm import components as C

    monkeypatch.setattr(C, "EDGES_A_TASK", at_once)
    path = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (3, 3), (9, 7)]
    shelf = Shelf(spark, "test")
    found = C.components(spark.createDataFrame(path, "u long, v long").repartition(3), shelf, "c").collect()
    assert sorted(map(tuple, found)) == [(3, 3), (7, 3), (9, 3), *((i, 100) for i in range(100, 161))]
    assert at_once == 5 or shelf.names == {"c_0"}


def test_stretches_go_to_shards_compressed():
    """What a shard gets is smaller than the stretches themselves, and they come back as they were."""
    import pyarrow as pa

    text = b"all the words of a passage that two documents have, told again and again: " * 40
    texts = pa.table({"batch": [0, 0], "doc_id": [1, 2], "sha": [b"a" * 32, b"b" * 32], "text": [text, b"x" + text]})
    keys = np.unique(suffix_dedup.stretches([text])[0] >> np.uint64(32)).astype("<u4")
    repeated = pa.table({"batch": [0], "bucket": [0], "parts": [keys.tobytes()], "hot": [b"\0" * len(keys)]})
    sent = suffix_dedup._sender(1, 1)(texts, repeated).filter(pa.compute.greater_equal(pa.compute.field("shard"), 0)).to_pylist()
    sizes = [np.frombuffer(r["lengths"], "<u4").sum() for r in sent]
    assert [r["n_bytes"] for r in sent] == sizes and all(len(r["content"]) < r["n_bytes"] / 2 for r in sent)
    assert len(pa.decompress(sent[0]["content"], sent[0]["n_bytes"], codec=suffix_dedup.CODEC, asbytes=True)) == sizes[0]


def test_packed_order_is_the_stable_one():
    from quillstone.llm.induced_sort import _stable

    r = np.random.default_rng(1)
    for high in (1, 3, 1000, 1 << 40, 1 << 62):
        for n in (0, 1, 2, 999):
            key = r.integers(0, high, n)
            assert (_stable(key) == np.argsort(key, kind="stable")).all()


@pytest.mark.parametrize("seed", range(6))
def test_reduced_strings_are_sorted_in_memory(seed):
    """Ranks by doubling and common prefixes by eight bytes at a time against plain slices; a shard's reduced string needs no second induction."""
    from quillstone.llm import induced_sort as I

    r = np.random.default_rng(seed)
    names = np.unique(r.integers(0, [2, 3, 40][seed % 3], 300), return_inverse=True)[1]
    depth = [1, 4, 26][seed % 3]
    cut = [tuple(names[i : i + depth].tolist()) for i in range(len(names))]
    assert [cut[i] for i in I._doubled(names, depth)] == sorted(cut)
    text = bytes(r.choice([0, 1, 97, 255], 500, p=[0.1, 0.1, 0.7, 0.1]).tolist()) + bytes([97]) * 100
    raw = np.zeros(len(text) + 66, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    a, b = np.array([(i, j) for i, j in r.integers(0, len(text), (2000, 2)).tolist() if i != j]).T
    want = [next((k for k in range(50) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), 50) for i, j in zip(a.tolist(), b.tolist())]
    assert I._common(np.ndarray((len(text) + 58,), "<u8", raw, strides=(1,)), len(text), a, b, 50).tolist() == want
    assert I.BASE >= 2 * suffix_dedup.SHARD_BYTES // 4
