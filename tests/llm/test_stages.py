"""Stages and their operators on rows with clashing column names, repeated ids and repeated rows."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quillstone.llm import decisions, minhash_tensor, preference, suffix_dedup
from quillstone.llm.columns import fresh, own_columns

WHERE = "/root/testdata/sf0.001"
PASSAGE = "a passage that is well over fifty bytes long and stands in two of the texts"


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named as the operators name theirs, one with odd signs, and values of other types."""
    r = random.Random(4)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    twin = words(60)
    rows = [
        (1, words(30) + " " + PASSAGE), (2, words(30) + " " + PASSAGE), (3, "same"), (4, "same"), (5, twin), (6, twin + " end"), (7, None), (None, "no id"), (8, ""), (2, "another text of id two"),
    ]
    names = ["doc_id", "text", "__id", "__sha", "__spans", "__all", "id_key", "SHA_KEY", "cut_spans", "all_gone", "node", "mark", "a.b`c"]
    return spark.createDataFrame([(i, t, f"x{i}", 1, "s", 2.5, [1], "k", "c", True, "n", "m", f"z{i}") for i, t in rows], "doc_id long, text string, __id string, __sha int, __spans string, __all double, id_key array<int>, SHA_KEY string, cut_spans string, all_gone boolean, node string, mark string, `a.b``c` string").toDF(*names)


def counted(df):
    return Counter(map(str, df.collect()))


def test_fresh_names(clashing):
    assert fresh(clashing, "id_key", "sha_key", "other") == ["id_key_1", "sha_key_1", "other"]
    assert clashing.select(*own_columns(clashing)).columns == clashing.columns


@pytest.mark.parametrize(("f", "gone"), [(decisions.drop_exact, {4, 8}), (decisions.drop_near, {4, 6})])
@pytest.mark.parametrize("limit", [10**9, 0])
def test_drops_leave_other_columns_alone(clashing, monkeypatch, f, gone, limit):
    monkeypatch.setattr(decisions, "BROADCAST_KEYS", limit)
    left = f(clashing)
    assert left.dtypes == clashing.dtypes
    want = [r for r in clashing.collect() if r["doc_id"] not in gone]
    assert counted(left) == Counter(map(str, want))


def test_passages_leave_other_columns_alone(clashing):
    left = suffix_dedup.without_repeats(clashing)
    assert left.dtypes == clashing.dtypes
    texts = {(r["doc_id"], r["__id"]): r["text"] for r in left.collect()}
    before = {(r["doc_id"], r["__id"]): r["text"] for r in clashing.collect()}
    assert PASSAGE not in texts[2, "x2"] if texts[2, "x2"] else True
    assert texts[1, "x1"] == before[1, "x1"] and texts[7, "x7"] is None and texts[None, "xNone"] == "no id"


def test_near_drop_judges_texts_not_ids(spark):
    t = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, t), (2, t), (2, "quite another text under the same id"), (2, t)], "doc_id long, text string")
    assert counted(decisions.drop_near(docs)) == Counter(map(str, docs.filter("doc_id = 1 or text like 'quite%'").collect()))


def test_pipeline_against_its_stages_and_brute_force(spark):
    """run() gives the pieces that the stages give one by one; every text that stays is the first of its kind."""
    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, WHERE).collect(), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, left, WHERE).collect()
    piece = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert Counter(map(piece, corpus_pipeline.run(spark, WHERE).collect())) == Counter(map(piece, rows))
    toxic = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, WHERE).collect()}
    kept, seen, want = corpus_pipeline.exact(spark, docs.filter(~docs["doc_id"].isin(list(toxic))), WHERE), {}, set()
    for r in docs.collect():
        if r["doc_id"] not in toxic:
            key = "".join((r["text"] or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
            seen.setdefault(key, []).append((-len(r["text"] or ""), r["doc_id"]))
    want = {min(v)[1] for v in seen.values()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_preference_of_odd_rows(spark):
    rows = [(0, 1, "user", "hi"), (0, 1, "user", "hi"), (0, 2, "assistant", "long " * 30_000), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a")]
    turns = spark.createDataFrame([(0, bool(c), c, *r, "x", 7) for c, *r in rows], "p long, rejected boolean, conv_id long, turn int, role string, text string, prompt string, said int")
    (got,) = preference.preference_pairs(turns, "p", "rejected").collect()
    assert (got["n_common"], got["n_chosen"], got["n_rejected"]) == (2, 3, 4)
    assert got["chosen"].count("long ") == 30_000 and got["rejected"].index("\na<") < got["rejected"].index("\nb<")


def test_recursion_runs_at_least_twice(monkeypatch):
    """The recursive path gives what sorting in memory gives."""
    from quillstone.llm import induced_sort

    r = random.Random(9)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 6))) for _ in range(80)]
    passages = [" ".join(r.choice(words) for _ in range(60)) for _ in range(5)]
    texts = [" ".join(r.choice(words) for _ in range(40)) + r.choice(passages) + " ".join(r.choice(words) for _ in range(20)) for _ in range(60)]
    depth, deepest = [0], [0]
    original = induced_sort._sorted_lms

    def counted_calls(*a):
        depth[0] += 1
        deepest[0] = max(deepest[0], depth[0])
        try:
            return original(*a)
        finally:
            depth[0] -= 1

    monkeypatch.setattr(induced_sort, "_sorted_lms", counted_calls)
    text = "\xff".join(texts).encode("latin-1") + b"\xff"
    order, common = induced_sort.suffix_array(text, 50, base=64)
    assert deepest[0] >= 3  # the text, and two reduced strings
    plain = induced_sort.suffix_array(text, 50, base=1 << 22)
    assert (common == plain[1]).all() and [text[i : i + 50] for i in order] == [text[i : i + 50] for i in plain[0]]


@pytest.mark.parametrize("limit", [10**9, 0])
def test_broadcast_or_not(spark, monkeypatch, limit):
    for module in (minhash_tensor, suffix_dedup):
        monkeypatch.setattr(module, "BROADCAST_IDS", limit)
    t = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, t), (2, t + " end"), (3, "x " + t), (4, "short")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash_tensor.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert {(r["doc_id"], r["n_spans"]) for r in suffix_dedup.removal_digests(docs).collect()} == {(1, 0), (2, 1), (3, 1), (4, 0)}
