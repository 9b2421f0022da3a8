"""Queries that hold all rows against all others, against brute force."""

import random
import re

import numpy as np
import pytest

from quillstone import catalog
from quillstone.operators import scoring, similarity

WHERE = "/root/testdata/sf0.001"


def best_shares(bullets, sources):
    found = lambda t: set(re.findall("[a-z]{3,}", t.lower()))
    known = [found(s) for s in sources]
    return {b: round(max((len(found(b) & s) for s in known), default=0) / max(1, len(found(b))), 4) for b in bullets}


@pytest.mark.parametrize("at_once", [500, 4])
def test_grounded_is_brute_force(spark, monkeypatch, at_once):
    """Sources in one block and in several, few counts at once; bullets without words or overlap have 0."""
    monkeypatch.setattr(scoring, "SOURCES_AT_ONCE", at_once)
    monkeypatch.setattr(scoring, "CELLS_AT_ONCE", 50)
    r = random.Random(3)
    vocabulary = [a + b + c for a in "abcd" for b in "xyz" for c in "mno"]
    make = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 12)))
    bullets, sources = [*{make() for _ in range(60)}, "nothing shared here", "12 34", ""], [*{make() for _ in range(25)}, "78"]
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    got = scoring.grounded(frame(bullets, "bullet"), frame(sources, "source"), "bullet", "source").collect()
    assert len(got) == len(bullets) and {x["bullet"]: x["best"] for x in got} == pytest.approx(best_shares(bullets, sources))
    assert all(x["grounded"] == (x["best"] >= 0.35) for x in got)
    assert all(x["best"] == 0 for x in scoring.grounded(frame(bullets, "bullet"), frame([], "source"), "bullet", "source").collect())


def test_bullet_grounding_has_every_line(spark):
    lines = lambda t: {x for r in spark.read.parquet(f"{WHERE}/{t}.parquet").select("text").collect() for x in (r[0] or "").split("\n") if len(x) > 20}
    bullets, sources = lines("documents"), lines("benchmark")
    got = {r["bullet"]: r["best"] for r in catalog.queries()["bullet_grounding"](spark, WHERE).collect()}
    assert set(got) == bullets
    some = random.Random(1).sample(sorted(bullets), min(150, len(bullets)))
    assert {b: got[b] for b in some} == pytest.approx(best_shares(some, sources), abs=2e-4)


def test_title_match_has_every_part(spark):
    parts = spark.read.parquet(f"{WHERE}/part.parquet").select("p_partkey", "p_brand", "p_name").collect()
    got = {r["p_partkey"]: (r["score"], r["found"]) for r in catalog.queries()["title_match"](spark, WHERE).collect()}
    assert set(got) == {r["p_partkey"] for r in parts}
    for p in random.Random(2).sample(parts, 40):
        best = round(max(similarity.token_set_ratio(f"Senior {p['p_name']}", q["p_name"]) for q in parts if q["p_brand"] == p["p_brand"]), 2)
        assert got[p["p_partkey"]] == (pytest.approx(best), best >= 75)


def test_best_title_of_each_job(spark):
    """Jobs with equal titles have a row each, and so has one whose board is empty."""
    jobs = spark.createDataFrame([(1, "a", "data engineer"), (2, "a", "data engineer"), (3, "b", "nurse"), (4, "c", "cook")], "id long, board string, title string")
    board = spark.createDataFrame([("a", "engineer"), ("a", "cook"), ("b", "pilot")], "board string, listed string")
    got = {r["id"]: (r["best_title"], r["found"]) for r in similarity.best_title(jobs, board, "board", "title", "listed", "id").collect()}
    assert got == {1: ("engineer", True), 2: ("engineer", True), 3: ("pilot", False), 4: (None, False)}


@pytest.mark.parametrize("rows, at_once", [(1000, 500), (20, 3)])
def test_nearest_has_every_query(spark, monkeypatch, rows, at_once):
    """Queries in one block and in several; equal vectors go by the larger key."""
    for name, n in (("QUERY_ROWS", rows), ("BROADCAST_ROWS", rows), ("QUERIES_AT_ONCE", at_once)):
        monkeypatch.setattr(similarity, name, n, raising=False)
    r = np.random.default_rng(4)
    v = r.normal(size=(120, 8))
    v[100:] = np.eye(8)[0]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 9)
    want = {(q, k + 1): n for q in range(0, 120, 2) for k, n in enumerate(sorted((n for n in range(120) if n != q), key=lambda n: (-s[q, n], -n))[:4])}
    got = similarity.nearest(vectors.filter("vec_id % 2 = 0"), vectors, 4).collect()
    assert len(got) == len(want) and {(x["query_id"], x["rank"]): x["neighbour_id"] for x in got} == want


def test_headers_and_supplier_counts_have_every_row(spark):
    read = lambda t: spark.read.parquet(f"{WHERE}/{t}.parquet")
    assert catalog.queries()["comment_headers_all"](spark, WHERE).select("o_orderkey").distinct().count() == read("orders").count()
    nations = [(r["s_suppkey"], r["s_nationkey"]) for r in read("supplier").collect()]
    others = {a: sum(x == y and a != b for b, y in nations) for a, x in nations}
    assert {r["a"]: r["n"] for r in catalog.queries()["same_key_other_rows"](spark, WHERE).collect()} == {a: n for a, n in others.items() if n}


def test_item_in_source_wants_the_whole_item(spark, tmp_path):
    item = "a benchmark item whose first sixty characters are not all that it has to say"
    rows = [(1, f"before {item} after"), (2, f"only {item[:65]}"), (3, None), (4, "clean")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["n"] for r in catalog.queries()["item_in_source"](spark, str(tmp_path)).collect()}
    assert got == {1: 1}
