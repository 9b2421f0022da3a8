"""Page data against plain Python over the same pages."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.plans.page_data import pages_with_data
from quillstone.sources import page_data as D

WHERE = "/root/testdata/sf0.001"
EMPLOYERS = ("name_of_employer", "employer", "company")


def walk(x, depth=0):
    if depth > 6:
        return []
    if isinstance(x, dict):
        if "title" in x and any(k in x for k in EMPLOYERS):
            return [x]
        x = list(x.values())
    return [found for y in x for found in walk(y, depth + 1)] if isinstance(x, list) else []


@pytest.fixture(scope="module")
def data(spark):
    out = {}
    for r in pages_with_data(spark.read.parquet(f"{WHERE}/pages.parquet")).collect():
        m = re.search(r'<script\s+id="__NEXT_DATA__"[^>]*>(.*?)</script>', r["html"], re.S)
        try:
            out[r["page_id"]] = json.loads(m[1]) if m else None
        except ValueError:
            out[r["page_id"]] = None
    return out


def test_walk_is_the_model(spark, data):
    told = lambda x: x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))
    want = sorted((i, j["title"] or "", next((told(j[k]) for k in EMPLOYERS if j.get(k) is not None), "")) for i, d in data.items() if d for j in walk(d["props"]["pageProps"]))
    got = catalog.queries()["page_data_walk"](spark, WHERE)
    assert sorted((r["page_id"], r["title"] or "", r["employer"] or "") for r in got.collect()) == want
    assert "Python" not in got._jdf.queryExecution().toString() and len(want) > 30


def test_depth_matches_and_shapes(spark):
    deep = {"title": "t", "company": 1}
    for _ in range(6):
        deep = {"k": deep}
    cases = [deep, {"k": deep}, [deep], [{"title": None, "employer": None}], {"title": "x"}, 5, None, [], {"a": [{"title": 1, "company": {"title": 2, "company": 3}}, [[{"title": 4, "company": 5}]]]}]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(99, None), (98, "{bad")], "i int, j string")
    got = D.posting_objects(rows.select("i", F.try_parse_json("j").alias("v")), "v")
    assert {r["i"]: r["n"] for r in got.select("i", F.size("found").alias("n")).collect()} == {**{i: len(walk(c)) for i, c in enumerate(cases)}, 99: 0, 98: 0}


def test_chains_cut_cycles_and_keep_missing_targets(spark):
    entries = {"a": {"r": {"__ref": "b"}}, "b": {"r": {"__ref": "c"}}, "c": {"r": {"__ref": "a"}}, "d": {"r": {"__ref": "d"}}, "e": {"r": {"__ref": "zz"}}, "f": {"r": 4}, "g": {"r": {"__ref": "a"}}}
    df = spark.createDataFrame([(json.dumps(entries), k) for k in entries], "j string, k string").select("k", F.from_json("j", "map<string,variant>").alias("e"))
    for depth, want in ((5, {"a": "abc", "b": "bca", "c": "cab", "d": "d", "e": "e zz", "f": "f", "g": "gabc"}), (1, {"a": "ab", "b": "bc", "c": "ca", "d": "d", "e": "e zz", "f": "f", "g": "ga"})):
        got = df.select("k", D.followed(F.col("e"), F.col("k"), "r", depth).alias("c")).collect()
        assert {r["k"]: r["c"] for r in got} == {k: v.split() if " " in v else list(v) for k, v in want.items()}


def test_last_company_counts(spark):
    text = json.dumps({"props": {"pageProps": {"apolloState": {"data": {"z": {"__typename": "StartupResult", "name": "z", "highlightedJobListings": [{"__ref": "j"}]}, "a": {"__typename": "StartupResult", "name": "a", "highlightedJobListings": [{"__ref": "j"}]}, "j": {"__typename": "JobListing"}}}}}})
    rows = spark.createDataFrame([(1, text), (2, None), (3, "{}")], "i int, j string").select("i", D.cache_entries(F.col("j")).alias("e"))
    got = D.cached_postings(rows, "e").select("i", "key", D.at(F.col("company"), "$.name", "string").alias("n")).collect()
    assert [tuple(r) for r in got] == [(1, "j", "a")]


def test_later_parsers_see_what_is_left(spark):
    seen = {}

    def parser(name, keep):
        def parse(rows):
            seen[name] = sorted(r["i"] for r in rows.collect())
            return rows.withColumn("answer", F.when(keep, F.array(F.col("i").cast("string"))))

        return name, parse

    rows = spark.range(10).withColumnRenamed("id", "i")
    got = D.first_answers(rows, "i", [parser("a", F.col("i") % 2 == 0), parser("b", F.col("i") % 3 == 0), parser("c", F.col("i") < 4)])
    assert seen == {"a": list(range(10)), "b": [1, 3, 5, 7, 9], "c": [1, 5, 7]}
    assert {r["i"]: r["stage"] for r in got.collect()} == {0: "a", 2: "a", 4: "a", 6: "a", 8: "a", 3: "b", 9: "b", 1: "c", 5: None, 7: None}
