"""Column builders and operators against hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstone.functions import dates, numbers, text
from quillstone.operators import relational as R
from quillstone.operators import scoring, screening
from quillstone.operators.salary import salary
from quillstone.operators.similarity import greedy_pairs, token_set_ratio
from quillstone.sources import tables
from quillstone.streaming import ingest

AS_OF = datetime(2024, 6, 1)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_terms_need_word_bounds_when_short(spark):
    got = values(spark, [("go to golang",), ("ergo",), (None,)], "t string", text.hits(F.col("t"), ("go", "golang")))
    assert got[0][0] == ["go", "golang"] and got[1][0] == [] and not got[2][0]


def test_company_candidates(spark):
    ((got,),) = values(spark, [("Perfect Path, LLC, d/b/a Trajector Services",)], "n string", text.company_candidates(F.col("n")))
    assert got[0] == "Trajector Services" and "Perfect Path" in got


def test_cleaner(spark):
    ((got,),) = values(spark, [("<p>Hello&nbsp;<b>there</b></p><ul><li>**one**</li></ul># Head",)], "h string", text.clean_description(F.col("h")))
    assert "Hello there" in got and "one" in got and "<" not in got and "*" not in got


def test_years(spark):
    got = values(spark, [("data (2015-2020), java (2019-present)",), ("7+ years of experience",), ("none",)], "t string", text.max_years(F.col("t"), 2026), text.required_years(F.col("t")))
    assert got == [(7, 0), (7, 7), (0, 0)]


def test_sections(spark):
    jd = "about us. requirements: python. preferred: spark. bonus: go"
    ((need, wish),) = values(spark, [(jd,)], "t string", text.required_section(F.col("t")), text.preferred_section(F.col("t")))
    assert "python" in need and "spark" not in need and "spark" in wish


def test_mojibake(spark):
    got = values(spark, [("cafÃ©",), ("café",), (None,)], "t string", text.repaired(F.col("t")))
    assert [g[0] for g in got] == ["café", "café", None]


@pytest.mark.parametrize(("days", "label"), [(0, "Today"), (1, "1d"), (6, "6d"), (7, "1w"), (29, "4w"), (30, "1mo"), (61, "2mo"), (None, "?")])
def test_age_label(spark, days, label):
    assert values(spark, [(days,)], "d long", dates.age_label(F.col("d"))) == [(label,)]


def test_dates_of_many_formats(spark):
    rows = [("2024-03-05T00:00:00Z",), ("03/05/2024",), ("20240305",), ("1709596800",), ("1709596800000",), ("soon",)]
    got = [r[0] for r in values(spark, rows, "t string", dates.parsed(F.col("t")))]
    assert got == [datetime(2024, 3, 5)] * 5 + [None]


def test_money_and_bands(spark):
    rows = [(50.0, "hourly"), (2000.0, "weekly"), (10000.0, "monthly"), (130000.0, None)]
    assert [r[0] for r in values(spark, rows, "a double, p string", numbers.yearly(F.col("a"), F.col("p")))] == [104000, 104000, 120000, 130000]
    got = values(spark, [(95.0,), (40.0,), (None,)], "s double", screening.score_band(F.col("s")))
    assert [g[0] for g in got] == ["90-100", "40-49", None]


@pytest.mark.parametrize(
    ("text_", "low", "high"),
    [("$155,000 – $195,000", 155000, 195000), ("$150K-$200K", 150000, 200000), ("Base salary: $155K", 155000, 155000), ("$95/hr", 197600, 197600), ("up to $180K", 0, 180000), ("140,000 to 160,000", 140000, 160000), ("2019-2022", "none", None), ("5-9 years", "none", None), ("10-15 years", 20800, 31200), ("", "none", None), (None, "none", None)],
)
def test_salary(spark, text_, low, high):
    s = salary(F.col("t"))
    ((lo, hi),) = values(spark, [(text_,)], "t string", numbers.yearly(s["low"], s["period"]), numbers.yearly(s["high"], s["period"]))
    assert (lo, hi) == ((None, None) if low == "none" else (low, high))


def test_upsert_keeps_enrichment_and_first_seen(spark):
    store = spark.createDataFrame([("u", "old", 4.5, 1, 1), ("v", "v", None, 1, 1)], "url string, title string, rating double, first_seen int, last_seen int")
    batch = spark.createDataFrame([("u", "new", None), ("w", "w", 3.0)], "url string, title string, rating double")
    once = R.upsert(store, batch, "url", ["rating"], F.lit(9))
    want = {("u", "new", 4.5, 1, 9), ("v", "v", None, 1, 1), ("w", "w", 3.0, 9, 9)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in R.upsert(once, batch, "url", ["rating"], F.lit(9)).collect()} == want


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, None, 30), (4, None, 40)], "i int, k string, v int")
    assert {tuple(r) for r in R.keep_first(df, ["k"], "i").collect()} == {(1, "a", 10), (3, None, 30)}
    assert {tuple(r) for r in R.keep_last(df, ["k"], "i").collect()} == {(2, "a", 20), (4, None, 40)}


JOB = "id long, title string, company string, location string, description string, remote_type string, salary_min double, salary_max double, posted_date timestamp_ntz, clearance_required string, alignment_score double, applicant_count int, company_rating double"
GOOD = (1, "Data Engineer", "Acme", "Remote", "python and sql", "remote", 150000.0, 190000.0, datetime(2024, 5, 30), None, 80.0, 10, 4.5)


def changed(**kw):
    names = [c.split()[0] for c in JOB.split(", ")]
    return tuple(kw.get(n, v) for n, v in zip(names, GOOD))


@pytest.mark.parametrize(
    ("change", "gate", "outcome"),
    [
        ({}, None, "pass"),
        ({"title": "Account Executive"}, "0J_role", "fail"),
        ({"title": "Sales Engineer"}, "0J_role", "override_required"),
        ({"description": "a defense thing and bad phrase"}, "0G_red", "fail"),
        ({"company": "Raytheon Labs"}, "0B_defense", "fail"),
        ({"description": "requires TS/SCI"}, "0B_defense", "fail"),
        ({"clearance_required": "secret"}, "0B_defense", "fail"),
        ({"clearance_required": "required"}, None, "pass"),
        ({"description": "you know the cia here"}, "0B_defense", "fail"),
        ({"description": "we are special"}, None, "pass"),
        ({"company": "Best Staffing"}, "0C_staffing", "override_required"),
        ({"company": "Haystack News", "description": "c2c"}, None, "pass"),
        ({"posted_date": datetime(2024, 1, 1)}, "0D_ghost", "fail"),
        ({"applicant_count": 900}, "0D_ghost", "fail"),
        ({"description": "kubernetes required"}, "0E_stack", "fail"),
        ({"alignment_score": 30.0}, "0I_alignment", "fail"),
        ({"alignment_score": 50.0}, "0I_alignment", "override_required"),
        ({"alignment_score": None}, None, "pass"),
        ({"remote_type": "on_site", "location": "US"}, "0F_compensation", "fail"),
        ({"remote_type": "hybrid"}, "0F_compensation", "override_required"),
        ({"salary_max": 100000.0}, "0F_compensation", "fail"),
        ({"salary_max": 135000.0}, "0F_compensation", "override_required"),
        ({"salary_max": None, "salary_min": None}, None, "pass"),
        ({"company_rating": 3.0}, "culture", "fail"),
        ({"company_rating": 3.7}, "culture", "override_required"),
        ({"description": "after recent layoffs"}, "culture", "override_required"),
        ({"description": None, "company": None, "location": None, "title": None}, None, "pass"),
    ],
)
def test_gates(spark, change, gate, outcome):
    cfg = screening.GateConfig(AS_OF, red=("bad phrase",))
    (row,) = screening.screen(spark.createDataFrame([changed(**change)], JOB), cfg).collect()
    assert (row["stopped_by"], row["outcome"]) == (gate, outcome)
    assert len(row["verdicts"]) == ([n for n, _ in screening.GATES].index(gate) + 1 if gate else len(screening.GATES))


def test_override_continues_the_chain(spark):
    jobs = spark.createDataFrame([changed(remote_type="hybrid", company_rating=3.0)], JOB)
    granted = spark.createDataFrame([(1, "0F_compensation")], "id long, gate string")
    (row,) = screening.screen(jobs, screening.GateConfig(AS_OF), granted).collect()
    assert row["stopped_by"] == "culture"


@pytest.mark.parametrize(("overall", "gaps", "want"), [(70.0, 2, "PROCEED"), (70.0, 3, "FLAG"), (50.0, 9, "FLAG"), (20.0, 3, "FLAG"), (49.9, 4, "NO_PROCEED")])
def test_recommendation(spark, overall, gaps, want):
    assert values(spark, [(overall, gaps)], "o double, g int", scoring.recommendation(F.col("o"), F.col("g"))) == [(want,)]


def test_technical_share(spark):
    row = [(["python", "sql"], ["spark"])]
    ((got,),) = values(spark, row, "r array<string>, p array<string>", scoring.technical(F.col("r"), F.col("p"), F.array(F.lit("python"))))
    assert round(got, 4) == round(100 / 2.3, 4)
    ((none,),) = values(spark, [([], [])], "r array<string>, p array<string>", scoring.technical(F.col("r"), F.col("p"), F.array(F.lit("python"))))
    assert none == 50


def test_fuzzy():
    assert token_set_ratio("senior data engineer", "data engineer") == 100
    assert token_set_ratio("", "x") == 0 and token_set_ratio("a b", "b a") == 100
    assert greedy_pairs(["python", "sql", "python 2"], ["python 3", "python"], 0.8) == [("python", "python", 1.0), ("python 2", "python 3", 0.875)]


def test_traffic_light(spark):
    rows = [("a defense contractor",), ("remote first team",), ("fast paced, rock star",), ("nothing",), (None,)]
    got = values(spark, rows, "t string", screening.traffic_light(F.col("t"), ("remote first",), ("fast paced", "rock star"), ("defense contractor",)))
    assert [g[0] for g in got] == ["RED", "GREEN", "YELLOW", "NEUTRAL", "NEUTRAL"]


def test_sources(spark, tmp_path):
    (tmp_path / "board.json").write_text('{"board": "b", "jobs": [{"id": 1, "title": "T", "location": {"name": "X"}}]}')
    assert tables.board_snapshot(spark, str(tmp_path / "board.json")).select("board", "id", "title", "location.name").first()[:] == ("b", 1, "T", "X")
    page = '<html><script type="application/ld+json">{"@type": "JobPosting", "title": "Engineer", "hiringOrganization": {"name": "A"}}</script></html>'
    got = tables.job_postings_ld(spark.createDataFrame([(1, page), (2, "<p>")], "page_id int, html string")).collect()
    assert [(r["page_id"], r["job"]["title"], r["job"]["hiringOrganization"]["name"]) for r in got] == [(1, "Engineer", "A")]
    (tmp_path / "notes.md").write_text("# Top\n## One\nbody 1\n## Two\nbody 2\n")
    assert {tuple(r) for r in tables.sections(spark, str(tmp_path / "notes.md")).collect()} == {("One", "body 1"), ("Two", "body 2")}
    raw = spark.createDataFrame([("7", "", "Acme", "x")], "job_id string, title string, company_name string, odd string")
    got = tables.unified(raw).first()
    assert (got["id"], got["title"], got["company"], got["extras"]) == ("7", None, "Acme", {"odd": "x"})


def test_stream_merges_batches_once(spark, tmp_path):
    for i, rows in enumerate(([("u", 1, 5.0), ("v", 1, None)], [("u", 2, None), ("w", 2, 1.0)])):
        spark.createDataFrame(rows, "url string, seq int, rating double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.landing(spark, str(tmp_path / "in"), "url string, seq int, rating double")
        ingest.merge_batches(stream, str(tmp_path / "out"), "url", "seq", ["rating"], str(tmp_path / "ck")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/1")).select("url", "seq", "rating").collect()}
    assert got == {("u", 2, 5.0), ("v", 1, None), ("w", 2, 1.0)}


def test_top_k_ignores_input_order(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    top = lambda d: {tuple(r) for r in R.top_per_group(d, ["g"], [F.desc("v"), F.col("id")], 4).collect()}
    assert top(df) == top(df.repartition(5, "v"))
