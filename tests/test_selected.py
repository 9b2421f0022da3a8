"""Achievements picked for jobs, against a plain search, and how many pairs that takes."""

from pyspark.sql import functions as F

from quillstone.operators import opportunity as O

BANK = "id long, category string, coverage long, tools array<string>, blocked boolean"


def test_selected_achievements_are_the_plain_ones(spark):
    bank = [(i, f"c{i % 3}", 60 + i * 7 % 20, [f"t{i % 2}", f"t{i % 5}"], i % 11 == 0) for i in range(300)]
    jobs = [(j, f"c{j % 4}", [f"T{j % 3}", "t1"] if j % 5 else None) for j in range(40)] + [(7, "c0", ["t0"])]
    want = {}
    for j, category, tools in jobs:
        for i, c, coverage, has, blocked in bank:
            if c == category and not blocked and coverage >= 65:
                score = None if tools is None else coverage + 5 * len({t.lower() for t in tools} & set(has))
                want.setdefault(j, []).append((score is None, -(score or 0), i))
    want = {(j, r, i, None if none else -s) for j, found in want.items() for r, (none, s, i) in enumerate(sorted(found)[:4], 1)}
    got = O.select_achievements(spark.createDataFrame(bank, BANK), spark.createDataFrame(jobs, "job_id long, category string, tools array<string>"))
    assert {tuple(r) for r in got.select("job_id", "rank", "id", "score").collect()} == want


def test_alike_jobs_and_achievements_are_held_against_each_other_once(spark):
    """20,000 achievements of two kinds and 20,000 jobs of one kind: some 4e8 pairs if each were held against each."""
    bank = spark.range(20_000).select("id", F.lit("c").alias("category"), F.lit(70).alias("coverage"), F.array(F.concat(F.lit("t"), (F.col("id") % 2).cast("string"))).alias("tools"), F.lit(False).alias("blocked"))
    jobs = spark.range(20_000).select(F.col("id").alias("job_id"), F.lit("c").alias("category"), F.array(F.lit("T1")).alias("tools"))
    seen = spark.sparkContext.accumulator(0)
    keep, O.F.size = O.F.size, lambda c: keep(F.udf(lambda x: seen.add(1) or x, "array<string>")(c))
    try:
        got = O.select_achievements(bank, jobs).groupBy("rank", "id").count().collect()
    finally:
        O.F.size = keep
    assert {tuple(r) for r in got} == {(k, 2 * k - 1, 20_000) for k in range(1, 5)} and 0 < seen.value < 100
