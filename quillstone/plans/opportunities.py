"""Scores of opportunities and companies, and checks of generated documents, for every posting or supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import extract as X
from quillstone.functions.text import once
from quillstone.operators import opportunity as O
from quillstone.operators import screening as G
from quillstone.registry import query
from quillstone.sources.tables import POSTINGS_SQL, postings

P = f"WITH p AS ({POSTINGS_SQL}) "
WISHES = O.Wishes(
    ignored=("supplier#3",), tiers=(("Supplier#1",), ("Supplier#2",), ("Supplier#4",)), core=("tion", "ment"), secondary=("que",), gaps=("der",), excluded=("the",),
    industries=("nation", "keit", "data"), avoided_industries=("worthless",), places=("nation_2",), terms=("data engineer", "analyst"), avoided_skills=("que",),
)
PERSON = O.Person("senior data engineer", 6, primary=("tion", "ment"), secondary=("keit",), technologies=("ing", "tion"), certifications=("que",))


def _n(text: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{t}') AS INT)" for t in terms) + ")"


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


SCORE_SQL = P + f"""
, a AS (SELECT *, lower(company) AS c, lower(title) AS t, lower(description) AS d, lower(trim(title)) || ' ' || lower(trim(description)) || ' ' || lower(trim(location)) AS x FROM p),
b AS (SELECT id, c,
   0.35 * CASE WHEN contains(c, 'supplier#1') THEN 1 / 3.0 WHEN contains(c, 'supplier#2') THEN 2 / 3.0 WHEN contains(c, 'supplier#4') THEN 1.0 ELSE 0.4 END
 + 0.25 * CASE WHEN salary_max IS NULL THEN 0 WHEN salary_max >= 180000 THEN 1.0 ELSE 0.5 END
 + 0.20 * greatest(0.0, least(1.0, ({_n('d', ('tion', 'ment'))} + 0.5 * {_n('d', ('que',))} - CAST(contains(d, 'required') AS INT) * (0.3 * {_n('d', ('der',))} + 0.5 * {_n('d', ('the',))})) / 10))
 + 0.10 * CASE WHEN contains(t, 'principal') OR contains(t, 'architect') THEN 1.0 WHEN contains(t, 'staff') OR contains(t, 'senior') THEN 0.9 WHEN contains(t, 'manager') OR contains(t, 'lead') THEN 0.7 ELSE 0.5 END
 + 0.10 * {_n('x', ('nation', 'keit', 'data'))} / 3 * CASE WHEN contains(x, 'worthless') THEN 0.5 ELSE 1 END AS s FROM a)
SELECT id, round(CASE WHEN contains(c, 'supplier#3') THEN 0 ELSE least(s, 1.0) END, 6) AS score FROM b
"""


@query("opportunity_scores", SCORE_SQL)
def opportunity_scores(spark, read):
    salary = F.when(F.col("salary_max").isNotNull(), F.when(F.col("salary_max") >= 180000, 1.0).otherwise(0.5))
    score = O.opportunity_score(F.col("company"), F.col("title"), F.col("description"), F.col("location"), salary, WISHES)
    return postings(spark, read).select("id", F.round(score, 6).alias("score"))


PROFILE_SQL = P + f"""
, a AS (SELECT *, lower(title) AS t, lower(description) AS d, lower(location) AS l FROM p),
b AS (SELECT id, company, l, salary_max,
   greatest(0.0, least(1.0, CASE WHEN contains(t, 'data engineer') OR contains(t, 'analyst') THEN 0.6 WHEN contains(t, 'data') OR contains(t, 'engineer') THEN 0.4 ELSE 0 END
     + CASE WHEN contains(t, 'senior') OR contains(t, 'lead') OR contains(t, 'staff') OR contains(t, 'principal') THEN 0.3 WHEN contains(t, 'jr') OR contains(t, 'junior') OR contains(t, 'entry') THEN -0.2 ELSE 0 END
     + 0.05 * len(list_intersect(list_distinct(string_split(t, ' ')), ['senior', 'data', 'engineer'])))) AS title_score,
   greatest(0.0, least(1.0, 0.15 * CAST(contains(d, 'tion') AS INT) + 0.3 * CAST(contains(d, 'ment') AS INT) + 0.2 * CAST(contains(d, 'keit') AS INT) + 0.15 * CAST(contains(d, 'ing') AS INT) + 0.25 * CAST(contains(d, 'que') AS INT)
     + CASE WHEN {_n('d', ('tion', 'ment', 'keit', 'ing', 'que'))} >= 5 THEN 0.15 WHEN {_n('d', ('tion', 'ment', 'keit', 'ing', 'que'))} >= 3 THEN 0.10 ELSE 0 END
     - 0.1 * CAST(contains(d, 'que') AS INT) + 0.05 * {_n('d', O.CURRENT)})) AS skill_score FROM a)
SELECT id, CAST(round(title_score, 6) AS DOUBLE) AS title_score, CAST(round(skill_score, 6) AS DOUBLE) AS skill_score,
       CAST(round(least(1.0, CASE WHEN company = 'Supplier#1' THEN 0.25 ELSE 0.08 END + 0.20 * CASE WHEN salary_max >= 150000 THEN 1.0 ELSE 0.5 END + 0.20 * title_score + 0.25 * skill_score
         + 0.10 * CASE WHEN contains(l, 'remote') THEN 0.8 WHEN contains(l, 'nation_2') THEN 0.6 ELSE 0.3 END), 6) AS DOUBLE) AS score FROM b
"""


@query("profile_scores", PROFILE_SQL)
def profile_scores(spark, read):
    title, text = F.col("title"), F.col("description")
    salary = F.when(F.col("salary_max") >= 150000, 1.0).otherwise(0.5)
    score = O.profile_score(title, text, F.col("location"), F.col("company") == "Supplier#1", salary, PERSON, WISHES)
    return postings(spark, read).select("id", F.round(O.title_relevance(title, PERSON, WISHES.terms), 6).alias("title_score"), F.round(O.skills_match(text, PERSON, WISHES.avoided_skills), 6).alias("skill_score"), F.round(score, 6).alias("score"))


_STARS = "CASE WHEN {0} >= 4.5 THEN 85 WHEN {0} >= 3.8 THEN 72 WHEN {0} >= 3.0 THEN 57 WHEN {0} >= 2.5 THEN 42 ELSE 25 END"
_LABEL = "CASE WHEN {0} >= 4.5 THEN 'Excellent' WHEN {0} >= 3.8 THEN 'Good' WHEN {0} >= 3.0 THEN 'Average' WHEN {0} >= 2.5 THEN 'Below Average' ELSE 'Poor' END"
COMPANY_SQL = f"""
WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 7 % 51 AS DOUBLE) / 10 AS rating, s_suppkey * 3 % 70 AS reviews, s_suppkey * 11 % 101 AS approval, CAST(s_suppkey * 13 % 51 AS DOUBLE) / 10 AS wlb FROM supplier),
c AS (SELECT *, CASE WHEN rating = 0 AND reviews = 0 THEN 0 ELSE greatest(0, least(100, {_STARS.format('rating')} + CASE WHEN reviews >= 50 THEN 5 WHEN reviews >= 20 THEN 0 ELSE -5 END + CASE WHEN approval >= 80 THEN 5 WHEN approval >= 65 THEN 0 ELSE -5 END)) END AS culture,
        CASE WHEN rating = 0 AND reviews = 0 THEN 'Unknown' ELSE {_LABEL.format('rating')} END AS culture_label,
        CASE WHEN wlb = 0 THEN 0 ELSE {_STARS.format('wlb')} END AS balance, CASE WHEN wlb = 0 THEN 'Unknown' ELSE {_LABEL.format('wlb')} END AS balance_label FROM s)
SELECT s_suppkey, CAST(culture AS INT) AS culture, culture_label, CAST(balance AS INT) AS balance, balance_label,
       CASE WHEN culture = 0 AND balance = 0 THEN 'UNKNOWN' WHEN s_suppkey % 3 = 0 THEN CASE WHEN culture + balance >= 140 THEN 'MODERATE (layoff concerns)' WHEN culture + balance >= 100 THEN 'MODERATE-HIGH (layoff + culture concerns)' ELSE 'HIGH (layoff + poor culture)' END
            WHEN culture + balance >= 140 THEN 'LOW' WHEN culture + balance >= 100 THEN 'MODERATE' WHEN culture + balance >= 70 THEN 'MODERATE-HIGH' ELSE 'HIGH' END AS risk FROM c
"""


@query("company_scores", COMPANY_SQL)
def company_scores(spark, read):
    k = F.col("s_suppkey")
    culture = O.culture_score((k * 7 % 51).cast("double") / 10, k * 3 % 70, k * 11 % 101)
    balance = O.balance_score((k * 13 % 51).cast("double") / 10)
    out = read("supplier").select("s_suppkey", culture.alias("c"), balance.alias("b"))
    risk = O.risk_level(F.col("c.score"), F.col("b.score"), k % 3 == 0)
    return out.select("s_suppkey", F.col("c.score").alias("culture"), F.col("c.label").alias("culture_label"), F.col("b.score").alias("balance"), F.col("b.label").alias("balance_label"), risk.alias("risk"))


TIERS = ("red", "green"), ("blue",), ("widget", "small"), ("small red",)
TIER_SQL = "SELECT p_partkey, CASE WHEN t = 'small red' THEN 'TIER2_EXCEPTION' WHEN t IN ('widget', 'small') THEN 'TIER3' WHEN t IN ('red', 'green') THEN 'TIER1' WHEN t = 'blue' THEN 'TIER2' ELSE 'UNKNOWN' END AS tier FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'small red' WHEN 1 THEN 'widget' WHEN 2 THEN 'red' WHEN 3 THEN 'blue' WHEN 4 THEN 'small' ELSE lower(p_name) END AS t FROM part)"


@query("tool_tiers", TIER_SQL)
def tool_tiers(spark, read):
    k = F.col("p_partkey") % 6
    tool = F.when(k == 0, " Small Red ").when(k == 1, "Widget").when(k == 2, "RED").when(k == 3, "blue").when(k == 4, "small").otherwise(F.col("p_name"))
    return read("part").select("p_partkey", O.tool_tier(tool, *TIERS[:3], TIERS[3]).alias("tier"))


ACHIEVEMENT_SQL = """
WITH bank AS (SELECT p_partkey AS id, 'cat' || (p_partkey % 7) AS category, 50 + p_partkey * 11 % 50 AS coverage, ['t' || (p_partkey % 3), 't' || (p_partkey % 5)] AS tools FROM part WHERE p_partkey % 10 <> 0),
jobs AS (SELECT s_suppkey AS job_id, 'cat' || (s_suppkey % 7) AS category, ['t' || (s_suppkey % 4), 't1'] AS tools FROM supplier),
s AS (SELECT job_id, id, coverage + 5 * len(list_intersect(bank.tools, jobs.tools)) AS score FROM jobs JOIN bank USING (category) WHERE coverage >= 65),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, id) AS rank FROM s)
SELECT job_id, CAST(rank AS INT) AS rank, id, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 4
"""


@query("selected_achievements", ACHIEVEMENT_SQL)
def selected_achievements(spark, read):
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    name = lambda label, c: F.concat(F.lit(label), c.cast("string"))
    bank = read("part").select(p.alias("id"), name("cat", p % 7).alias("category"), (50 + p * 11 % 50).alias("coverage"), F.array(name("t", p % 3), name("t", p % 5)).alias("tools"), (p % 10 == 0).alias("blocked"))
    jobs = read("supplier").select(s.alias("job_id"), name("cat", s % 7).alias("category"), F.array(name("T", s % 4), F.lit("T1")).alias("tools"))
    return O.select_achievements(bank, jobs).withColumn("score", F.col("score").cast("double"))


LETTER = "CASE id % 3 WHEN 0 THEN concat('Dear ', upper(company), ', I want to be your ', title) WHEN 1 THEN concat('Dear team at ', company) ELSE 'Dear all' END"
KINDS = ("Remote", "On-Site", "hybrid", "unknown", "in office")
CHECKS_SQL = P + f"""
, a AS (SELECT *, list_element({list(KINDS)}, CAST(id % 5 + 1 AS BIGINT)) AS kind FROM p)
SELECT id, concat_ws(',', CASE WHEN id % 3 <> 0 THEN 'company_and_role' END, CASE WHEN alignment_score < 60 THEN 'alignment' END, CASE WHEN salary_min < 130000 THEN 'salary_floor' END,
       CASE WHEN kind IN ('On-Site', 'in office') AND NOT contains(lower(location), 'remote') THEN 'remote' END,
       CASE WHEN length(description) < 200 OR {" OR ".join(f"regexp_matches(lower(description), '{x}')" for x in G.GHOST_PATTERNS)} THEN 'description' END,
       CASE WHEN contains(lower(company), 'supplier#2') THEN 'not_excluded' END) AS failed FROM a
"""


@query("job_checks", CHECKS_SQL)
def job_checks(spark, read):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 5 + 1).cast("int"))
    c = F.col
    checks = O.job_checks(c("company"), c("title"), F.expr(LETTER), c("description"), c("alignment_score"), c("salary_min"), kind, c("location"), ("supplier#2",))
    return postings(spark, read).select("id", F.array_join(F.transform(F.filter(checks, lambda x: ~x["passed"]), lambda x: x["name"]), ",").alias("failed"))


OUTPUT = "CASE id % 4 WHEN 0 THEN concat('Ann Smith 10001 ann@x.example site/ann knows Spark and C# ', title) WHEN 1 THEN concat('ANN SMITH 10002 sparked ', title) WHEN 2 THEN '' ELSE 'Ann Smith 10001 ann@x.example site/ann' END"
OUTPUT_SQL = P + """
SELECT id, CASE id % 4 WHEN 0 THEN 'tool: spark' WHEN 1 THEN 'wrong postcode' WHEN 2 THEN 'empty' ELSE '' END AS fabrication,
       concat_ws(',', CASE WHEN id % 4 = 1 THEN 'missing name,missing postcode,missing email,missing link' END, CASE WHEN id % 4 <> 2 AND alignment_score < 72 THEN 'score' END) AS warnings,
       id % 4 <> 2 AND coalesce(alignment_score < 72, false) AS degraded FROM p
"""


@query("output_checks", OUTPUT_SQL)
def output_checks(spark, read):
    v = O.validate_output(F.expr(OUTPUT), ("spark", "hive"), "Ann Smith", "10001", "10002", "ann@x.example", "site/ann", F.col("alignment_score"), F.lit(80.0))
    return postings(spark, read).select("id", v.alias("v")).select("id", F.array_join("v.fabrication", ",").alias("fabrication"), F.array_join("v.warnings", ",").alias("warnings"), F.col("v.degraded").alias("degraded"))


LIGHT_SQL = P + f"SELECT id, CASE WHEN {_any('lower(description)', G.CLEARANCE_KEYWORDS)} OR contains(lower(company), 'supplier#5') THEN least(alignment_score, 25.0) ELSE alignment_score END AS score FROM p WHERE alignment_score IS NOT NULL"


@query("light_defense_check", LIGHT_SQL)
def light_defense_check(spark, read):
    p = postings(spark, read).filter("alignment_score is not null")
    return p.select("id", O.light_defense_check(F.col("description"), F.col("company"), (*G.DEFENSE_PRIMES, "supplier#5"), G.CLEARANCE_KEYWORDS, F.col("alignment_score")).alias("score"))


SUPPLEMENT_SQL = P + "SELECT id, CASE WHEN id % 3 = 0 THEN 'sql' WHEN id % 3 = 1 AND length(description) > 1000 THEN 'python,sql' ELSE CASE WHEN id % 3 = 1 THEN 'python' ELSE 'a,b,c,d' END END AS skills FROM p"


@query("supplemented_skills", SUPPLEMENT_SQL)
def supplemented_skills(spark, read):
    """What a model's cache holds is made from the id: nothing, one skill, or four."""
    cached = F.when(F.col("id") % 3 == 1, F.array(F.lit("python"))).when(F.col("id") % 3 == 2, F.array(*map(F.lit, "abcd")))
    return postings(spark, read).select("id", F.array_join(O.supplemented(cached, F.col("description"), F.array(F.lit("sql"))), ",").alias("skills"))


@query("merged_weights", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0.3 ELSE 0.2 END AS DOUBLE) AS a, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0.15 ELSE 0.0 END AS DOUBLE) AS b FROM part")
def merged_weights(spark, read):
    """Later maps win; a key that none has gets the default."""
    first = F.create_map(F.lit("a"), F.lit(0.2))
    second = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("a"), F.lit(0.3), F.lit("b"), F.lit(0.15))).otherwise(F.create_map().cast("map<string,double>"))
    m = O.merged({"first": first, "second": second})
    return read("part").select("p_partkey", *(F.coalesce(F.element_at(m, k), F.lit(0.0)).alias(k) for k in "ab"))


@query("union_distinct", P + "SELECT lower(title) || '_' || lower(company) AS key, min(id) AS id FROM p GROUP BY 1")
def union_distinct(spark, read):
    """Postings of two origins in one list, one for each title and company whatever their case: the smallest id."""
    p = postings(spark, read).withColumn("key", F.concat_ws("_", F.lower("title"), F.lower("company")))
    both = p.filter("id % 2 = 0").select("key", "id").unionByName(p.filter("id % 2 = 1").select("key", "id"))
    return both.groupBy("key").agg(F.min("id").alias("id"))


@query("any_value_rollup", "SELECT user_id, event_type, count(*) AS n, 'e:' || event_type AS label FROM events GROUP BY user_id, event_type")
def any_value_rollup(spark, read):
    """An arbitrary row's value where all rows of the group agree."""
    e = read("events").withColumn("label", F.concat(F.lit("e:"), "event_type"))
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.any_value("label").alias("label"))


@query("repost_gaps", P + "SELECT id, CAST(id % 97 AS DOUBLE) AS gap_days, CAST(id % 97 AS DOUBLE) / 30 AS gap_months FROM p")
def repost_gaps(spark, read):
    """Days between two epochs in milliseconds, and months of 30 days."""
    first = F.unix_millis(F.col("posted_date").cast("timestamp"))
    gap = F.abs(first - (first + (F.col("id") % 97) * 86_400_000)) / 86_400_000
    return postings(spark, read).select("id", gap.alias("gap_days"), (gap / 30).alias("gap_months"))


@query("title_prefilter", P + "SELECT id FROM p WHERE regexp_matches(lower(title), 'engineer|analyst')")
def title_prefilter(spark, read):
    return postings(spark, read).filter(F.lower("title").rlike("engineer|analyst")).select("id")


GENERATED = (
    "CASE id % 6 WHEN 0 THEN 'Ann Smith worked at Acorn and Birch, using python' WHEN 1 THEN 'John Doe at Acorn and Birch' WHEN 2 THEN 'Smith at Acorn: proficient in kafka, Birch' "
    "WHEN 3 THEN 'Ann Smith, Acorn, Birch. No experience with kafka yet' WHEN 4 THEN 'Ann Smith at Acorn only' ELSE 'Smith, Acorn, Birch. Skills: python, airflow' END"
)
AUTHENTIC_SQL = P + """
SELECT id, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'name,john doe' WHEN 2 THEN 'claimed: kafka' WHEN 3 THEN '' WHEN 4 THEN 'companies' ELSE 'claimed: airflow' END AS issues,
       CAST(CASE id % 6 WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0.3 ELSE 0 END AS DOUBLE) AS confidence FROM p
"""


@query("authentic_outputs", AUTHENTIC_SQL)
def authentic_outputs(spark, read):
    """Six kinds of generated resumes, held against one whose table marks kafka, airflow and dagster as not found."""
    missing = X.missing_skills(F.lit("| Kafka | ❌ NOT FOUND |\n| Airflow / Dagster | NOT FOUND |\n| Python | found |"))
    found = once(F.struct(F.expr(GENERATED).alias("text"), missing.alias("missing")), lambda x: O.authentic_output(x["text"], F.lit("Ann Smith"), F.array(F.lit("Acorn"), F.lit("Birch")), x["missing"]))
    return postings(spark, read).select("id", found.alias("f")).select("id", F.array_join("f.issues", ",").alias("issues"), F.col("f.confidence").alias("confidence"))


MISSING_SQL = "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'bigquery,google cloud,' || lower(s_name) WHEN 1 THEN 'prefect,s' || s_suppkey || ' tools' WHEN 2 THEN '' ELSE 'spark' END AS skills FROM supplier"


@query("missing_skills", MISSING_SQL)
def missing_skills(spark, read):
    s, k = F.col("s_name"), F.col("s_suppkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Intro\n| **"), s, F.lit("** | ❌ NOT FOUND |\n| Google Cloud (BigQuery, GK) | NOT FOUND |")))
        .when(k == 1, F.concat(F.lit("|S"), F.col("s_suppkey").cast("string"), F.lit(" tools / Prefect / ab | NOT FOUND |\nNOT FOUND without a table")))
        .when(k == 2, F.lit("| NOT FOUND | x |\n| a name that is much too long to be the name of a skill | NOT FOUND |"))
        .otherwise(F.lit("| `Spark` | NOT FOUND |\n| spark | NOT FOUND |"))
    )
    return read("supplier").select("s_suppkey", F.array_join(X.missing_skills(text), ",").alias("skills"))


SIMPLE_SQL = P + f"SELECT id, CAST(round(least(0.2 * {_n('lower(title)', ('data', 'engineer'))} + 0.1 * {_n('lower(description)', ('data', 'engineer'))}, 0.9), 6) AS DOUBLE) AS score FROM p"


@query("simple_matches", SIMPLE_SQL)
def simple_matches(spark, read):
    return postings(spark, read).select("id", F.round(O.simple_match(F.col("title"), F.col("description"), ("Data", "Engineer")), 6).alias("score"))


TOY_SQL = P + "SELECT id, CASE id % 3 WHEN 0 THEN 'Town, VA' WHEN 1 THEN 'Remote' END AS place, CASE id % 3 WHEN 0 THEN '$' || (100 + id % 50) || ',000 - $' || (200 + id % 50) || ',000' WHEN 1 THEN '90-120k' ELSE 'Not specified' END AS salary FROM p"


@query("toy_extractors", TOY_SQL)
def toy_extractors(spark, read):
    i = F.col("id")
    figure = lambda k: F.concat(F.lit("$"), (k + i % 50).cast("string"), F.lit(",000"))
    text = F.when(i % 3 == 0, F.concat(F.lit("We sit in Town, VA and pay "), figure(100), F.lit(" - "), figure(200))).when(i % 3 == 1, F.lit("Remote work, 90-120k")).otherwise("nothing said")
    return postings(spark, read).select("id", X.first_match(text, X.PLACES).alias("place"), X.first_match(text, X.SALARY_TEXTS, "Not specified").alias("salary"))
