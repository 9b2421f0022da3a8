"""Reports and rule ladders over the fixtures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import matching as M
from quillstone.operators import relational as R
from quillstone.operators import scoring as S
from quillstone.operators import screening as G
from quillstone.registry import query
from quillstone.sources.tables import POSTINGS_SQL, comment_header, postings

P = f"WITH p AS ({POSTINGS_SQL}) "


def _count(terms, c="lower(text)"):
    return " + ".join(f"CAST(contains({c}, '{t}') AS INT)" for t in terms)


@query("quality_gates_first_reason", "SELECT s_suppkey, CASE WHEN NOT coalesce(s_acctbal >= 0, false) THEN 'balance' WHEN NOT coalesce(s_nationkey < 20, false) THEN 'nation' END AS reason FROM supplier")
def quality_gates_first_reason(spark, read):
    return read("supplier").select("s_suppkey", M.first_failing([(F.col("s_acctbal") >= 0, "balance"), (F.col("s_nationkey") < 20, "nation")]).alias("reason"))


@query("company_tiers", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 1 WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'green') THEN 2 WHEN contains(lower(p_name), 'widget') THEN 3 ELSE 0 END AS tier FROM part")
def company_tiers(spark, read):
    return read("part").select("p_partkey", M.company_tier(F.col("p_name"), (("Red",), ("blue", "green"), ("widget",))).alias("tier"))


@query("salary_ladder", P + "SELECT id, CASE WHEN salary_max IS NULL AND salary_min IS NULL THEN 0.5 WHEN coalesce(salary_max, salary_min) >= 220000 THEN 1.0 WHEN coalesce(salary_max, salary_min) >= 200000 THEN 0.9 WHEN coalesce(salary_max, salary_min) >= 180000 THEN 0.8 WHEN coalesce(salary_max, salary_min) >= 150000 THEN 0.7 WHEN coalesce(salary_max, salary_min) >= 130000 THEN 0.6 ELSE 0.5 END AS score FROM p")
def salary_ladder(spark, read):
    return postings(spark, read).select("id", M.salary_ladder(F.col("salary_min"), F.col("salary_max"), 130000, (150000, 180000), 200000, 220000).cast("double").alias("score"))


@query("skills_authenticity", f"SELECT doc_id, round(greatest(0, least(1, ({_count(['tion', 'ment'])} + 0.5 * ({_count(['que', 'ung'])}) - CAST(contains(lower(text), 'required') AS INT) * (0.3 * ({_count(['der'])}) + 0.5 * ({_count(['the'])}))) / 10)), 4) AS score FROM documents")
def skills_authenticity(spark, read):
    return read("documents").select("doc_id", F.round(M.skills_authenticity(F.col("text"), ("tion", "ment"), ("que", "ung"), ("der",), ("the",)), 4).alias("score"))


@query("job_match", P + ", m AS (SELECT id, 0.3 * CASE WHEN contains(lower(title), 'data engineer') OR contains(lower(title), 'backend') THEN 1.0 ELSE least(len(list_intersect(list_distinct(string_split(lower(title), ' ')), ['backend', 'data', 'engineer'])) / 3, 1.0) END + 0.2 * CASE WHEN company = 'Supplier#1' THEN 1.0 WHEN regexp_matches(lower(company), 'tech|software|data') THEN 0.5 ELSE 0 END + 0.3 * least(0.7 * (" + _count(["the", "tion"], "lower(description)") + ") / 2 + 0.3 * (" + _count(["que"], "lower(description)") + ") / 1, 1.0) + 0.1 * CASE WHEN remote_type = 'remote' THEN 1.0 WHEN contains(location, 'NATION_1') THEN 0.7 ELSE 0.3 END + 0.1 * CASE WHEN salary_max >= 150000 THEN 1.0 WHEN salary_max >= 120000 THEN 0.7 WHEN salary_max IS NOT NULL THEN 0.3 ELSE 0.5 END AS x FROM p) SELECT id, round(x, 4) AS score, CASE WHEN round(x, 4) >= 0.8 THEN 'Excellent Match' WHEN round(x, 4) >= 0.7 THEN 'Good Match' WHEN round(x, 4) >= 0.6 THEN 'Fair Match' ELSE 'Poor Match' END AS level FROM m")
def job_match(spark, read):
    c = F.col
    m = M.job_match(c("title"), c("company"), c("description"), c("location"), c("remote_type") == "remote", c("salary_max"), ("data engineer", "backend"), ("Supplier#1",), ("the", "tion"), ("que",), 150000, ("NATION_1",))
    return postings(spark, read).select("id", m.alias("m")).select("id", "m.*")


@query("qualification", P + "SELECT id, round(0.35 * 0.5 + 0.25 * least(1.0, 8 / greatest(id % 12, 1)) + 0.25 * CASE WHEN salary_min IS NULL OR salary_max IS NULL THEN 0.6 WHEN salary_max >= 120000 AND salary_min <= 180000 THEN least(1.0, (least(salary_max, 180000) - greatest(salary_min, 120000)) / 60000) ELSE 0.3 END + 0.15 * 0.6, 3) AS score FROM p")
def qualification(spark, read):
    years = F.least(F.lit(1.0), 8 / F.greatest(F.col("id") % 12, F.lit(1)))
    q = M.qualification(F.lit(0.5), years, M.preference_salary(F.col("salary_min"), F.col("salary_max"), 120000, 180000), F.lit(0.6))
    return postings(spark, read).select("id", q.alias("score"))


@query("skill_sets", "SELECT doc_id, array_to_string(list_sort([x FOR x IN ['tion', 'ment', 'keit'] IF contains(lower(text), x) AND x NOT IN ('tion')]), ',') AS missing, array_to_string(list_sort([x FOR x IN ['tion', 'ment', 'keit'] IF contains(lower(text), x) AND x IN ('tion')]), ',') AS shared FROM documents")
def skill_sets(spark, read):
    have, want = F.array(F.lit("tion")), T.hits(F.lower("text"), ("tion", "ment", "keit"))
    return read("documents").select("doc_id", F.array_join(F.array_sort(F.array_except(want, have)), ",").alias("missing"), F.array_join(F.array_intersect(want, have), ",").alias("shared"))


@query("skill_gap_lists", "SELECT doc_id, CAST(contains(lower(text), 'ment') AS INT) + CAST(contains(lower(text), 'keit') AS INT) AS n_critical FROM documents")
def skill_gap_lists(spark, read):
    g = S.skill_gaps(T.hits(F.lower("text"), ("tion", "ment", "keit")), F.array(F.lit("que")), ("tion",))
    return read("documents").select("doc_id", F.size(g["critical"]).alias("n_critical"))


@query("skill_demand", "SELECT t AS skill, count(*) AS n FROM documents, unnest(['the', 'tion', 'que', 'ing', 'ung']) AS u(t) WHERE contains(lower(text), t) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def skill_demand(spark, read):
    each = read("documents").select(F.explode(T.hits(F.lower("text"), ("the", "tion", "que", "ing", "ung"), boundary_up_to=0)).alias("skill"))
    return each.groupBy("skill").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skill").limit(3)


@query("query_relevance", P + "SELECT id FROM p WHERE regexp_matches(lower(title || ' ' || left(description, 1000)), 'backend|lorem')")
def query_relevance(spark, read):
    return postings(spark, read).filter(M.query_relevant(F.col("title"), F.col("description"), "Backend x lorem")).select("id")


@query("include_exclude_target", P + "SELECT id FROM p WHERE company = 'Supplier#3' OR (regexp_matches(lower(title || ' ' || description), 'engineer') AND NOT regexp_matches(lower(title || ' ' || description), 'senior|manager'))")
def include_exclude_target(spark, read):
    return postings(spark, read).filter(M.wanted(F.col("title"), F.col("description"), F.col("company"), ("engineer",), ("senior", "manager"), ("Supplier#3",))).select("id")


@query("ignored_then_salary", P + "SELECT id FROM p WHERE NOT regexp_matches(lower(company), '[0-4]$') AND ((salary_min IS NULL AND salary_max IS NULL) OR coalesce(salary_max, salary_min) >= 140000) ORDER BY posted_date DESC NULLS LAST, id LIMIT 60")
def ignored_then_salary(spark, read):
    pay = (F.col("salary_min").isNull() & F.col("salary_max").isNull()) | (F.coalesce("salary_max", "salary_min") >= 140000)
    return postings(spark, read).filter(~F.lower("company").rlike("[0-4]$") & pay).orderBy(F.col("posted_date").desc_nulls_last(), "id").limit(60).select("id")


@query("ghost_summary", P + "SELECT count(*) FILTER (applicant_count > 500) AS flagged, count(*) AS total, array_to_string(list_slice(list_sort(list(id) FILTER (applicant_count > 500)), 1, 5), ',') AS first_ids FROM p")
def ghost_summary(spark, read):
    p = postings(spark, read).select("id", F.coalesce(F.col("applicant_count") > 500, F.lit(False)).alias("ghost"))
    first = p.filter("ghost").orderBy("id").limit(5).agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("first_ids"))
    return p.agg(F.count_if("ghost").alias("flagged"), F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(first))  # one row each


@query("priority_then_percent", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END DESC, o_orderkey % 100 DESC, o_orderkey LIMIT 30")
def priority_then_percent(spark, read):
    o = read("orders").withColumn("label", F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("% match")))
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    return o.orderBy(rank.desc(), F.regexp_extract("label", "([0-9]+)%", 1).cast("double").desc(), "o_orderkey").limit(30).select("o_orderkey")


@query("union_with_priority", "WITH u AS (SELECT c_nationkey AS k, 0 AS tier, c_custkey AS i FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_nationkey, 1, c_custkey FROM customer WHERE c_acctbal >= 9000), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, i) AS r FROM u) SELECT k, tier, i FROM r WHERE r = 1")
def union_with_priority(spark, read):
    c = read("customer")
    part = lambda f, tier: c.filter(f).select(F.col("c_nationkey").alias("k"), F.lit(tier).alias("tier"), F.col("c_custkey").alias("i"))
    both = R.union_all(part("c_acctbal < 0", 0), part("c_acctbal >= 9000", 1))
    return both.groupBy("k").agg(F.min(F.struct("tier", "i")).alias("b")).select("k", "b.*")


@query("quality_mean_of_means", "WITH t AS (SELECT o_orderstatus, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1) SELECT round(avg(m), 2) AS mean, sum(n)::BIGINT AS n FROM t")
def quality_mean_of_means(spark, read):
    t = read("orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    return t.agg(F.round(F.avg("m"), 2).alias("mean"), F.sum("n").alias("n"))


@query("run_performance", "SELECT event_type AS run_type, round(avg(value), 2) AS avg_value, round(max(value), 2) AS max_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def run_performance(spark, read):
    return read("events").groupBy(F.col("event_type").alias("run_type")).agg(F.round(F.avg("value"), 2).alias("avg_value"), F.round(F.max("value"), 2).alias("max_value"), F.count_distinct("user_id").alias("users"))


@query("gap_counter", "SELECT g AS gap, count(*) AS n FROM (SELECT unnest([o_orderstatus, o_orderpriority]) AS g FROM orders) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def gap_counter(spark, read):
    details = F.to_json(F.struct(F.array(F.struct(F.array("o_orderstatus", "o_orderpriority").alias("gaps"))).alias("categories")))
    parsed = read("orders").select(F.from_json(details, "categories array<struct<gaps: array<string>>>").alias("d"))
    each = parsed.select(F.explode("d.categories").alias("c")).select(F.explode("c.gaps").alias("gap"))
    return each.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gap").limit(5)


@query("search_effectiveness", "SELECT source AS keyword, lang AS place, count(*) AS searches, round(avg(n_chars), 1) AS avg_results, max(n_chars) AS most, CAST(sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM documents GROUP BY 1, 2")
def search_effectiveness(spark, read):
    return read("documents").groupBy(F.col("source").alias("keyword"), F.col("lang").alias("place")).agg(
        F.count(F.lit(1)).alias("searches"), F.round(F.avg("n_chars"), 1).alias("avg_results"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") > 1000).alias("good"))


@query("ewma_latency", "WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, value AS x FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, 0.9 * r.x + 0.1 * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, round(arg_max(x, i), 4) AS ewma FROM r GROUP BY 1")
def ewma_latency(spark, read):
    """A recurrence over each user's events: weights fall by 0.9 a step, so that it is a weighted sum by rank from the end."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    first = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read("events").select("user_id", "value", F.row_number().over(w).alias("back"), F.row_number().over(first).alias("i"))
    weight = F.pow(F.lit(0.9), F.col("back") - 1) * F.when(F.col("i") == 1, 1.0).otherwise(0.1)
    return e.groupBy("user_id").agg(F.round(F.sum(weight * F.col("value")), 4).alias("ewma"))


@query("contact_scores", "SELECT c_custkey, round(least(least((c_custkey % 7) / 10, 0.3) + CASE WHEN c_custkey % 3 = 0 THEN 0.25 WHEN c_custkey % 3 = 1 THEN 0.15 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.2 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 0.15 ELSE 0.1 END, 1.0), 4) AS score FROM customer")
def contact_scores(spark, read):
    title = F.when(F.col("c_custkey") % 3 == 0, "Director").when(F.col("c_custkey") % 3 == 1, "Senior Engineer").otherwise("Clerk")
    active = F.when(F.col("c_custkey") % 2 == 0, "3 hours ago").otherwise("1 day ago")
    score = M.contact_score(F.col("c_custkey") % 7, title, F.col("c_mktsegment") == "BUILDING", active, F.lit("acme"))
    return read("customer").select("c_custkey", F.round(score, 4).alias("score"))


@query("audiences", P + "SELECT id, CASE WHEN contains(lower(title), 'manager') THEN 'manager' WHEN regexp_matches(lower(title), 'engineer|analyst') THEN 'ic' WHEN regexp_matches(lower(description), '(^|[^a-z])(executive|strategic|org|organization|board)([^a-z]|$)') THEN 'vp' WHEN regexp_matches(lower(description), '(^|[^a-z])(mentor|lead|architect|staff|principal)([^a-z]|$)') THEN 'ic' ELSE 'manager' END AS audience FROM p")
def audiences(spark, read):
    return postings(spark, read).select("id", M.audience(F.col("title"), F.col("description")).alias("audience"))


@query("role_relevance", "SELECT d.doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(d.text), '[a-z]{3,}')), list_distinct(regexp_extract_all('the tion and der que', '[a-z]{3,}')))) + 2 * CAST(contains(lower(d.text), 'tion') AS INT) AS relevance FROM documents d ORDER BY relevance DESC, d.doc_id LIMIT 40")
def role_relevance(spark, read):
    r = M.role_relevance(F.col("text"), F.lit("the tion and der que"), ("tion", "kubernetes"))
    return read("documents").select("doc_id", r.cast("long").alias("relevance")).orderBy(F.desc("relevance"), "doc_id").limit(40)


SIGNALS = {"technical": ("tion", "ment"), "leadership": ("keit",), "domain": ("lorem",)}
DUTY_WEIGHTS = {"technical": 0.5, "leadership": 0.2, "domain": 0.1}


@query("duty_categories", "SELECT doc_id, round((0.5 * CASE WHEN n = 0 THEN 75 ELSE round(100 * least(1 / n, 1.0), 1) END + 0.2 * CASE WHEN contains(lower(text), 'keit') THEN 0 ELSE 75 END + 0.1 * 75) / 0.8, 3) AS pct FROM (SELECT *, " + _count(["tion", "ment"]) + " AS n FROM documents)")
def duty_categories(spark, read):
    return read("documents").select("doc_id", F.round(M.duty_categories(F.col("text"), "only tion here", SIGNALS, DUTY_WEIGHTS), 3).alias("pct"))


@query("platform_rules", r"SELECT page_id, CASE WHEN len([x FOR x IN string_split_regex(trim(html), '[ \t\r\n]+') IF x <> '']) > 300 THEN 'too_long,' ELSE '' END || 'html' AS violations FROM pages")
def platform_rules(spark, read):
    return read("pages").select("page_id", F.array_join(M.platform_violations(F.col("html"), False, 300, True), ",").alias("violations"))


AUDIT_SQL = """
WITH d AS (SELECT doc_id, lower(text) AS t, list_distinct(regexp_extract_all(text, '[$][0-9][0-9,.]*[KMkm]?|[0-9]+%')) AS f, list_distinct(regexp_extract_all(text, '(19|20)[0-9]{2}')) AS y FROM documents)
SELECT doc_id, CAST(greatest(0, 100 - 15 * (len([x FOR x IN f IF x NOT IN ('20%', '$5K')]) + CAST(contains(t, 'kubernetes') AS INT)) - 7 * len([x FOR x IN y IF x <> '2019'])) AS INT) AS score FROM d
"""


@query("authenticity_audit", AUDIT_SQL)
def authenticity_audit(spark, read):
    return read("documents").select("doc_id", M.authenticity(F.col("text"), F.lit("in 2019 I saved 20% and $5K"), ("kubernetes",)).alias("score"))


LETTER_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, text || list_extract([' I owned it, saved 40% and 7 hours in 2018', ' architected and spearheaded Azure Functions for 3 million, 9x', ' transformed 12,000 k with azure synapse since 2021', ''], CAST(doc_id % 4 + 1 AS INT)) AS text, doc_id % 3 AS k FROM documents),
m AS (SELECT *, lower(text) AS t, 'Data engineer: managed a platform, 40% faster, 12 people; updated reports with azure synapse.' AS r, regexp_extract_all(text, '(?i)\d[\d,.]* *(?:%|percent|x\b|\$[\d,]+|million|billion|k\b|hours?|days?|weeks?|minutes?|seconds?)') AS f, regexp_extract_all(text, '\b20\d{2}\b') AS y FROM d),
c AS (SELECT doc_id, len([x FOR x IN f IF len([n FOR n IN regexp_extract_all(x, '[0-9][0-9,.]*') IF contains(lower(r), n)]) = 0]) AS figures,
        list_concat(CASE WHEN contains(t, 'architected') THEN ['architected'] ELSE [] END, CASE WHEN contains(t, 'spearheaded') THEN ['spearheaded'] ELSE [] END,
          CASE WHEN contains(t, 'revolutionized') AND false THEN ['revolutionized'] ELSE [] END, CASE WHEN contains(t, 'single-handedly') THEN ['single-handedly'] ELSE [] END) AS scope,
        [x FOR x IN ['azure key vault', 'azure functions', 'azure cosmos db', 'azure databricks', 'azure machine learning'] IF contains(t, x)] AS tools,
        CASE WHEN k < 2 AND len([x FOR x IN y IF x < '2019']) > 0 THEN ['Acme'] ELSE [] END AS first, CASE WHEN k = 1 AND len([x FOR x IN y IF x < '2022']) > 0 THEN ['Late'] ELSE [] END AS second FROM m)
SELECT doc_id, CAST(greatest(100.0 - 15 * (figures + len(tools)) - 7 * (len(scope) + len(first) + len(second)), 0.0) AS DOUBLE) AS score, figures + len(tools) = 0 AS passed, CAST(figures AS INT) AS n_figures,
  array_to_string(scope, ',') AS scope, array_to_string(tools, ',') AS tools, array_to_string(list_concat(first, second), ',') AS employers FROM c
"""


QUALIFIED_SQL = P + r"""
, j AS (SELECT *, list_extract(['5+ years', 'leadership and 12 years', '', 'some'], CAST(id % 4 + 1 AS INT)) AS asked, CASE WHEN id % 3 = 0 THEN company || ' Software' ELSE company END AS firm, list_extract(['small', 'mid-size', 'large'], CAST(id % 3 + 1 AS INT)) AS size,
               list_extract(['seed', 'growth', 'public'], CAST(id % 3 + 1 AS INT)) AS stage, list_distinct(string_split(lower(left(description, 40)), ' ')) AS w, [x FOR x IN string_split(lower(left(description, 20)), ' ')] AS offers, lower(description) AS d FROM p),
s AS (SELECT id,
  least(1.0, 0.7 * CASE WHEN len(w) > 0 THEN len(list_intersect(w, ['the', 'que', 'der', 'data'])) / len(w) ELSE 1.0 END + 0.3 * 0.5) AS a,
  least(1.0, least(1.0, 8 / greatest(CASE id % 4 WHEN 0 THEN 5 WHEN 1 THEN 12 ELSE 0 END, 1)) * 0.4 + CASE WHEN regexp_matches(lower(firm), 'technology|tech|software|saas|startup') THEN 1.0 ELSE 0.7 END * 0.2
    + CASE WHEN contains(size, 'mid') OR contains(size, 'large') THEN 1.0 ELSE 0.6 END * 0.2 + CASE WHEN id % 4 = 1 THEN 0.3 ELSE 1.0 END * 0.2) AS b,
  least(1.0, CASE WHEN remote_type = 'remote' THEN 1.0 WHEN contains(location, 'NATION_1') THEN 0.8 ELSE 0.4 END * 0.4
    + CASE WHEN salary_min IS NULL OR salary_max IS NULL THEN 0.6 WHEN salary_max >= 120000 AND salary_min <= 180000 THEN least(1.0, (least(salary_max, 180000) - greatest(salary_min, 120000)) / 60000) ELSE 0.3 END * 0.35 + CASE WHEN stage IN ('growth') THEN 1.0 ELSE 0.7 END * 0.25) AS c,
  least(1.0, CASE WHEN contains(lower(title), 'data engineer') OR contains(lower(title), 'manager') THEN 1.0 ELSE 0.6 END * 0.4 + least(1.0, len([o FOR o IN offers IF contains(o, 'th') OR contains(o, 'en')]) / 2) * 0.35
    + least(1.0, 0.2 * (CAST(contains(d, 'learning') AS INT) + CAST(contains(d, 'development') AS INT) + CAST(contains(d, 'training') AS INT) + CAST(contains(d, 'new') AS INT) + CAST(contains(d, 'cutting-edge') AS INT) + CAST(contains(d, 'innovative') AS INT))) * 0.25) AS g FROM j),
q AS (SELECT id, round(0.35 * a + 0.25 * b + 0.25 * c + 0.15 * g, 3) AS score FROM s)
SELECT id, score, round(least(0.95, score + 0.1), 3) AS confidence FROM q WHERE score >= 0.6 ORDER BY score DESC, id
"""


@query("qualified_jobs", QUALIFIED_SQL)
def qualified_jobs(spark, read):
    """Postings by their qualification from four parts, those from 0.6 on, the best first; what postings lack comes by the id."""
    c = F.col
    pick = lambda k, *values: F.get(F.array(*map(F.lit, values)), (c("id") % k).cast("int"))
    start = lambda n: F.split(F.lower(F.substring("description", 1, n)), " ", -1)
    skills = M.qualification_skills(start(40), F.array().cast("array<string>"), ("the", "que", "der", "data"))
    firm = F.when(c("id") % 3 == 0, F.concat("company", F.lit(" Software"))).otherwise(c("company"))
    experience = M.qualification_experience(pick(4, "5+ years", "leadership and 12 years", "", "some"), firm, pick(3, "small", "mid-size", "large"), 8, ("mid", "large"), 0)
    preference = M.qualification_preference(c("remote_type") == "remote", c("location"), c("salary_min"), c("salary_max"), pick(3, "seed", "growth", "public"), True, ("NATION_1",), (120000, 180000), ("growth",))
    growth = M.qualification_growth(c("title"), start(20), c("description"), ("Data Engineer", "manager"), ("th", "en"))
    scored = postings(spark, read).select("id", M.qualification(skills, experience, preference, growth).alias("score"))
    return scored.filter("score >= 0.6").select("id", "score", F.round(F.least(F.lit(0.95), c("score") + 0.1), 3).alias("confidence")).orderBy(F.desc("score"), "id")


@query("letter_audit", LETTER_AUDIT_SQL)
def letter_audit(spark, read):
    """Letters made of the documents, with endings by the id, against one résumé and histories of employment."""
    ends = (" I owned it, saved 40% and 7 hours in 2018", " architected and spearheaded Azure Functions for 3 million, 9x", " transformed 12,000 k with azure synapse since 2021", "")
    letter = F.concat("text", F.get(F.array(*map(F.lit, ends)), (F.col("doc_id") % 4).cast("int")))
    job = lambda name, start: F.struct(F.lit(name).alias("employer"), F.lit(start).alias("start"))
    k = F.col("doc_id") % 3
    history = F.when(k == 0, F.array(job("Acme", "2019-05"))).when(k == 1, F.array(job("Acme", "2019-05"), job("Late", "2022"))).otherwise(F.array(job("None", "")))
    resume = F.lit("Data engineer: managed a platform, 40% faster, 12 people; updated reports with azure synapse.")
    found = read("documents").select("doc_id", M.audit(letter, resume, history).alias("a"))
    return found.select("doc_id", "a.score", "a.passed", F.size("a.figures").alias("n_figures"), *(F.array_join(f"a.{c}", ",").alias(c) for c in ("scope", "tools", "employers")))


INDICES_SQL = """
WITH c AS (SELECT CASE WHEN c_custkey % 9 > 0 THEN c_mktsegment END AS i, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS l, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 4 END AS r, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 50 END AS o FROM customer),
n AS (SELECT count(i) AS ni, count(l) AS nl, count(r) AS nr, count(o) AS no, count(DISTINCT i) AS gi, count(DISTINCT l) AS gl, count(DISTINCT r) AS gr, count(*) AS n FROM c),
s AS (SELECT *, ni / (ni + nl + nr + no) AS a, nl / (ni + nl + nr + no) AS b, nr / (ni + nl + nr + no) AS c, no / (ni + nl + nr + no) AS d, round(gi / greatest(ni, 1) * 0.4 + gl / greatest(nl, 1) * 0.3 + gr / greatest(nr, 1) * 0.3, 3) AS v FROM n)
SELECT round(a, 3) AS industry_strength, round(b, 3) AS location_strength, round(c, 3) AS role_strength, round(d, 3) AS company_strength, round(a * 0.3 + b * 0.2 + c * 0.25 + d * 0.25, 3) AS overall_strength, v AS diversity,
  round(CASE WHEN n <= 100 THEN 0.5 WHEN n <= 500 THEN 0.75 WHEN n <= 1000 THEN 0.9 ELSE 1.0 END * 0.4 + 40 / n * 0.3 + v * 0.3, 3) AS reach FROM s
"""


@query("network_indices", INDICES_SQL)
def network_indices(spark, read):
    """Strength, diversity and reach of all customers as contacts; some values are missing by the key."""
    key = F.col("c_custkey")
    some = lambda k, c: F.when(key % k > 0, c)
    contacts = read("customer").select(some(9, F.col("c_mktsegment")).alias("i"), some(7, F.col("c_nationkey")).alias("l"), some(5, key % 4).alias("r"), some(3, key % 50).alias("o"))
    return M.network_indices(contacts, "i", "l", "r", "o", 40)


@query("enrichment", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END, n_nationkey * 1.0) AS balance, CASE WHEN length(n_name) > length('x') THEN n_name ELSE 'x' END AS note FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def enrichment(spark, read):
    s = read("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("balance"), F.lit("x").alias("note"))
    n = read("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * F.lit(1.0)).alias("balance"), F.col("n_name").alias("note"))
    return M.enriched(s, n, "k", ["balance"], ["note"]).select("s_suppkey", "balance", "note")


@query("rating_lookup", "SELECT s_suppkey, n_name AS found_n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def rating_lookup(spark, read):
    s = read("supplier").withColumn("names", F.array(F.lit("nobody"), F.concat(F.lit("Nation_"), F.col("s_nationkey").cast("string"))))
    return M.lookup_by_candidates(s, F.col("names"), read("nation"), "n_name", ["n_name"], "s_suppkey").select("s_suppkey", "found_n_name")


@query("reference_resolution", "SELECT c_custkey, n_name AS resolved FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def reference_resolution(spark, read):
    return M.resolve_references(read("customer").withColumnRenamed("c_nationkey", "ref"), read("nation"), "ref", "n_nationkey", "n_name").select("c_custkey", "resolved")


@query("comment_headers", "SELECT o_orderkey, 'Acme' AS company, o_orderstatus AS role, 'Remote' AS place FROM orders")
def comment_headers(spark, read):
    """Another name for comment_headers_all."""
    return comment_headers_all(spark, read)


@query("comment_headers_all", "SELECT o_orderkey, 'Acme' AS company, o_orderstatus AS role, 'Remote' AS place FROM orders")
def comment_headers_all(spark, read):
    return _headers(read("orders"))


def _headers(orders):
    o = orders.withColumn("text", F.concat(F.lit("Acme | "), F.col("o_orderstatus"), F.lit(" | Remote\nbody")))
    return o.select("o_orderkey", comment_header("text").alias("h")).select("o_orderkey", "h.*")


@query("history_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 5 DAY ORDER BY ts DESC, event_id LIMIT 100")
def history_filter(spark, read):
    since = F.lit(datetime(2024, 1, 30)).cast("timestamp_ntz") - F.make_dt_interval(F.lit(5))
    return read("events").filter((F.col("event_type") == "purchase") & (F.col("ts") >= since)).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type")


@query("keyword_profile_lights", "SELECT CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])moron([^a-z0-9]|$)') THEN 'RED' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])der([^a-z0-9]|$)') THEN 'GREEN' ELSE 'NEUTRAL' END AS light, count(*) AS n FROM documents GROUP BY 1")
def keyword_profile_lights(spark, read):
    return read("documents").groupBy(G.traffic_light(F.col("text"), ("der",), (), ("moron",)).alias("light")).agg(F.count(F.lit(1)).alias("n"))


@query("growth_forecast", "SELECT c_custkey, round(c_acctbal * pow(1 + 0.02 * 1.3, 6), 4) AS grown FROM customer")
def growth_forecast(spark, read):
    return read("customer").select("c_custkey", S.growth(F.col("c_acctbal"), 6, F.lit(0.02), 1.3).alias("grown"))


@query("confidence_interval", "SELECT event_type, round(greatest(avg(value) * (1 - 1.96 * 0.05), 0), 4) AS low, round(avg(value) * (1 + 1.96 * 0.05), 4) AS high FROM events GROUP BY 1")
def confidence_interval(spark, read):
    m = read("events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return m.select("event_type", F.round(F.greatest(F.col("m") * (1 - 1.96 * 0.05), F.lit(0.0)), 4).alias("low"), F.round(F.col("m") * (1 + 1.96 * 0.05), 4).alias("high"))
