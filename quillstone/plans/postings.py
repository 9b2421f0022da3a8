"""Screening, scoring and classification of the postings view."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.dates import age_days, age_label
from quillstone.functions.numbers import interval_overlap, yearly
from quillstone.operators import scoring as S
from quillstone.operators import screening as G
from quillstone.operators.filters import JobList, JobQuery
from quillstone.operators.salary import salary
from quillstone.registry import query
from quillstone.session import spread
from quillstone.sources.tables import POSTINGS_SQL, postings

AS_OF = datetime(2001, 8, 1)
P = f"WITH p AS ({POSTINGS_SQL}) "

PROFILE = S.Profile(
    skills=("python", "sql", "tion", "the", "airflow"),
    vocabulary=("python", "sql", "tion", "the", "que", "der", "ing", "airflow", "spark", "kafka"),
    domains=("ment", "cloud", "keit", "data"),
    soft={"leadership": ("lead", "led a team"), "communication": ("communication", "ation"), "agile": ("agile", "sprint")},
    resume="Data engineer, python and sql, cloud, led a team, masters, 8 years",
    years=8,
    title_groups={"engineering": ("engineer", "developer"), "analyst": ("analyst",), "management": ("manager",)},
    target_groups=("engineering", "analyst"),
    other_functions={"sales": ("account executive", "enterprise", "quota")},
    context={"cloud": (("aws",), ("construction",))},
)


@query("jobs_list", P + "SELECT id, title, remote_type, salary_max FROM p WHERE coalesce(salary_max, salary_min, 0) >= 130000 AND alignment_score >= 50 AND (title ILIKE '%engineer%' OR company ILIKE '%engineer%' OR description ILIKE '%engineer%') ORDER BY CASE remote_type WHEN 'remote' THEN 0 WHEN 'hybrid' THEN 1 ELSE 2 END, coalesce(salary_max, salary_min, 0) DESC, posted_date DESC, id LIMIT 40")
def jobs_list(spark, read):
    return JobQuery(AS_OF, search="engineer", min_score=50, min_salary=130000, limit=40).apply(postings(spark, read)).select("id", "title", "remote_type", "salary_max")


@query("jobs_by_score", P + "SELECT id, alignment_score FROM p WHERE source_site = 'src3' ORDER BY alignment_score DESC NULLS LAST, posted_date DESC NULLS LAST, id LIMIT 25 OFFSET 5")
def jobs_by_score(spark, read):
    return JobQuery(AS_OF, source="src3", sort="score", limit=25, offset=5).apply(postings(spark, read)).select("id", "alignment_score")


@query("jobs_by_rating", P + "SELECT id, company_rating FROM p WHERE remote_type = 'remote' ORDER BY company_rating DESC NULLS LAST, posted_date DESC NULLS LAST, id LIMIT 30")
def jobs_by_rating(spark, read):
    return JobQuery(AS_OF, remote_only=True, sort="culture", limit=30).apply(postings(spark, read)).select("id", "company_rating")


@query("posting_stats", P + "SELECT count(*) AS total, count(*) FILTER (remote_type = 'remote') AS remote, count(*) FILTER (salary_min IS NOT NULL OR salary_max IS NOT NULL) AS with_salary, count(alignment_score) AS scored, round(avg(alignment_score), 1) AS avg_score FROM p")
def posting_stats(spark, read):
    return postings(spark, read).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("remote_type") == "remote").alias("remote"), F.count_if(F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()).alias("with_salary"),
        F.count("alignment_score").alias("scored"), F.round(F.avg("alignment_score"), 1).alias("avg_score"),
    )


@query("work_list", P + "SELECT id FROM p WHERE alignment_score IS NULL AND length(description) > 50 ORDER BY posted_date DESC, id LIMIT 60")
def work_list(spark, read):
    return postings(spark, read).filter(F.col("alignment_score").isNull() & (F.length("description") > 50)).orderBy(F.desc("posted_date"), "id").limit(60).select("id")


def _sum_sql(patterns, text):
    return " + ".join(f"CAST(regexp_matches({text}, '{p}') AS INT)" for p in patterns)


CHAIN = "CASE WHEN salary_max < 130000 THEN 'salary' WHEN company_rating < 3.5 THEN 'rating' WHEN alignment_score < 40 THEN 'alignment' WHEN applicant_count > 500 THEN 'applicants' ELSE 'pass' END"
SIMPLE_GATES = (
    ("salary", lambda c: [(F.col("salary_max") < c.salary_floor, G.FAIL, 0.95, "salary under floor")]),
    ("rating", lambda c: [(F.col("company_rating") < c.rating_floor, G.FAIL, 0.8, "low rating")]),
    ("alignment", lambda c: [(F.col("alignment_score") < c.score_floor, G.FAIL, 0.85, "low alignment")]),
    ("applicants", lambda c: [(F.col("applicant_count") > c.max_applicants, G.FAIL, 0.75, "too many applicants")]),
)


@query("screen_chain", P + f"SELECT id, {CHAIN} AS stopped_by FROM p")
def screen_chain(spark, read):
    return G.screen(postings(spark, read), G.GateConfig(AS_OF), gates=SIMPLE_GATES).select("id", F.coalesce("stopped_by", F.lit("pass")).alias("stopped_by"))


@query("gate_stats", P + f", s AS (SELECT {CHAIN} AS g FROM p), o AS (SELECT unnest([0, 1, 2, 3]) AS i), n AS (SELECT i, ['salary', 'rating', 'alignment', 'applicants'][i + 1] AS gate, (SELECT count(*) FROM s WHERE g = 'pass' OR list_position(['salary', 'rating', 'alignment', 'applicants'], g) >= i + 1) AS evaluated, (SELECT count(*) FROM s WHERE g = ['salary', 'rating', 'alignment', 'applicants'][i + 1]) AS failed FROM o) SELECT gate, evaluated, evaluated - failed AS passed, failed, CAST(0 AS BIGINT) AS override, round(100 * (evaluated - failed) / evaluated, 1) AS pass_rate FROM n")
def gate_stats(spark, read):
    return G.gate_statistics(G.screen(postings(spark, read), G.GateConfig(AS_OF), gates=SIMPLE_GATES))


CONFIG = G.GateConfig(AS_OF, red=("worthless",), yellow=("the", "and", "with"), yellow_threshold=3, red_skills=("tion", "spark"), remote_only=True, salary_from_text=False)


def _has(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _word(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _required(term: str) -> str:
    near = f"substring(d, greatest(instr(d, '{term}') - 200, 1), instr(d, '{term}') + {len(term)} + 199 - greatest(instr(d, '{term}') - 200, 1) + 1)"
    return f"(instr(d, '{term}') > 0 AND NOT ({_has(near, G.WISHED_SIGNALS)} AND NOT {_has(near, G.REQUIRED_SIGNALS)}))"


#: The wordings again, as SQL text, so that the two engines don't share a list.
GHOST_SQL = (
    "talent community|talent pipeline|future opportunities|no immediate openings|building our team for|pool of candidates|general application|we are always looking"
    "|evergreen requisition|proactive sourcing|talent pool|ongoing recruitment|continuous hiring|we''re always hiring|rolling basis|no specific opening|speculative application"
).split("|")
DOD, EDGE = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
GOVERNMENT_SQL = (
    " OR ".join(f"regexp_matches(cd, '(^|{EDGE}){x}({EDGE}|$)')" for x in ("nsa", "cia", "dia", "nro", "nga", "fbi", "dhs", "usaf", "fema"))
    + f" OR regexp_matches(cd, '(^|{EDGE})dod {DOD}') OR "
    + _has("cd", (
        "department of defense", "department of energy", "national security agency", "central intelligence agency", "defense intelligence agency", "national reconnaissance office",
        "national geospatial", "department of homeland", "us army", "us navy", "us marine", "space force", "darpa", "iarpa", "naval research", "army research", "air force research",
        "intelligence community", "ic contractor", "federal emergency management", "department of veterans", "department of justice", "department of state", "department of treasury",
        "department of interior", "department of labor", "department of education", "department of agriculture", "department of commerce", "department of transportation",
        "department of health", "department of housing",
    ))
)

#: Every gate of the full chain in SQL, over c (company), l (place), d (description), all lowered, and the plain columns.
FULL_CHAIN = {
    "0A_company": "'pass'",
    "0J_role": "CASE WHEN id % 8 IN (1, 3, 4, 6) THEN 'fail' ELSE 'pass' END",
    "0G_red": f"CASE WHEN {_word('d', 'worthless')} THEN 'fail' ELSE 'pass' END",
    "0H_yellow": f"CASE WHEN {' AND '.join(_word('d', w) for w in ('the', 'and', 'with'))} THEN 'override_required' ELSE 'pass' END",
    "0B_defense": f"CASE WHEN {_has('c', G.DEFENSE_PRIMES)} OR {_has('d', G.CLEARANCE_KEYWORDS)} OR {GOVERNMENT_SQL} THEN 'fail' ELSE 'pass' END",
    "0C_staffing": f"CASE WHEN {_has('c', G.DIRECT_HIRE_ALLOWLIST)} THEN 'pass' WHEN contains(c, 'amazon') THEN 'fail' WHEN {_has('c', G.STAFFING_AGENCIES)} OR {_has('d', G.STAFFING_SIGNALS)} THEN 'override_required' ELSE 'pass' END",
    "0D_ghost": "CASE WHEN ghost >= 0.6 THEN 'fail' WHEN ghost >= 0.4 THEN 'override_required' WHEN age > 45 OR applicant_count > 500 THEN 'fail' ELSE 'pass' END",
    "0E_stack": f"CASE WHEN {_required('tion')} OR {_required('spark')} OR {_has('d', G.CLOUD_PRIMARY)} OR {_has('d', [t.format(k) for k in ('kubernetes', 'terraform', 'dbt', 'snowflake') for t in G.PRIMARY_TEMPLATES])} THEN 'fail' ELSE 'pass' END",
    "0I_alignment": "CASE WHEN alignment_score < 40 THEN 'fail' WHEN alignment_score < 60 THEN 'override_required' ELSE 'pass' END",
    "0F_compensation": f"CASE WHEN remote_type <> 'remote' AND NOT {_has('l', (*G.REMOTE_PLACES, *G.SURELY_REMOTE))} AND {_has('l', G.FOREIGN)} THEN 'fail' WHEN remote_type = 'on_site' THEN 'fail' WHEN remote_type = 'hybrid' THEN 'override_required' WHEN coalesce(salary_max, salary_min) < 130000 THEN 'fail' WHEN coalesce(salary_max, salary_min) < 140000 THEN 'override_required' ELSE 'pass' END",
    "culture": f"CASE WHEN company_rating < 3.5 THEN 'fail' WHEN company_rating < 3.9 OR {_has('d', G.LAYOFFS)} THEN 'override_required' ELSE 'pass' END",
}
_FULL = P + f"""
, a AS (SELECT *, lower(company) AS c, lower(location) AS l, lower(description) AS d, CAST(floor((epoch(TIMESTAMP '2001-08-01') - epoch(posted_date)) / 86400) AS BIGINT) AS age FROM p),
b AS (SELECT *, c || ' ' || chr(10) || ' ' || d AS cd, {_sum_sql(G.SPECIFIC_PATTERNS, "d")} AS sharp, {" + ".join(f"CAST(contains(d, '{x}') AS INT)" for x in G.VAGUE_PHRASES)} AS vague FROM a),
g AS (SELECT *, least(CASE WHEN age > 45 THEN 0.25 WHEN age > 30 THEN 0.15 ELSE 0 END + CASE WHEN salary_max IS NULL THEN 0.05 ELSE 0 END
        + CASE WHEN applicant_count > 500 THEN 0.2 WHEN applicant_count > 200 THEN 0.15 ELSE 0 END
        + CASE WHEN length(d) < 50 OR sharp + vague > 0 AND round(sharp / (sharp + vague), 2) < 0.3 THEN 0.1 ELSE 0 END
        + CASE WHEN {_has("d", GHOST_SQL)} THEN 0.15 ELSE 0 END, 1.0) AS ghost FROM b),
r AS (SELECT id, {list(FULL_CHAIN)} AS gates, [{", ".join(FULL_CHAIN.values())}] AS results FROM g)
"""
FULL_SQL = _FULL + """
, s AS (SELECT id, gates, results, list_position([x <> 'pass' FOR x IN results], true) AS k FROM r)
SELECT id, CASE WHEN k > 0 THEN gates[k] END AS stopped_by, CASE WHEN k > 0 THEN results[k] ELSE 'pass' END AS outcome, CAST(CASE WHEN k > 0 THEN k ELSE len(gates) END AS INT) AS n_verdicts FROM s
"""
OVERRIDES_SQL = _FULL + """
, f AS (SELECT id, gates, results, [CASE WHEN results[i] = 'fail' OR results[i] = 'override_required' AND NOT (id % 2 = 0 AND gates[i] IN ('0H_yellow', '0F_compensation')) THEN true ELSE false END FOR i IN range(1, len(gates) + 1)] AS stops FROM r),
s AS (SELECT *, list_position(stops, true) AS k FROM f)
SELECT CASE WHEN k > 0 THEN gates[k] END AS stopped_by, CASE WHEN k > 0 THEN results[k] ELSE 'pass' END AS outcome, count(*) AS n FROM s GROUP BY 1, 2
"""


@query("screen_full", FULL_SQL)
def screen_full(spark, read):
    return G.screen(postings(spark, read), CONFIG).select("id", "stopped_by", "outcome", F.size("verdicts").alias("n_verdicts"))


@query("screen_with_overrides", OVERRIDES_SQL)
def screen_with_overrides(spark, read):
    granted = read("documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit("0H_yellow"), F.lit("0F_compensation"))).alias("gate"))
    return G.screen(postings(spark, read), CONFIG, granted).groupBy("stopped_by", "outcome").agg(F.count(F.lit(1)).alias("n"))


CLEARANCE_LABELS = ("required", "Required and active", "no", "TS/SCI", "preferred", "n/a", "public trust", "", "yes please")
CONTEXTS = (
    "security clearance", "clearance required", "clearance preferred", "defense contractor", "government contractor", "federal agency", "government agency",
    "department of defense", "intelligence community", "national security", "classified work", "classified information", "homeland security", "military contract",
    "federal client", "government client", "ic contractor", "federal government", "public trust clearance", "dod contract", "fema funded", "fema grant", "fema program",
    "government services", "federal funding", "federal express", "the agency", "dod ", "dod x", "anything else",
)
DEFENSE_SQL = P + f"""
, a AS (SELECT id, lower(company) AS c, lower(description) || ' ' || list_extract({list(CONTEXTS)}, CAST(id % 31 + 1 AS INT)) AS d0, lower(list_extract({list(CLEARANCE_LABELS)}, CAST(id % 10 + 1 AS INT))) AS l FROM p),
b AS (SELECT id, c, coalesce(d0, '') AS d, l, c || ' ' || chr(10) || ' ' || coalesce(d0, '') AS cd FROM a),
t AS (SELECT id, CASE WHEN {_has('c', G.DEFENSE_PRIMES)} THEN 'defense prime'
  WHEN {_has('d', ('security clearance', 'top secret', 'ts/sci', 'secret clearance', 'ts clearance', 'sci clearance', 'public trust', 'clearance required', 'active clearance', 'dod clearance', 'polygraph', 'ci poly', 'full scope poly', 'lifestyle poly', 'interim clearance', 'eligibility for clearance', 'must be clearable', 'ability to obtain clearance', 'current clearance', 'classified environment', 'classified information', 'noforn', 'sci eligible'))} THEN 'clearance in the description'
  WHEN l IN ('yes', 'true', '1', 'active', 'current', 'required and active', 'secret', 'top secret', 'ts', 'ts/sci', 'sci', 'confidential', 'dod', 'interim', 'public trust') THEN 'clearance field'
  WHEN l NOT IN ('no', 'false', 'none', '0', '', 'n/a', 'not required', 'not applicable', 'na', 'null') AND {_has('d', [x for x in CONTEXTS[:25]])} THEN 'clearance field and context'
  WHEN {GOVERNMENT_SQL} THEN 'government employer' END AS reason FROM b)
SELECT id, reason FROM t WHERE reason IS NOT NULL
"""


@query("blended_scores", P + "SELECT id, CASE WHEN alignment_score >= 25 AND id % 4 > 0 THEN round(0.6 * alignment_score + 0.4 * (id * 37 % 101), 1) ELSE alignment_score END AS score FROM p WHERE alignment_score IS NOT NULL")
def blended_scores(spark, read):
    """Keyword scores blended with a second score, made from the id, where there is one and the first is worth it."""
    second = F.when(F.col("id") % 4 > 0, (F.col("id") * 37 % 101).cast("double"))
    return postings(spark, read).filter("alignment_score is not null").select("id", S.blended(F.col("alignment_score"), second).alias("score"))


PLACES = ("Austin, TX", "Greater London", "toronto", "Berlin", "Remote, US", "Elsewhere", None)
LISTS = (
    ("remote_first", "us", "new", None), ("score", "uk", None, None), ("salary", "canada", "purchase", None), ("culture", "europe", "new", "senior"), ("date", "remote", "click", None),
    ("other", "hybrid", None, "mid"),
)
_LIST_WHERE = {
    "us": "location ILIKE '%United States%' OR location ILIKE '%, US%' OR location ILIKE '%USA%' OR location ILIKE '%, CA%' OR location ILIKE '%, NY%' OR location ILIKE '%, WA%' OR location ILIKE '%, TX%' OR location ILIKE '%, VA%' OR location ILIKE '%San Francisco%' OR location ILIKE '%New York%' OR location ILIKE '%Seattle%'",
    "uk": "location ILIKE '%United Kingdom%' OR location ILIKE '%, UK%' OR location ILIKE '%London%' OR location ILIKE '%England%'",
    "canada": "location ILIKE '%Canada%' OR location ILIKE '%Toronto%' OR location ILIKE '%Vancouver%' OR location ILIKE '%Montreal%'",
    "europe": "location ILIKE '%Germany%' OR location ILIKE '%France%' OR location ILIKE '%Netherlands%' OR location ILIKE '%Spain%' OR location ILIKE '%Ireland%' OR location ILIKE '%Berlin%' OR location ILIKE '%Amsterdam%' OR location ILIKE '%Europe%'",
    "remote": "remote_type = 'remote'", "hybrid": "remote_type = 'hybrid'",
}
_LIST_ORDER = {
    "remote_first": "CASE remote_type WHEN 'remote' THEN 0 WHEN 'hybrid' THEN 1 ELSE 2 END, coalesce(alignment_score, 0) DESC, coalesce(salary_max, 0) DESC, ", "score": "coalesce(alignment_score, 0) DESC, ",
    "salary": "coalesce(salary_max, 0) DESC, ", "culture": "coalesce(company_rating, 0) DESC, coalesce(alignment_score, 0) DESC, ", "date": "", "other": "",
}


def _list_sql(sort: str, place: str, status: str | None, level: str | None) -> str:
    answered = {None: "", "new": "AND id NOT IN (SELECT job_id FROM a WHERE response_type <> 'none')"}.get(status, f"AND id IN (SELECT job_id FROM a WHERE response_type = '{status}')")
    where = f"scraped_date >= TIMESTAMP '2001-08-01' - INTERVAL 3000 DAY AND active AND (posted_date IS NULL OR posted_date >= TIMESTAMP '2001-08-01' - INTERVAL 3000 DAY) AND ({_LIST_WHERE[place]}) {answered}" + (f" AND experience_level = '{level}'" if level else "")
    return f"SELECT '{sort}' AS sort, id, CAST(row_number() OVER (ORDER BY {_LIST_ORDER[sort]}scraped_date DESC NULLS LAST, id) AS INT) AS rank FROM j WHERE {where} QUALIFY rank <= 25"


JOB_LISTS_SQL = P.rstrip() + """
, j AS (SELECT * REPLACE (list_extract(['Austin, TX', 'Greater London', 'toronto', 'Berlin', 'Remote, US', 'Elsewhere', NULL], CAST(id % 7 + 1 AS INT)) AS location, CASE WHEN id % 10 > 0 THEN posted_date END AS posted_date), posted_date + to_days(CAST(id % 5 AS INT)) AS scraped_date, id % 13 > 0 AS active,
        CASE id % 2 WHEN 0 THEN 'senior' ELSE 'mid' END AS experience_level FROM p),
a AS (SELECT user_id AS job_id, CASE event_type WHEN 'view' THEN 'none' ELSE event_type END AS response_type FROM events WHERE user_id % 3 = 0)
""" + " UNION ALL ".join(f"({_list_sql(*x)})" for x in LISTS)


@query("job_lists", JOB_LISTS_SQL)
def job_lists(spark, read):
    """Six lists of jobs: every order, place and status; places, levels and days of finding come by the id, answers are events of some users."""
    c = F.col
    jobs = postings(spark, read).withColumns({
        "location": F.get(F.array(*map(F.lit, PLACES)), (c("id") % 7).cast("int")),
        "scraped_date": c("posted_date") + F.make_dt_interval((c("id") % 5).cast("int")),
        "posted_date": F.when(c("id") % 10 > 0, c("posted_date")),
        "is_active": c("id") % 13 > 0,
        "experience_level": F.when(c("id") % 2 == 0, "senior").otherwise("mid"),
    })
    answers = read("events").filter("user_id % 3 = 0").select(c("user_id").alias("job_id"), F.when(c("event_type") == "view", "none").otherwise(c("event_type")).alias("response_type"))
    out = None
    for sort, place, status, level in LISTS:
        asked = JobList(AS_OF, 3000, 25, sort=sort, location=place, status=status, seniority=level)
        ranked = Window.orderBy(*asked.order())  # 25 rows
        part = asked.apply(jobs, answers).select(F.lit(sort).alias("sort"), "id", F.row_number().over(ranked).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


SALARY_TEXT_SQL = P + """
SELECT id, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN '$' || format('{:,}', CAST(salary_min AS BIGINT)) || ' - $' || format('{:,}', CAST(salary_max AS BIGINT)) WHEN salary_min IS NOT NULL THEN '$' || format('{:,}', CAST(salary_min AS BIGINT)) || '+'
  WHEN salary_max IS NOT NULL THEN 'Up to $' || format('{:,}', CAST(salary_max AS BIGINT)) ELSE 'Not specified' END AS salary,
  CASE WHEN length(description) <= 200 THEN description ELSE regexp_replace(left(description, 200), ' [^ ]*$', '') || '...' END AS short FROM p
"""


@query("salary_texts", SALARY_TEXT_SQL)
def salary_texts(spark, read):
    return postings(spark, read).select("id", T.salary_text(F.col("salary_min"), F.col("salary_max")).alias("salary"), T.shortened(F.col("description")).alias("short"))


@query("defense_gate", DEFENSE_SQL)
def defense_gate(spark, read):
    """The clearance gate by itself; labels and wordings come by the id, as no table has them."""
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (F.col("id") % k).cast("int"))
    jobs = postings(spark, read).withColumn("description", F.coalesce(F.concat("description", F.lit(" "), pick(CONTEXTS, 31)), F.lit(""))).withColumn("clearance_required", pick(CLEARANCE_LABELS, 10))
    gates = tuple(g for g in G.GATES if g[0] == "0B_defense")
    return G.screen(jobs, G.GateConfig(AS_OF), gates=gates).filter(F.col("stopped_by").isNotNull()).select("id", F.col("verdicts")[0]["reason"].alias("reason"))


@query("stack_tiers", P + f"SELECT id, CASE WHEN {_has('lower(description)', G.STACK_SIGNALS)} THEN 1 ELSE 2 END AS tier FROM p")
def stack_tiers(spark, read):
    return postings(spark, read).select("id", G.stack_tier(F.col("description"))["tier"].alias("tier"))


RESEARCH_SQL = P + """
, r AS (SELECT lower(s_name) AS company, CASE s_suppkey % 4 WHEN 0 THEN 'declined' WHEN 1 THEN 'approved' WHEN 2 THEN 'exclude' ELSE 'review' END AS decision,
               CASE WHEN s_suppkey % 2 = 1 THEN CAST(30 + s_suppkey % 20 AS DOUBLE) / 10 END AS rating, CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2000-12-01' - to_days(CAST(s_suppkey * 90 AS INT)) END AS laid_off FROM supplier)
SELECT id, CASE WHEN decision IN ('declined', 'exclude') THEN '0A_company' WHEN decision = 'review' THEN '0A_company'
     WHEN coalesce(rating, company_rating) < 3.9 OR epoch(TIMESTAMP '2001-08-01') - epoch(laid_off) <= 86400 * 30 * 18 + 86399 THEN 'culture' END AS stopped_by
FROM p LEFT JOIN r ON r.company = lower(p.company)
"""


@query("researched_companies", RESEARCH_SQL)
def researched_companies(spark, read):
    """The two gates that read what is known of a company, over research made from the suppliers."""
    key = F.col("s_suppkey")
    research = read("supplier").select(
        F.upper("s_name").alias("company"),
        F.element_at(F.array(*map(F.lit, ("declined", "approved", "exclude", "review"))), (key % 4 + 1).cast("int")).alias("decision"),
        F.when(key % 2 == 1, (30 + key % 20).cast("double") / 10).alias("rating"),
        F.when(key % 3 == 0, F.date_sub(F.lit("2000-12-01").cast("date"), (key * 90).cast("int")).cast("timestamp_ntz")).alias("last_layoff_date"),
    )
    gates = tuple(g for g in G.GATES if g[0] in ("0A_company", "culture"))
    cfg = G.GateConfig(AS_OF, lists={"LAYOFFS": ("\u0000",)})
    return G.screen(G.with_research(postings(spark, read), research), cfg, gates=gates).select("id", "stopped_by")


@query("review_queue", P + f", s AS (SELECT id, alignment_score, {CHAIN} AS g FROM p) SELECT id, CASE g WHEN 'pass' THEN 99 WHEN 'alignment' THEN 1 WHEN 'salary' THEN 2 ELSE 3 END AS tier FROM s WHERE g <> 'pass' ORDER BY tier, alignment_score DESC NULLS LAST, id LIMIT 50")
def review_queue(spark, read):
    s = G.screen(postings(spark, read), G.GateConfig(AS_OF), gates=SIMPLE_GATES).filter(F.col("outcome") != G.PASS)
    named = F.when(F.col("stopped_by") == "alignment", "0I_alignment").when(F.col("stopped_by") == "salary", "0F_compensation").otherwise(F.col("stopped_by"))
    return s.select("id", "alignment_score", G.review_tier(named, F.col("outcome")).alias("tier")).orderBy("tier", F.col("alignment_score").desc_nulls_last(), "id").limit(50).select("id", "tier")


GHOST = "round(least(CASE WHEN age > 45 THEN 0.25 WHEN age > 30 THEN 0.15 ELSE 0 END + CASE WHEN salary_min IS NULL AND salary_max IS NULL THEN 0.05 ELSE 0 END + CASE WHEN applicant_count > 500 THEN 0.2 WHEN applicant_count > 200 THEN 0.15 ELSE 0 END + CASE WHEN length(description) < 50 THEN 0.10 ELSE 0 END, 1.0), 2)"


@query("ghost_score", P + f", a AS (SELECT *, CAST(floor((epoch(TIMESTAMP '2001-08-01') - epoch(posted_date)) / 86400) AS BIGINT) AS age FROM p) SELECT id, {GHOST} AS score FROM a")
def ghost_score(spark, read):
    none, unknown = F.lit(None).cast("boolean"), F.lit(None).cast("int")
    vague = F.when(F.length("description") < 50, 0.1).otherwise(0.5)
    score = G.ghost_score(age_days(F.lit(AS_OF).cast("timestamp_ntz"), F.col("posted_date")), F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull(), F.col("applicant_count"), none, unknown, vague, none, none, F.lit(0), unknown)
    return postings(spark, read).select("id", F.round(score, 2).alias("score"))


GHOST_POINTS_SQL = P + f"""
, a AS (SELECT id, applicant_count, lower(description) AS d, CAST(floor((epoch(TIMESTAMP '2001-08-01') - epoch(posted_date)) / 86400) AS BIGINT) AS age,
               CASE WHEN id % 3 = 0 THEN id % 120 END AS gap, CASE id % 4 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS found FROM p),
b AS (SELECT *, {_sum_sql(G.GHOST_PATTERNS, "d")} AS phrases, {_sum_sql(G.VAGUE_PATTERNS, "d")} AS vague FROM a),
c AS (SELECT id, CASE WHEN age > 90 THEN 3 WHEN age > 60 THEN 2 WHEN age > 45 THEN 1 ELSE 0 END
               + CASE WHEN applicant_count > 1000 THEN 3 WHEN applicant_count > 500 THEN 2 WHEN applicant_count > 300 THEN 1 ELSE 0 END
               + CASE WHEN gap > 90 THEN 2 WHEN gap > 30 THEN 1 ELSE 0 END
               + CASE WHEN d <> '' THEN least(phrases, 3) + CASE WHEN length(d) < 200 OR vague >= 2 THEN 1 ELSE 0 END ELSE 0 END
               + CASE WHEN found THEN -1 WHEN NOT found THEN 3 ELSE 0 END AS points FROM b)
SELECT id, CAST(floor(100 * greatest(points, 0) / 15) AS INT) AS confidence, floor(100 * greatest(points, 0) / 15) >= 25 AS is_ghost FROM c
"""


@query("ghost_points", GHOST_POINTS_SQL)
def ghost_points(spark, read):
    """Repost gaps and what career pages say are made from the id, as no table has them."""
    gap = F.when(F.col("id") % 3 == 0, F.col("id") % 120)
    found = F.when(F.col("id") % 4 == 0, False).when(F.col("id") % 4 == 1, True)
    points = G.ghost_points(age_days(F.lit(AS_OF).cast("timestamp_ntz"), F.col("posted_date")), F.col("applicant_count"), gap, F.col("description"), found)
    return postings(spark, read).select("id", points.alias("confidence")).withColumn("is_ghost", F.col("confidence") >= G.GHOST_FROM)


@query("salary_yearly", P + ", s AS (SELECT id, salary_max, CASE id % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'yearly' END AS period FROM p) SELECT id, salary_max * CASE period WHEN 'hourly' THEN 2080 WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 ELSE 1 END AS yearly FROM s")
def salary_yearly(spark, read):
    period = F.when(F.col("id") % 4 == 0, "hourly").when(F.col("id") % 4 == 1, "weekly").when(F.col("id") % 4 == 2, "monthly").otherwise("yearly")
    return postings(spark, read).select("id", yearly(F.col("salary_max"), period).alias("yearly"))


@query("salary_overlap", P + "SELECT id, round(greatest(least(salary_max, 180000) - greatest(salary_min, 120000), 0) / 60000, 4) AS share FROM p WHERE salary_min IS NOT NULL")
def salary_overlap(spark, read):
    share = interval_overlap(F.col("salary_min"), F.col("salary_max"), F.lit(120000.0), F.lit(180000.0))
    return postings(spark, read).filter("salary_min is not null").select("id", F.round(share, 4).alias("share"))


#: Ways to write a salary of low and high thousands, and what is read from them: low, high (as SQL over l and h), period and confidence.
WRITTEN = (
    ("Pay: $%l,000 \u2013 $%h,000 a year", "1000.0 * l", "1000.0 * h", "yearly", 0.92),
    ("between $%lK-$%hK", "1000.0 * l", "1000.0 * h", "yearly", 0.92),
    ("Base salary: $%lK", "1000.0 * l", "1000.0 * l", "yearly", 0.87),
    ("we offer $95/hr now", "95.0", "95.0", "hourly", 0.88),
    ("up to $%hK", "0.0", "1000.0 * h", "yearly", 0.75),
    ("%l,000 to %h,000", "1000.0 * l", "1000.0 * h", "yearly", 0.92),
    ("founded 2019-2022", "NULL", "NULL", None, None),
    ("5-9 years", "NULL", "NULL", None, None),
    ("compensation of $9,500 per month", "9500.0", "9500.0", "monthly", 0.88),
    ("no figures at all", "NULL", "NULL", None, None),
)
_CASE = lambda f: "CASE id % 10 " + " ".join(f"WHEN {i} THEN {f(w)}" for i, w in enumerate(WRITTEN)) + " END"
_TEXT_OR_NULL = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
SALARY_SQL = P + f"""
, a AS (SELECT id, 80 + id * 37 % 120 AS l, 110 + id * 37 % 120 AS h FROM p),
s AS (SELECT id, CAST({_CASE(lambda w: w[1])} AS DOUBLE) AS low, CAST({_CASE(lambda w: w[2])} AS DOUBLE) AS high, {_CASE(lambda w: _TEXT_OR_NULL(w[3]))} AS period, CAST({_CASE(lambda w: _TEXT_OR_NULL(w[4]))} AS DOUBLE) AS confidence FROM a)
SELECT id, low, high, period, confidence, high * CASE period WHEN 'hourly' THEN 2080 WHEN 'monthly' THEN 12 ELSE 1 END AS yearly_high FROM s
"""


@query("salary_extract", SALARY_SQL)
def salary_extract(spark, read):
    """Salaries written into a sentence in ten ways; the expected values follow from the figures, not from the patterns."""
    low, high = ((F.lit(k) + F.col("id") * 37 % 120).cast("string") for k in (80, 110))
    sentence = F.element_at(F.array(*(F.lit(w[0]) for w in WRITTEN)), (F.col("id") % len(WRITTEN) + 1).cast("int"))
    text = F.replace(F.replace(sentence, F.lit("%l"), low), F.lit("%h"), high)
    found = salary(F.concat(F.lit("We hire. "), text, F.lit(". Apply now.")))
    return postings(spark, read).select("id", found.alias("s")).select("id", "s.low", "s.high", "s.period", "s.confidence", yearly(F.col("s.high"), F.col("s.period")).alias("yearly_high"))


@query("age_labels", P + ", a AS (SELECT id, CAST(floor((epoch(TIMESTAMP '2001-08-01') - epoch(posted_date)) / 86400) AS BIGINT) AS d FROM p) SELECT id, CASE WHEN d <= 0 THEN 'Today' WHEN d < 7 THEN d || 'd' WHEN d < 30 THEN (d // 7) || 'w' ELSE (d // 30) || 'mo' END AS label FROM a")
def age_labels(spark, read):
    return postings(spark, read).select("id", age_label(age_days(F.lit(AS_OF).cast("timestamp_ntz"), F.col("posted_date"))).alias("label"))


@query("role_tracks", P + "SELECT id, CASE WHEN contains(lower(title), 'analyst') THEN 'analyst' WHEN regexp_matches(lower(title), 'engineering manager') THEN 'leadership' ELSE 'engineering' END AS track, CASE WHEN contains(lower(title), 'manager') THEN 'manager' WHEN contains(lower(title), 'senior') THEN 'senior' ELSE 'mid' END AS level FROM p")
def role_tracks(spark, read):
    return postings(spark, read).select("id", T.role_track(F.col("title")).alias("track"), T.seniority(F.col("title")).alias("level"))


#: Titles of every category, for the classifier; the posting's own title stands among them.
TITLES = (
    "Data Center Delivery Lead", "HVAC Technician", "Strategic Account Lead", "Customer Success Manager", "Staff Counsel", "Tax Manager", "Recruiter",
    "Backend Engineer", "ETL Engineer", "Full-Stack Engineer", "SWE II", "Reporting Analyst", "BI Analyst", "Analytics Engineer", "dbt Engineer", "Applied Scientist",
    "Research Engineer", "Security Architect", "Trust & Safety Lead", "Product Owner", "UX Designer", "VP Operations", "Engineering Manager", "Gardener", "",
)
_CATEGORY_CASES = " ".join("WHEN " + " OR ".join(f"regexp_matches(t, '{x}')" for x in patterns) + f" THEN '{name}|{confidence}'" for name, confidence, _, patterns in S.CATEGORIES)
_ENGINEERING = " OR ".join(f"contains(b, '{w}')" for w in S.ENGINEERING_WORDS)
CATEGORY_SQL = P + f"""
, a AS (SELECT id, lower(trim(CASE WHEN id % 4 = 0 THEN title ELSE list_element({list(TITLES)}, CAST(id % {len(TITLES)} + 1 AS BIGINT)) END)) AS t, lower(left(description, 500)) AS d FROM p),
c AS (SELECT id, t || ' ' || d AS b, t FROM a),
k AS (SELECT id, CASE {_CATEGORY_CASES} WHEN {_ENGINEERING} THEN 'software_data_engineering|0.65' ELSE 'other|0.5' END AS k FROM c)
SELECT id, split_part(k, '|', 1) AS category, CAST(split_part(k, '|', 2) AS DOUBLE) AS confidence,
       split_part(k, '|', 1) IN ('software_data_engineering', 'data_analysis_business_analysis', 'analytics_engineering', 'other') AS wanted FROM k
"""


def _titled(spark, read):
    own = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("id") % len(TITLES) + 1).cast("int"))
    return postings(spark, read).withColumn("title", F.when(F.col("id") % 4 == 0, F.col("title")).otherwise(own))


@query("category_classifier", CATEGORY_SQL)
def category_classifier(spark, read):
    return _titled(spark, read).select("id", S.category(F.col("title"), F.col("description")).alias("c")).select("id", "c.*")


@query("category_counts", f"SELECT category, count(*) AS n FROM ({CATEGORY_SQL}) GROUP BY 1")
def category_counts(spark, read):
    return _titled(spark, read).groupBy(S.category(F.col("title"), F.col("description"))["category"].alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("role_labels", P + "SELECT id, CASE id % 8 WHEN 0 THEN 'ENGINEERING_IC' WHEN 1 THEN 'SALES' WHEN 2 THEN 'OTHER' WHEN 3 THEN 'MANAGEMENT' WHEN 4 THEN 'DESIGN' WHEN 5 THEN 'ENGINEERING_IC' WHEN 6 THEN 'MANAGEMENT' ELSE 'ENGINEERING_IC' END AS label, CASE WHEN id % 8 = 2 THEN 0.5 ELSE 0.82 END AS confidence FROM p")
def role_labels(spark, read):
    role = G.role_label(F.col("title"))
    return postings(spark, read).select("id", role["label"].alias("label"), role["confidence"].cast("double").alias("confidence"))


def _hit(text: str, term: str) -> str:
    return _word(text, term) if len(term) <= 3 else f"contains({text}, '{term}')"


def _hits(text: str, terms) -> str:
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN {_hit(text, t)} THEN '{t}' END" for t in sorted(terms)) + "] IF x IS NOT NULL]"


_DEGREES = lambda t: "greatest(" + ", ".join(f"CASE WHEN contains({t}, '{d}') THEN {r} ELSE 0 END" for d, r in S.DEGREES) + ")"
#: The five category scores, in SQL, for PROFILE: skills python, sql, tion, the, airflow; 8 years; a masters degree; domains named in the resume: cloud, data.
ALIGN_SQL = P + rf"""
, a AS (SELECT id, lower(title) AS t, lower(CASE WHEN head > 0 THEN left(description, head - 1) ELSE description END) AS d
        FROM (SELECT *, instr(description, regexp_extract(description, '{T.BENEFITS}', 0)) * CAST(regexp_matches(description, '{T.BENEFITS}') AS INT) AS head FROM p)),
b AS (SELECT *, CASE WHEN regexp_matches(d, '{T.REQUIRED}') THEN regexp_extract(d, '{T.REQUIRED}', 1) ELSE d END AS need, regexp_extract(d, '{T.WISHED}', 0) AS wish FROM a),
c AS (SELECT *, {_hits("d", PROFILE.vocabulary)} AS everything, {_hits("need", PROFILE.vocabulary)} AS required, {_hits("wish", PROFILE.vocabulary)} AS wished,
        {_hits("d", PROFILE.domains)} AS domains, [x FOR x IN [CASE WHEN contains(d, 'ation') OR contains(d, 'communication') THEN 'communication' END, CASE WHEN contains(d, 'lead') THEN 'leadership' END, CASE WHEN contains(d, 'agile') OR contains(d, 'sprint') THEN 'agile' END] IF x IS NOT NULL] AS soft,
        coalesce(list_max([CAST(y AS INT) FOR y IN regexp_extract_all(d, '([0-9]{{1,3}})[+]? *years? *(of +)?experience', 1)]), 0) AS years FROM b),
e AS (SELECT *, list_distinct(list_concat(wished, [x FOR x IN everything IF NOT list_contains(required, x)])) AS preferred, ['python', 'sql', 'tion', 'the', 'airflow'] AS skills FROM c),
f AS (SELECT id, t, required, CASE WHEN contains(t, 'analyst') THEN 'analyst' WHEN contains(t, 'engineering manager') THEN 'leadership' ELSE 'engineering' END AS track,
        CASE WHEN len(everything) > 0 AND len(required) + 0.3 * len(preferred) > 0 THEN least(100.0, 100 * (len(list_intersect(required, skills)) + 0.3 * len(list_intersect(preferred, skills))) / (len(required) + 0.3 * len(preferred))) ELSE 50 END AS technical,
        least(greatest(50 + CASE WHEN years = 0 THEN 0 WHEN years <= 8 THEN 25 ELSE -5 * (years - 8) END
          + CASE WHEN contains(t, 'engineer') OR contains(t, 'developer') THEN 25 WHEN contains(t, 'analyst') OR contains(t, 'manager') THEN 0
                 ELSE 25.0 * len([w FOR w IN list_distinct(string_split_regex(t, '[ 	]+')) IF contains('{PROFILE.resume.lower()}', w)]) / len(list_distinct(string_split_regex(t, '[ 	]+'))) END, 0), 100) AS experience,
        CASE WHEN len(domains) > 0 THEN least(100.0, 100.0 * greatest(len(list_intersect(domains, ['cloud', 'data'])) - CAST(contains(d, 'cloud') AND contains(d, 'construction') AND NOT contains(d, 'aws') AS INT), 0) / len(domains)) ELSE 50 END AS domain,
        CASE WHEN len(soft) > 0 THEN 100.0 * len(list_intersect(soft, ['leadership'])) / len(soft) ELSE 60 END AS soft,
        CASE WHEN {_DEGREES("d")} > 0 THEN CASE WHEN 85 >= {_DEGREES("d")} THEN 90 ELSE greatest(30.0, 80.0 * 85 / {_DEGREES("d")}) END ELSE 75 END AS education,
        CAST(contains(d || chr(10) || t, 'account executive') AS INT) + CAST(contains(d || chr(10) || t, 'enterprise') AS INT) + CAST(contains(d || chr(10) || t, 'quota') AS INT) >= 2 AS elsewhere FROM e),
g AS (SELECT id, track, required, elsewhere, CAST(round(technical, 1) AS DOUBLE) AS technical_score, CAST(round(experience, 1) AS DOUBLE) AS experience_score, CAST(round(domain, 1) AS DOUBLE) AS domain_score,
        CAST(round(soft, 1) AS DOUBLE) AS soft_score, CAST(round(education, 1) AS DOUBLE) AS education_score, [x FOR x IN required IF x NOT IN ('python', 'sql', 'tion', 'the', 'airflow')] AS gaps FROM f),
h AS (SELECT *, CASE WHEN track = 'analyst' THEN round(technical_score * 0.35, 1) + round(experience_score * 0.25, 1) + round(domain_score * 0.20, 1) + round(soft_score * 0.10, 1) + round(education_score * 0.10, 1)
        ELSE round(technical_score * 0.45, 1) + round(experience_score * 0.25, 1) + round(domain_score * 0.15, 1) + round(soft_score * 0.10, 1) + round(education_score * 0.05, 1) END AS total FROM g),
i AS (SELECT *, CAST(round(greatest(least(greatest(total, 0), 100) - CASE WHEN elsewhere THEN 20 ELSE 0 END, 0), 1) AS DOUBLE) AS overall_score, len(gaps) + CAST(elsewhere AS INT) AS n_gaps FROM h)
SELECT id, track, technical_score, experience_score, domain_score, soft_score, education_score, overall_score,
       CASE WHEN overall_score >= 70 AND n_gaps <= 2 THEN 'PROCEED' WHEN overall_score >= 50 OR n_gaps <= 3 THEN 'FLAG' ELSE 'NO_PROCEED' END AS recommendation, array_to_string(gaps, ',') AS gaps FROM i
"""


@query("alignment_score", ALIGN_SQL)
def alignment_score(spark, read):
    out = S.align(postings(spark, read).drop("alignment_score"), PROFILE)
    return out.select("id", "track", "technical_score", "experience_score", "domain_score", "soft_score", "education_score", "overall_score", "recommendation", F.array_join("critical_gaps", ",").alias("gaps"))


@query("technical_share", "SELECT doc_id, round(100.0 * (CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'ment') AS INT)) / nullif(CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'ment') AS INT) + CAST(contains(lower(text), 'keit') AS INT), 0), 1) AS score FROM documents")
def technical_share(spark, read):
    want = T.hits(F.lower("text"), ("tion", "ment", "keit"))
    score = F.when(F.size(want) > 0, S.technical(want, F.array().cast("array<string>"), F.array(F.lit("tion"), F.lit("ment"))))
    return read("documents").select("doc_id", F.round(score, 1).alias("score"))


@query("match_scores", P + "SELECT id, round(least(0.5 + 0.4 * (CAST(contains(lower(title || ' ' || description), 'engineer') AS INT) + CAST(contains(lower(title || ' ' || description), 'data') AS INT)) / 2 + CASE WHEN contains(lower(title || ' ' || description), 'remote') THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(title), 'senior') THEN 0.1 ELSE 0 END, 1.0), 4) AS score FROM p")
def match_scores(spark, read):
    return postings(spark, read).select("id", F.round(S.match_score(F.col("title"), F.col("description"), ("engineer", "data")), 4).alias("score"))


@query("strategies", P + "SELECT id, CASE WHEN alignment_score >= 80 THEN 'apply_now' WHEN alignment_score >= 60 THEN 'tailor' WHEN alignment_score >= 40 THEN 'network' ELSE 'skip' END AS strategy, CASE WHEN alignment_score >= 80 THEN 1 WHEN alignment_score >= 60 THEN 3 WHEN alignment_score >= 40 THEN 7 ELSE 0 END AS days FROM p WHERE alignment_score IS NOT NULL")
def strategies(spark, read):
    s = S.strategy(F.col("alignment_score") / 100)
    return postings(spark, read).filter("alignment_score is not null").select("id", s["strategy"].alias("strategy"), F.coalesce(s["days"], F.lit(0)).alias("days"))


@query("score_histogram", P + "SELECT CASE WHEN alignment_score >= 90 THEN '90-100' WHEN alignment_score >= 80 THEN '80-89' WHEN alignment_score >= 70 THEN '70-79' WHEN alignment_score >= 60 THEN '60-69' WHEN alignment_score >= 50 THEN '50-59' WHEN alignment_score >= 40 THEN '40-49' WHEN alignment_score IS NOT NULL THEN '0-39' END AS band, count(*) AS n FROM p GROUP BY 1")
def score_histogram(spark, read):
    return postings(spark, read).groupBy(G.score_band(F.col("alignment_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("traffic_lights", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])idiot([^a-z0-9]|$)') THEN 'RED' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9])and([^a-z0-9]|$)') THEN 'YELLOW' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])que([^a-z0-9]|$)') THEN 'GREEN' ELSE 'NEUTRAL' END AS light FROM documents")
def traffic_lights(spark, read):
    return read("documents").select("doc_id", G.traffic_light(F.col("text"), ("que",), ("the", "and"), ("idiot",)).alias("light"))


RESUME = """Summary
Data engineer for public services
- Built and ran that thing the tion pipeline with airflow and python
- Led the team that shipped reports, 40% faster
1. Plan and deliver quality checks for the platform
Managed releases with other groups, and tested what they own
short"""

DUTY_SQL = r"""
WITH k AS (SELECT ['airflow', 'and', 'built', 'checks', 'data', 'deliver', 'engineer', 'faster', 'for', 'groups', 'led', 'managed', 'other', 'own', 'pipeline', 'plan', 'platform', 'public', 'python', 'quality', 'ran', 'releases', 'reports', 'services', 'shipped', 'team', 'tested', 'that', 'the', 'they', 'thing', 'tion', 'what', 'with'] AS k),
d AS (SELECT doc_id, text, lower(text) AS t, [regexp_replace(x, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g') FOR x IN string_split(text, chr(10))] AS lines FROM documents),
m AS (SELECT *, [y FOR y IN [regexp_replace(x, '^([-*•]|[0-9]+[.)]) +', '') FOR x IN lines IF regexp_matches(x, '^([-*•]|[0-9]+[.)]) +')] IF length(y) > 15 AND length(y) < 300] AS marked FROM d),
v AS (SELECT *, [x FOR x IN lines IF length(x) > 20 AND length(x) < 300 AND regexp_matches(x, '^[A-Z][a-z]+([^\p{L}\p{N}_]|$)')] AS verbs FROM m),
e AS (SELECT doc_id, t, list_concat(marked, [verbs[i] FOR i IN range(1, len(verbs) + 1) IF NOT list_contains(marked, verbs[i]) AND list_position(verbs, verbs[i]) = i])[1:50] AS duties FROM v),
u AS (SELECT doc_id, unnest(duties) AS x, generate_subscripts(duties, 1) AS i FROM e),
w AS (SELECT doc_id, i, list_distinct([y FOR y IN string_split_regex(lower(x), '[^\p{L}\p{N}_]+') IF regexp_full_match(y, '[a-z]{3,}') AND y NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'will', 'are', 'have', 'has', 'our', 'you', 'your', 'their')]) AS w FROM u),
c AS (SELECT doc_id, count(*) FILTER (len(w) > 0 AND len(list_intersect(k, w)) / len(w) >= 0.25) AS n_matched, count(*) AS n FROM w, k GROUP BY 1),
s AS (SELECT doc_id,
  len([s FOR s IN ['python', 'sql', 'java', 'javascript', 'typescript', 'golang', 'rust', 'api', 'rest', 'graphql', 'microservices', 'architecture', 'design', 'algorithm', 'data structure', 'machine learning', 'ml', 'ai', 'nlp', 'etl', 'pipeline', 'database', 'schema', 'query', 'index', 'aws', 'azure', 'gcp', 'cloud', 'docker', 'kubernetes', 'react', 'angular', 'vue', 'node', 'django', 'flask', 'fastapi', 'spark', 'kafka', 'airflow', 'dbt', 'snowflake', 'databricks', 'pytorch', 'tensorflow', 'scikit', 'pandas', 'numpy', 'ci/cd', 'devops', 'infrastructure', 'terraform', 'ansible', 'build', 'implement', 'develop', 'engineer', 'code', 'program', 'system', 'platform', 'framework', 'library', 'tool'] IF contains(t, s)]) AS a,
  len([s FOR s IN ['deploy', 'release', 'ship', 'deliver', 'execute', 'implement', 'test', 'unit test', 'integration test', 'qa', 'quality', 'monitor', 'observe', 'logging', 'metrics', 'alerting', 'maintain', 'support', 'operate', 'run', 'manage', 'process', 'workflow', 'automation', 'script', 'agile', 'scrum', 'sprint', 'kanban', 'jira', 'documentation', 'spec', 'requirement', 'requirement', 'debug', 'troubleshoot', 'resolve', 'fix', 'optimize'] IF contains(t, s)]) AS b,
  len([s FOR s IN ['lead', 'mentor', 'coach', 'guide', 'manage', 'team', 'cross-functional', 'stakeholder', 'partner', 'communicate', 'present', 'report', 'align', 'hire', 'recruit', 'interview', 'onboard', 'roadmap', 'strategy', 'prioritize', 'plan', 'influence', 'drive', 'own', 'accountable', 'collaborate', 'coordinate', 'facilitate'] IF contains(t, s)]) AS c,
  len([s FOR s IN ['fintech', 'finance', 'banking', 'payments', 'compliance', 'healthcare', 'hipaa', 'ehr', 'clinical', 'e-commerce', 'retail', 'supply chain', 'saas', 'b2b', 'b2c', 'enterprise', 'government', 'federal', 'regulatory', 'security', 'soc2', 'gdpr', 'pci', 'media', 'content', 'advertising', 'domain', 'industry', 'vertical', 'sector'] IF contains(t, s)]) AS d,
  len([s FOR s IN ['ownership', 'initiative', 'proactive', 'self-starter', 'adaptable', 'flexible', 'growth mindset', 'passionate', 'motivated', 'driven', 'communication', 'written', 'verbal', 'problem-solving', 'analytical', 'creative', 'fast-paced', 'ambiguous', 'autonomous', 'remote', 'distributed', 'async'] IF contains(t, s)]) AS e FROM e),
-- So many signals of each kind are in the resume.
r AS (SELECT doc_id, [CASE WHEN z[1] = 0 THEN 75.0 ELSE round(100 * least(z[2] / z[1], 1.0), 1) END FOR z IN list_zip([a, b, c, d, e], [6, 6, 5, 0, 0])] AS k FROM s),
p AS (SELECT doc_id, least((0.5 * k[1] + 0.25 * k[2] + 0.2 * k[3] + 0.1 * k[4] + 0.1 * k[5]) / 1.15, 100.0) AS pct, k FROM r),
l AS (SELECT doc_id, round(pct, 1) AS coverage, CASE WHEN pct BETWEEN 80 AND 100 THEN 'Strong' WHEN pct BETWEEN 50 AND 79.9 THEN 'Moderate' WHEN pct BETWEEN 25 AND 49.9 THEN 'Weak' ELSE 'Minimal' END AS tier,
        [CASE WHEN x BETWEEN 80 AND 100 THEN 'expand' WHEN x BETWEEN 50 AND 79.9 THEN 'maintain' WHEN x BETWEEN 25 AND 49.9 THEN 'trim' ELSE 'exclude' END FOR x IN k] AS space FROM p)
SELECT doc_id, CAST(coverage AS DOUBLE) AS coverage, tier, CASE tier WHEN 'Strong' THEN 'minimal' WHEN 'Moderate' THEN 'light' WHEN 'Weak' THEN 'heavy' ELSE 'exclude' END AS intensity,
  array_to_string(space, ',') AS space, CAST(coalesce(n_matched, 0) AS INT) AS n_matched, CAST(coalesce(n - n_matched, 0) AS INT) AS n_uncovered
FROM l LEFT JOIN c USING (doc_id)
"""


@query("duty_coverage", DUTY_SQL)
def duty_coverage(spark, read):
    d = spread(read("documents").select("doc_id", "text")).select("doc_id", S.duty_coverage(F.col("text"), RESUME).alias("d"))
    space = F.concat_ws(",", *(f"d.space.{k}" for k, _, _ in S.DUTY_KINDS))
    return d.select("doc_id", "d.coverage", "d.tier", "d.intensity", space.alias("space"), F.size("d.matched").alias("n_matched"), F.size("d.uncovered").alias("n_uncovered"))


LETTER_SQL = r"""
WITH r AS (SELECT text AS resume FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
d AS (SELECT doc_id, text, lower(text) AS t, source, resume, [w FOR w IN string_split_regex(regexp_replace(text, '^ +| +$', '', 'g'), '[ \t\r\n]+') IF w <> ''] AS w,
             [x FOR x IN string_split(text, chr(10) || chr(10)) IF len([w FOR w IN string_split_regex(x, '[ \t\r\n\f]+') IF w <> '']) > 20] AS paragraphs,
             string_split(regexp_replace(text, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g'), chr(10)) AS lines,
             string_split(trim(regexp_replace(lower(text), '[ \n\t\r]+', ' ', 'g')), ' ') AS lw, string_split(trim(regexp_replace(lower(resume), '[ \n\t\r]+', ' ', 'g')), ' ') AS rw FROM documents, r),
g AS (SELECT *, list_concat(regexp_extract_all(text, '[$][0-9][0-9,.]*[KMBkmb]?'), regexp_extract_all(text, '[0-9]+([.][0-9]+)?%')) AS figures, list_concat(regexp_extract_all(resume, '[$][0-9][0-9,.]*[KMBkmb]?'), regexp_extract_all(resume, '[0-9]+([.][0-9]+)?%')) AS known FROM d),
c AS (SELECT doc_id, contains(lower(CASE WHEN len(lines) > 1 THEN array_to_string(lines[2:], chr(10)) ELSE text END), lower(source)) AS names_company, len(w) BETWEEN 280 AND 420 AS length, len(paragraphs) = 4 AS paragraphs, regexp_matches(text, '\d+[%xX]|\$[\d,.]+[MmKkBb]?|\d+\+|\d+\.\d+[xX]') AS has_metric,
             NOT regexp_matches(t, '\[[A-Za-z ]+\]|lorem ipsum|xxx') AS no_placeholder, NOT contains(t, 'kubernetes') AS no_forbidden, len([x FOR x IN figures IF NOT list_contains(known, x)]) = 0 AS grounded,
             NOT list_has_any(regexp_extract_all(text, '\d+[%xX]|\$[\d,.]+[MmKkBb]?'), regexp_extract_all(resume, '\d+[%xX]|\$[\d,.]+[MmKkBb]?'))
             AND (len(lw) < 6 OR len([i FOR i IN range(1, len(lw) - 4) IF contains(lower(resume), array_to_string(lw[i:i + 5], ' '))]) = 0) AS no_repetition FROM g)
SELECT doc_id, CAST(greatest(0, 100 - 8 * CAST(NOT names_company AS INT) - 3 * CAST(NOT length AS INT) - 3 * CAST(NOT paragraphs AS INT) - 3 * CAST(NOT has_metric AS INT) - 15 * CAST(NOT no_placeholder AS INT)
       - 15 * CAST(NOT no_forbidden AS INT) - 15 * CAST(NOT grounded AS INT) - 8 * CAST(NOT no_repetition AS INT)) AS INT) AS score,
       concat_ws(',', CASE WHEN NOT names_company THEN 'names_company' END, CASE WHEN NOT length THEN 'length' END, CASE WHEN NOT paragraphs THEN 'paragraphs' END, CASE WHEN NOT has_metric THEN 'has_metric' END,
       CASE WHEN NOT no_placeholder THEN 'no_placeholder' END, CASE WHEN NOT no_forbidden THEN 'no_forbidden_skill' END, CASE WHEN NOT grounded THEN 'figures_grounded' END, CASE WHEN NOT no_repetition THEN 'no_repetition' END) AS failed FROM c
"""


@query("document_checks", LETTER_SQL)
def document_checks(spark, read):
    resume = read("benchmark").groupBy().agg(F.min_by("text", "item_id").alias("resume"))
    docs = spread(read("documents").select("doc_id", "text", "source")).crossJoin(F.broadcast(resume))  # one row
    checks = S.document_checks(F.col("text"), F.col("resume"), F.col("source"), ("kubernetes",))
    return docs.select("doc_id", checks.alias("c")).select("doc_id", S.check_score(F.col("c")).alias("score"), F.array_join(F.transform(F.filter("c", lambda x: ~x["passed"]), lambda x: x["name"]), ",").alias("failed"))


REMOTE_SQL = P + """
, r AS (SELECT id, lower(location) AS l, lower(description) AS d, CASE id % 5 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid, Remote first' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'Berlin' END AS place,
               CASE id % 7 WHEN 0 THEN [] WHEN 1 THEN ['Main', 'Remote hub'] WHEN 2 THEN ['Hybrid house', 'Remote'] ELSE ['Main'] END AS offices,
               CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag, list_extract(['Remote', 'hybrid', 'OnSite', 'on-site', 'elsewhere', ''], CAST(id % 6 + 1 AS INT)) AS workplace FROM p),
q AS (SELECT *, lower(coalesce(place, '')) AS pl, coalesce(l, '') || ' ' || coalesce(d, '') || CASE id % 4 WHEN 0 THEN ' in-office' WHEN 1 THEN ' remote, hybrid' WHEN 2 THEN ' remote' ELSE '' END AS t FROM r)
SELECT id,
  CASE WHEN contains(pl, 'remote') AND contains(pl, 'hybrid') THEN 'hybrid' WHEN contains(pl, 'remote') THEN 'remote' WHEN contains(pl, 'hybrid') THEN 'hybrid'
       WHEN id % 7 = 1 THEN 'remote' WHEN id % 7 = 2 THEN 'hybrid' WHEN id % 7 > 0 THEN 'on_site' END AS of_place,
  CASE WHEN contains(t, 'remote') AND contains(t, 'hybrid') THEN 'hybrid' WHEN contains(t, 'remote') THEN 'remote' WHEN contains(t, 'onsite') OR contains(t, 'on-site') OR contains(t, 'in-office') THEN 'on_site' END AS of_text,
  CASE WHEN flag THEN 'remote' WHEN NOT flag AND contains(t, 'hybrid') THEN 'hybrid' WHEN NOT flag THEN 'on_site' END AS of_flag,
  CASE WHEN id % 11 IN (1, 2, 3) OR contains(pl, 'remote') THEN 'remote' WHEN contains(pl, 'hybrid') THEN 'hybrid' ELSE 'on_site' END AS of_row,
  CASE WHEN coalesce(flag, false) OR lower(workplace) = 'remote' THEN 'remote' WHEN workplace = 'hybrid' THEN 'hybrid' WHEN lower(workplace) IN ('onsite', 'on-site', '') THEN 'on_site' END AS of_workplace
FROM q
"""


@query("clearance_and_remote", REMOTE_SQL)
def clearance_and_remote(spark, read):
    """The work model by each of five sets of rules; places, offices, flags and kinds of workplace come by the id."""
    pick = lambda k, *values: F.get(F.array(*map(F.lit, values)), (F.col("id") % k).cast("int"))
    names = F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).when(F.col("id") % 7 == 1, F.array(F.lit("Main"), F.lit("Remote hub"))).when(F.col("id") % 7 == 2, F.array(F.lit("Hybrid house"), F.lit("Remote")))
    place, flag = pick(5, "Remote", "Hybrid, Remote first", "hybrid", "Berlin"), pick(3, True, False)
    text = F.concat(F.coalesce("location", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")), F.coalesce(pick(4, " in-office", " remote, hybrid", " remote"), F.lit("")))
    said = pick(11, "no", "True", "1", "yes", "false", "")
    return postings(spark, read).select(
        "id",
        T.remote_kind(place, names.otherwise(F.array(F.lit("Main")))).alias("of_place"),
        T.remote_kind_of_text(text).alias("of_text"),
        T.remote_kind_of_flag(flag, text).alias("of_flag"),
        T.remote_kind_of_row(said, place).alias("of_row"),
        T.remote_kind_of_workplace(flag, pick(6, "Remote", "hybrid", "OnSite", "on-site", "elsewhere", "")).alias("of_workplace"),
    )
