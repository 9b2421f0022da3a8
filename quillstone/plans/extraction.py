"""Requirements, duties, salaries and levels taken out of texts, for every posting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import extract as X
from quillstone.registry import query
from quillstone.sources.tables import POSTINGS_SQL, postings

P = f"WITH p AS ({POSTINGS_SQL}) "
#: A description with lists and sections for three of five postings, the document's text for the others; the same in both engines.
JD = (
    "CASE id % 5 WHEN 0 THEN concat('Intro', chr(10), 'Requirements:', chr(10), '- Python and SQL.', chr(10), '* python and sql', chr(10), '2) Degree in ', title, chr(10), 'Benefits', chr(10), '- free ', company) "
    "WHEN 1 THEN concat('- ', title, ' at ', company, chr(10), '- second item here, saving 30% and 12 hours', chr(10), 'Third Line Of A Text here, the longest one') "
    "WHEN 2 THEN concat('We need experience with ', title, '. Short. Knowledge of ', lower(company), '.', chr(10), 'ability to read') ELSE description END"
)
J = P + f", j AS (SELECT *, {JD} AS jd FROM p) "
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _described(spark, read):
    return postings(spark, read).withColumn("jd", F.expr(JD))


REQUIREMENTS_SQL = J + rf"""
, s AS (SELECT id, CASE WHEN regexp_matches(lower(jd), '{X.SECTION}') THEN regexp_extract(lower(jd), '{X.SECTION}', 1) ELSE jd END AS sec FROM j),
i AS (SELECT id, sec, regexp_extract_all(sec, '{X.ITEM}', 1) AS items FROM s),
t AS (SELECT id, CASE WHEN len(items) > 0 THEN items ELSE [x FOR x IN [{_strip("y")} FOR y IN string_split_regex(sec, '[.\n]+')] IF length(x) > 15 AND {_any("lower(x)", X.REQUIREMENT_WORDS)}] END AS xs FROM i),
u AS (SELECT id, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM t),
c AS (SELECT id, k, {_strip(f"regexp_replace({_strip('x')}, '[.]+$', '')")} AS x FROM u),
f AS (SELECT id, lower(x) AS l, arg_min(x, k) AS x, min(k) AS k FROM c WHERE x <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM f)
SELECT p.id, coalesce(string_agg(x, '|' ORDER BY k) FILTER (n <= 10), '') AS requirements FROM p LEFT JOIN r USING (id) GROUP BY p.id
"""


@query("key_requirements", REQUIREMENTS_SQL)
def key_requirements(spark, read):
    return _described(spark, read).select("id", F.array_join(X.key_requirements(F.col("jd")), "|").alias("requirements"))


DUTIES_SQL = J + rf"""
, m AS (SELECT id, jd, [x FOR x IN [{_strip("y")} FOR y IN regexp_extract_all(jd, '{X.BULLET}', 1)] IF length(x) BETWEEN 16 AND 299] AS marked FROM j),
l AS (SELECT id, marked, [x FOR x IN [{_strip("y")} FOR y IN string_split(jd, chr(10))] IF length(x) BETWEEN 21 AND 299 AND regexp_matches(x, '^[A-Z][a-z]+([^\p{{L}}\p{{N}}_]|$)') AND NOT list_contains(marked, x)] AS plain FROM m),
u AS (SELECT id, unnest(plain) AS x, generate_subscripts(plain, 1) AS k FROM l),
f AS (SELECT id, x, min(k) AS k FROM u GROUP BY 1, 2),
g AS (SELECT id, list(x ORDER BY k) AS plain FROM f GROUP BY id)
SELECT l.id, array_to_string(list_concat(l.marked, coalesce(g.plain, []))[1:50], '|') AS duties FROM l LEFT JOIN g USING (id)
"""


@query("duties", DUTIES_SQL)
def duties(spark, read):
    return _described(spark, read).select("id", F.array_join(X.duties(F.col("jd")), "|").alias("duties"))


SIGNALS = {"technical": ("python", "sql", "data"), "process": ("saving", "deliver"), "people": ("team", "lead")}
ACHIEVEMENTS_SQL = P + r"""
, a AS (SELECT id, 'Led ' || lower(title) || ' work for ' || company || ', a line of its own' AS line FROM p)
SELECT id, 3 AS n, 'Built a data pipeline in python, 40% faster' AS first_what, 'python, data' AS first_how, '40%' AS first_result, 'technical' AS first_category, CAST(0.9 AS DOUBLE) AS first_confidence,
       line AS last_what, CASE WHEN contains(line, 'data') THEN 'technical' WHEN contains(lower(line), 'lead') OR contains(lower(line), 'team') THEN 'people' ELSE 'technical' END AS last_category,
       CAST(0.6 AS DOUBLE) AS last_confidence FROM a
"""


@query("achievements", ACHIEVEMENTS_SQL)
def achievements(spark, read):
    """Statements of a resume of three achievements, one of them made of the posting."""
    resume = F.concat(
        F.lit("- Built a data pipeline in python, 40% faster\n- short\n* Mentored a team of five engineers for two years\nlowercase lines do not count, however long they are\n"),
        F.lit("Led "), F.lower("title"), F.lit(" work for "), F.col("company"), F.lit(", a line of its own"),
    )
    found = postings(spark, read).select("id", X.achievements(resume, SIGNALS).alias("a"))
    first, last = F.get("a", F.lit(0)), F.element_at("a", -1)
    return found.select(
        "id", F.size("a").alias("n"), *(first[c].alias(f"first_{c}") for c in ("what", "how", "result", "category", "confidence")), *(last[c].alias(f"last_{c}") for c in ("what", "category", "confidence"))
    )


#: What hiring comments say, and low and high in thousands of l and h as SQL.
COMMENTS = (("pays $%lk-$%hK", "l", "h"), ("$%l,000 - $%h,000 base", "l", "h"), ("around $%lK", "l", "NULL"), ("no figure", "NULL", "NULL"), ("$%lk to $%hk", "l", "h"))
_case = lambda k, n=len(COMMENTS): f"CASE id % {n} " + " ".join(f"WHEN {i} THEN {w[k]}" for i, w in enumerate(COMMENTS)) + " END"
PARSERS_SQL = P + f"""
, a AS (SELECT id, 100 + id * 7 % 19 AS l, 130 + id * 37 % 120 AS h FROM p)
SELECT id, CAST(1000 * ({_case(1)}) AS DOUBLE) AS comment_low, CAST(1000 * ({_case(2)}) AS DOUBLE) AS comment_high,
       CAST(CASE WHEN id % 5 = 1 THEN 1000 * l END AS DOUBLE) AS range_low, CAST(CASE WHEN id % 5 = 1 THEN 1000 * h END AS DOUBLE) AS range_high,
       CASE WHEN id % 4 <> 3 THEN CAST(1000 * l + 50 AS DOUBLE) / 100 END AS pay_low, CAST(10 * h AS DOUBLE) AS pay_high, CASE WHEN id % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
       CASE id % 4 WHEN 0 THEN 'yearly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'hourly' ELSE 'yearly' END AS period FROM a
"""


@query("salary_parsers", PARSERS_SQL)
def salary_parsers(spark, read):
    """Three sources' ways to give a salary; the expected values follow from the figures."""
    i = F.col("id")
    low, high = (100 + i * 7 % 19), (130 + i * 37 % 120)
    text = F.element_at(F.array(*(F.lit(c[0]) for c in COMMENTS)), (i % len(COMMENTS) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("%l"), low.cast("string")), F.lit("%h"), high.cast("string"))
    pay = F.struct(
        F.when(i % 4 != 3, low * 1000 + 50).alias("min"), (high * 1000).alias("max"), F.when(i % 2 == 0, "EUR").otherwise(F.when(i % 3 == 0, "")).alias("currency"),
        F.when(i % 4 == 0, "Year").when(i % 4 == 1, "month").when(i % 4 == 2, "hour").alias("interval"),
    )
    c, r, g = X.comment_salary(text), X.range_salary(text), X.pay_salary(pay)
    return postings(spark, read).select(
        "id", c["low"].alias("comment_low"), c["high"].alias("comment_high"), r["low"].alias("range_low"), r["high"].alias("range_high"),
        g["low"].alias("pay_low"), g["high"].alias("pay_high"), g["currency"].alias("currency"), g["period"].alias("period"),
    )


@query("salary_text_stats", P + ", a AS (SELECT id % 3 AS k, 80 + id * 7 % 19 AS l, 110 + id * 37 % 120 AS h FROM p) SELECT CAST(min(1000 * l) AS DOUBLE) AS least, CAST(max(CASE WHEN k = 0 THEN 1000 * h ELSE 1000 * l END) AS DOUBLE) AS most, round(avg(1000.0 * l), 4) AS mean_low, round(avg(CASE WHEN k = 0 THEN 1000.0 * h ELSE 1000.0 * l END), 4) AS mean_high, count(*) AS with_salary FROM a WHERE k < 2")
def salary_text_stats(spark, read):
    """Ranges, single figures and texts without any, over all postings in one pass."""
    low, high = ((k + F.col("id") * m % n).cast("string") for k, m, n in ((80, 7, 19), (110, 37, 120)))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("$"), low, F.lit(",000 - $"), high, F.lit(",000"))).when(F.col("id") % 3 == 1, F.concat(F.lit("from $"), low, F.lit(",000"))).otherwise("Not specified")
    s = postings(spark, read).select(X.salary_figures(text).alias("s")).filter("s is not null").select("s.low", "s.high")
    return s.agg(F.min("low").alias("least"), F.max("high").alias("most"), F.round(F.avg("low"), 4).alias("mean_low"), F.round(F.avg("high"), 4).alias("mean_high"), F.count(F.lit(1)).alias("with_salary"))


CLEARANCES = ("needs Top Secret access", "a secret clearance", "Public Trust position", "clearance is a plus", "near Ballston station", "nothing")
CLEARANCE_SQL = P + f"SELECT id, CASE id % 6 WHEN 0 THEN 'top_secret' WHEN 1 THEN 'secret' WHEN 2 THEN 'public_trust' WHEN 3 THEN 'required' END AS level, CASE WHEN id % 6 = 4 OR {_any('lower(location)', X.METRO_WORDS)} THEN 1 END AS metro FROM p"


@query("clearance_levels", CLEARANCE_SQL)
def clearance_levels(spark, read):
    said = F.element_at(F.array(*map(F.lit, CLEARANCES)), (F.col("id") % 6 + 1).cast("int"))
    return postings(spark, read).select("id", X.clearance_level(said).alias("level"), X.metro_accessible(F.col("location"), said).cast("int").alias("metro"))


LEVEL_TITLES = ("Principal Scientist", "Sr. Engineer", "Engineer II", "Junior Analyst", "Director of Data", "VP Sales", "Engineer", "Lead Architect", "Data Associate")
LEVELS_SQL = P + f"""
, a AS (SELECT id, list_element({list(LEVEL_TITLES)}, CAST(id % {len(LEVEL_TITLES)} + 1 AS BIGINT)) AS t FROM p)
SELECT id, CASE id % 9 WHEN 0 THEN 'senior' WHEN 1 THEN 'senior' WHEN 2 THEN 'mid' WHEN 3 THEN 'entry' WHEN 4 THEN 'director' WHEN 5 THEN 'director' WHEN 7 THEN 'senior' WHEN 8 THEN 'entry' END AS board_level,
       CASE id % 9 WHEN 0 THEN 'principal' WHEN 1 THEN 'senior' WHEN 7 THEN 'principal' ELSE 'default' END AS salary_level FROM a
"""


@query("title_levels", LEVELS_SQL)
def title_levels(spark, read):
    title = F.element_at(F.array(*map(F.lit, LEVEL_TITLES)), (F.col("id") % len(LEVEL_TITLES) + 1).cast("int"))
    return postings(spark, read).select("id", X.experience_level(title).alias("board_level"), X.role_level(title).alias("salary_level"))


HEADLINES = ("Engineer at Acme Labs | Cloud", "CTO @ Blue-Sky", "Working for Nimbus", "Design with Umbra / Lab", "Coder", "")
HEADLINES_SQL = P + "SELECT id, CASE id % 6 WHEN 0 THEN 'Acme Labs' WHEN 1 THEN 'Blue' WHEN 2 THEN 'Nimbus' WHEN 3 THEN 'Umbra' END AS company FROM p"


@query("headline_companies", HEADLINES_SQL)
def headline_companies(spark, read):
    line = F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("id") % len(HEADLINES) + 1).cast("int"))
    return postings(spark, read).select("id", X.headline_company(line).alias("company"))


ROLE_HEADLINES = ("Senior Data Engineer at Acme Labs | Cloud", "CTO @ Blue-Sky", "VP Growth / o'brien product lead", "Painter with hands", "", "Very long words before the one that counts here: head of Platform and what comes after it for years")
ROLES_SQL = P + r"""
, h AS (SELECT id, lower(list_extract(['Senior Data Engineer at Acme Labs | Cloud', 'CTO @ Blue-Sky', 'VP Growth / o''brien product lead', 'Painter with hands', '', 'Very long words before the one that counts here: head of Platform and what comes after it for years'], CAST(id % 6 + 1 AS INT))) || ' ' || left(lower(description), 25) AS t FROM p),
w AS (SELECT id, t, list_extract([x FOR x IN ['engineer', 'engineering', 'developer', 'architect', 'manager', 'management', 'head of', 'lead', 'director', 'directeur', 'ceo', 'cto', 'cfo', 'chief', 'vp', 'president', 'consultant', 'consulting', 'advisor', 'analyst', 'analytics', 'research', 'designer', 'design', 'ux', 'ui', 'sales', 'account', 'business development', 'marketing', 'brand', 'growth', 'content', 'product', 'program', 'project', 'operations', 'ops', 'operational', 'hr', 'human resources', 'talent', 'recruiting'] IF contains(t, x)], 1) AS w FROM h),
f AS (SELECT *, instr(t, w) AS a FROM w),
q AS (SELECT id, w, regexp_replace(regexp_replace(substring(t, greatest(a - 30, 1), a - greatest(a - 30, 1)), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') || ' ' || regexp_replace(substring(t, a, length(w) + 30), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g'), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g') AS x FROM f),
s AS (SELECT id, w, regexp_replace(list_extract(string_split_regex(x, 'at|for|with|\||-|@'), 1), '[ \t\r\n\f]+$', '') AS x FROM q)
SELECT id, CASE WHEN w IS NOT NULL THEN array_to_string([upper(y[1]) || y[2:] FOR y IN regexp_extract_all(x, '[\p{L}]+|[^\p{L}]+')], '') END AS role FROM s
"""


@query("headline_roles", ROLES_SQL)
def headline_roles(spark, read):
    """The role phrase of headlines by the id, each with the beginning of its description behind it."""
    line = F.get(F.array(*map(F.lit, ROLE_HEADLINES)), (F.col("id") % 6).cast("int"))
    return postings(spark, read).select("id", X.headline_role(F.concat(line, F.lit(" "), F.substring("description", 1, 25))).alias("role"))
