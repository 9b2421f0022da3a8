"""Texts read line by line: formatted descriptions, sections and roles of résumés, fillers taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import lines as L
from quillstone.registry import query

_SHAPED = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, '. ', chr(10) || chr(10)) ELSE replace(replace(text, ', ', chr(10) || chr(10)), '. ', '.' || chr(10)) END AS t FROM documents"
FORMATTED_SQL = (
    f"WITH x AS ({_SHAPED}), "
    + r"""
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM x),
s AS (SELECT *, regexp_replace(raw, '^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$', '', 'g') AS s FROM l),
n AS (SELECT *, first_value(CASE WHEN s <> '' THEN length(s) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_length,
        coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY i), '') = '' AND coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), '') = '' AS alone,
        length(s) > 300 AND length(s) - length(replace(s, '.', '')) > 3 AS long FROM s),
h AS (SELECT *, s <> '' AND NOT regexp_matches(s, '^[•–▪*►-]') AND length(s) <= 80 AND NOT regexp_matches(s, '[.,;!?]$') AND (next_length IS NULL OR next_length > length(s)) AS short FROM n),
g AS (SELECT *, CASE WHEN short THEN true WHEN s <> '' AND (NOT alone OR long) THEN false END AS signal FROM h),
o AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS open FROM g),
k AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN short AND (NOT open OR length(s) <= 40) THEN 'heading' WHEN short OR open AND alone AND NOT long THEN 'item' ELSE 'text' END AS kind FROM o),
r AS (SELECT *, coalesce(first_value(CASE WHEN kind <> 'blank' THEN kind IN ('heading', 'item') OR regexp_matches(s, '^[•–▪►]') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS next_listed FROM k),
e AS (SELECT *, replace(replace(replace(replace(replace(CASE WHEN kind IN ('heading', 'item') THEN s ELSE raw END, '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), '''', '&#39;'), '"', '&#34;') AS x FROM r),
a AS (SELECT doc_id, CAST(count(*) FILTER (kind = 'heading') AS BIGINT) AS n_headings, CAST(count(*) FILTER (kind = 'item') AS BIGINT) AS n_items,
        string_agg(CASE kind WHEN 'heading' THEN '<strong>' || x || '</strong>' WHEN 'item' THEN '  • ' || x ELSE x END, chr(10) ORDER BY i) FILTER (kind <> 'blank' OR NOT next_listed) AS html FROM e GROUP BY 1)
SELECT d.doc_id, CASE WHEN coalesce(t, '') = '' THEN 0 ELSE n_headings END AS n_headings, CASE WHEN coalesce(t, '') = '' THEN 0 ELSE n_items END AS n_items,
  CASE WHEN coalesce(t, '') = '' THEN 'No description available.' ELSE coalesce(html, '') END AS html FROM x d LEFT JOIN a USING (doc_id)
"""
)


def shaped(docs: DataFrame) -> DataFrame:
    """doc_id and t: the texts with their sentences as paragraphs, or as short lines, by the id."""
    k, two = F.col("doc_id") % 3, F.lit("\n\n")
    lines = F.replace(F.replace("text", F.lit(", "), two), F.lit(". "), F.lit(".\n"))
    return docs.select("doc_id", F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit(". "), two)).otherwise(lines).alias("t"))


@query("formatted_descriptions", FORMATTED_SQL)
def formatted_descriptions(spark, read):
    return L.formatted(shaped(read("documents")), "doc_id", "t").withColumnRenamed("key", "doc_id")


BASE = "A robust plan, robust and robust; dynamic once."
FILLERS_SQL_WORDS = ("analytical", "comprehensive", "systematic", "strategic", "robust", "scalable", "innovative", "cutting-edge", "dynamic", "holistic", "enterprise-grade")


def _fillers_sql() -> str:
    """One step for each word; each reads the text that the one before it left."""
    out = "WITH t0 AS (SELECT doc_id, replace(replace(replace(text, ' de ', ' Robust '), ' the ', ' dynamic '), ' la ', ' cutting-edge ') AS t FROM documents)"
    for k, word in enumerate(FILLERS_SQL_WORDS):
        allowed = len([x for x in BASE.lower().replace(",", " ").replace(";", " ").replace(".", " ").split() if x == word]) <= 1
        out += rf""",
l{k} AS (SELECT doc_id, t, string_split(t, chr(10)) AS l, CASE WHEN {allowed} AND len(regexp_extract_all(t, '(?i)\b{word}\b')) > 3 THEN len(regexp_extract_all(t, '(?i)\b{word}\b')) - 2 ELSE 0 END AS n FROM t{k}),
p{k} AS (SELECT *, list_reverse([i FOR i IN range(1, len(l) + 1) IF regexp_matches(l[i], '(?i)\b{word}[ \t\r\f\x0B]+')])[1:n] AS c FROM l{k}),
t{k + 1} AS (SELECT doc_id, CASE WHEN n > 0 THEN array_to_string([CASE WHEN list_contains(c, i) THEN regexp_replace(l[i], '(?i)\b{word}[ \t\r\f\x0B]+', '') ELSE l[i] END FOR i IN range(1, len(l) + 1)], chr(10)) ELSE t END AS t FROM p{k})"""
    return out + f" SELECT doc_id, t AS text FROM t{len(FILLERS_SQL_WORDS)}"


@query("stripped_fillers", _fillers_sql())
def stripped_fillers(spark, read):
    """Texts in which three common words were replaced by adjectives, without what is too many of them."""
    text = F.col("text")
    for word, by in ((" de ", " Robust "), (" the ", " dynamic "), (" la ", " cutting-edge ")):
        text = F.replace(text, F.lit(word), F.lit(by))
    return L.without_fillers(read("documents").select("doc_id", text.alias("text")), "text", F.lit(BASE))


def resumes(docs: DataFrame) -> DataFrame:
    """doc_id and t: each text's sentences under the headings and marks of a résumé."""
    s = F.split("text", r"\. ")
    at = lambda i: F.coalesce(F.get(s, F.lit(i)), F.lit("none"))
    pieces = ("Jane\n", at(0), "\n\nProfessional Summary:\n", at(1), "\nExperience\nintro line\n- ", at(2), "\n * ", at(3), "\n1. ", at(4), "\n– ", at(5), "\nafter it\nprojects\n", at(6), "\nSkills, all\n", at(7), "\nEDUCATION\n", at(8), "\nSkills again\n- ", at(9), "\nHonors", "")
    return docs.select("doc_id", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces)).alias("t"))


TRIMMED_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents),
p AS (SELECT doc_id, [coalesce(list_extract(s, i), 'none') FOR i IN range(1, 11)] AS p FROM s WHERE s IS NOT NULL),
r AS (SELECT doc_id, p[1] AS a, p[2] AS b, p[3] AS c, p[4] AS d, p[5] AS e, p[6] AS f, p[7] AS g, p[8] AS h, p[9] AS i, p[10] AS j FROM p),
t AS (SELECT doc_id, 'Jane' || chr(10) || a || chr(10) || chr(10) || 'Professional Summary:' || chr(10) || b || chr(10) || 'Experience' || chr(10) || 'intro line' || chr(10) || '- ' || c || chr(10) || ' * ' || d || chr(10) || '1. ' || e || chr(10) || '– ' || f
        || chr(10) || 'after it' || chr(10) || 'projects' || chr(10) || g || chr(10) || 'Skills, all' || chr(10) || h || chr(10) || 'EDUCATION' || chr(10) || i || chr(10) || 'Skills again' || chr(10) || '- ' || j || chr(10) || 'Honors' AS t FROM r),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM t),
n AS (SELECT *, regexp_replace(raw, '^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$', '', 'g') AS s FROM l),
m AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)^(summary|professional summary|objective|profile)') THEN 'summary' WHEN regexp_matches(s, '(?i)^(experience|work experience|employment|professional experience)') THEN 'experience'
        WHEN regexp_matches(s, '(?i)^(skills|technical skills|core competencies|technologies)') THEN 'technical_skills' WHEN regexp_matches(s, '(?i)^(education|academic|degrees)') THEN 'education'
        WHEN regexp_matches(s, '(?i)^(projects?|portfolio|personal projects|key projects)') THEN 'projects' WHEN regexp_matches(s, '(?i)^(certifications?|licenses?|credentials)') THEN 'certifications'
        WHEN regexp_matches(s, '(?i)^(awards?|honors?|achievements?)') THEN 'awards' END AS name FROM n),
w AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY i) AS block, coalesce(last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 'header') AS section FROM m),
f AS (SELECT *, max(block) OVER (PARTITION BY doc_id, section) = block AS is_last, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) AS k, regexp_matches(s, '^([-*•–]|[0-9]+\.)') AS bullet FROM w),
b AS (SELECT *, count(*) FILTER (bullet AND k > 1) OVER (PARTITION BY doc_id, block ORDER BY i) AS n_bullets FROM f WHERE is_last),
c AS (SELECT doc_id, section, string_agg(raw, chr(10) ORDER BY i) FILTER (section <> 'experience' OR k = 1 OR bullet AND n_bullets <= 3 OR NOT bullet AND n_bullets = 0) AS content FROM b GROUP BY 1, 2)
SELECT doc_id, string_agg(content, chr(10) || chr(10) ORDER BY list_position(['header', 'summary', 'experience', 'technical_skills', 'projects', 'education', 'certifications', 'awards'], section)) AS trimmed FROM c GROUP BY 1
"""


@query("trimmed_resumes", TRIMMED_SQL)
def trimmed_resumes(spark, read):
    """Résumés made of the documents' sentences, the section on experience cut down to three bullets."""
    return L.trimmed(resumes(read("documents").filter("text is not null")), "doc_id", "t", ("experience",)).withColumnRenamed("key", "doc_id")


def track_documents(docs: DataFrame) -> DataFrame:
    """doc_id and t: each text's sentences as roles and other parts of a reference document."""
    s = F.split("text", r"\. ")
    at = lambda i: F.coalesce(F.get(s, F.lit(i)), F.lit("none"))
    pieces = (
        "# Name\n", at(0), "\n### Acme → Data — January 2020 to May 2021\n**Arlington, VA (remote)**\n**Title:** Engineer ", F.col("doc_id").cast("string"), "  \n- ", at(1), "\n  - ", at(2), "\n- * note\n- Did not build ", at(3),
        "\n**Engineering stack:** python, sql\n### Cloud and more\n- ", at(4), "\n### No bullets — 2019\n", at(5), "\n### Plain company\n**Engineering Title:** Lead\n- ", at(6), "\n- ", at(7), "\n### — only dates\n- x",
    )
    return docs.select("doc_id", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces)).alias("t"))


TRACK_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents),
p AS (SELECT doc_id, [coalesce(list_extract(s, i), 'none') FOR i IN range(1, 9)] AS p FROM s WHERE s IS NOT NULL),
b AS (SELECT doc_id, [regexp_replace(x, '^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$', '', 'g') FOR x IN list_concat(['- ' || y FOR y IN string_split(p[2], chr(10))][1:1], [z FOR z IN string_split(p[2], chr(10))[2:]], ['- ' || string_split(p[3], chr(10))[1]], string_split(p[3], chr(10))[2:], ['- * note'], ['- Did not build ' || string_split(p[4], chr(10))[1]], string_split(p[4], chr(10))[2:])] AS first,
        [regexp_replace(x, '^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$', '', 'g') FOR x IN list_concat(['- ' || string_split(p[7], chr(10))[1]], string_split(p[7], chr(10))[2:], ['- ' || string_split(p[8], chr(10))[1]], string_split(p[8], chr(10))[2:])] AS last FROM p),
k AS (SELECT doc_id, len([x FOR x IN first IF starts_with(x, '- ') AND NOT starts_with(x, '- *') AND NOT regexp_matches(lower(x), 'scope boundaries|overall fastapi|did not build|deployments were')]) AS n1,
        len([x FOR x IN last IF starts_with(x, '- ') AND NOT starts_with(x, '- *') AND NOT regexp_matches(lower(x), 'scope boundaries|overall fastapi|did not build|deployments were')]) AS n2 FROM b)
SELECT doc_id, 'Acme → Data' AS company, 'January 2020 to May 2021' AS dates, 'Engineer ' || CAST(doc_id AS VARCHAR) AS title, 'Arlington, VA (remote)' AS location, CAST(n1 AS INT) AS n_bullets, 'python, sql' AS stack FROM k WHERE n1 > 0
UNION ALL SELECT doc_id, 'Plain company', '', 'Lead', '', CAST(n2 AS INT), '' FROM k WHERE n2 > 0
"""


@query("track_roles", TRACK_SQL)
def track_roles(spark, read):
    """The roles of reference documents made of the documents' sentences."""
    found = track_documents(read("documents").filter("text is not null")).select("doc_id", F.explode(L.roles(F.col("t"))).alias("r"))
    return found.select("doc_id", "r.company", "r.dates", "r.title", "r.location", F.size("r.bullets").alias("n_bullets"), "r.stack")
