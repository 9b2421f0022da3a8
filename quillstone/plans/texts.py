"""Text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions.dates import parsed
from quillstone.operators.relational import keep_first
from quillstone.operators.screening import SPECIFIC_PATTERNS, VAGUE_PHRASES, specificity
from quillstone.operators.similarity import containing, shared_phrases
from quillstone.registry import query
from quillstone.session import spread
from quillstone.sources.tables import unified

ENTITY_SQL = "replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"


@query("clean_html_pages", "SELECT page_id, trim(regexp_replace(" + ENTITY_SQL.format(r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')") + r", '[ \n\t\r]+', ' ', 'g')) AS text FROM pages")
def clean_html_pages(spark, read):
    return read("pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("html_title", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, read):
    return read("pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query("html_links", "SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)")
def html_links(spark, read):
    links = read("pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("l"))
    return links.select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"))


@query("url_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://[^/]+(/.*)?$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def url_parts(spark, read):
    return read("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), T.slug(F.regexp_extract("url", "^https?://[^/]+(/.*)?$", 1)).alias("slug"))


def _replaced(x: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_BLANK = r"[ \t\n\r\f\x0B]"
CLEANED_SQL = "SELECT page_id, " + _replaced(
    "html", (r"(?i)<br[ \t\n\r\f\x0B]*/?>", "\n"), ("(?i)</(?:p|div|li|tr|h[1-6])>", "\n"), (r"(?i)<(?:p|div|li|tr|h[1-6])(?:[^\p{L}\p{N}_>][^>]*)?>", ""), ("<[^>]+>", " "),
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&rsquo;|&lsquo;|&#8217;|&#8216;", "''"), ("&rdquo;|&ldquo;|&#8220;|&#8221;", '"'), ("&mdash;|&#8212;", "—"),
    ("&ndash;|&#8211;", "–"), (r"&#\d+;", ""), (r"&[\p{L}\p{N}_]+;", ""), (r"\*{2,3}(.+?)\*{2,3}", r"\1"), (r"_{2,3}(.+?)_{2,3}", r"\1"), (r"\\([*\-\.#\[\]\(\)&!>`~|])", r"\1"),
    (rf"(?m)^#{{1,6}}{_BLANK}+", ""), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^\)]+\)", r"\1"), (rf"(?m)^\\?\*{_BLANK}+", "• "), ("`([^`]+)`", r"\1"),
    (rf"(?m)^[-*_]{{3,}}{_BLANK}*$", ""), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (rf"^{_BLANK}+|{_BLANK}+$", ""),
) + " AS text FROM pages"
#: Marks that the pages themselves may lack, after each page's markup.
MARKS = r"""
&lt;b&gt; &amp;amp; &quot;x&quot; &rsquo;tis &ldquo;so&rdquo; &#8212; &ndash; &#169; &copy; <pre>kept</pre><P class="x">one<LI>two</li>
## Heading
**bold** ***both*** __under__ a__b__c \*not\* \[x\] ![alt](u) [link](v) `code`
* item
\* other
---
_ _ _
*** 
end <br / > <br/> 
"""


@query("description_cleaner", f"WITH pages AS (SELECT page_id, html || '{MARKS}' AS html FROM pages) {CLEANED_SQL}")
def description_cleaner(spark, read):
    return read("pages").select("page_id", T.clean_description(F.concat("html", F.lit(MARKS))).alias("text"))


@query("page_text_probe", r"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<(script|style).*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \n\t\r]+', ' ', 'g')) AS txt FROM pages) SELECT page_id, CASE WHEN length(txt) < 500 THEN 'inconclusive' WHEN contains(txt, 'contact') THEN 'found' ELSE 'missing' END AS probe FROM t")
def page_text_probe(spark, read):
    txt = T.squeeze(F.regexp_replace(F.regexp_replace(F.lower("html"), r"(?s)<(script|style).*?</(script|style)>", " "), "<[^>]*>", " "))
    return read("pages").select("page_id", txt.alias("txt")).select("page_id", F.when(F.length("txt") < 500, "inconclusive").when(F.col("txt").contains("contact"), "found").otherwise("missing").alias("probe"))


TERMS = ("the", "tion", "que", "ing", "die")


def _hit(t: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" if len(t) <= 3 else f"contains(lower(text), '{t}')"


@query("keyword_hits", "SELECT doc_id, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {_hit(t)} THEN '{t}' END" for t in sorted(TERMS)) + "] IF x IS NOT NULL], ',') AS hits FROM documents")
def keyword_hits(spark, read):
    return spread(read("documents").select("doc_id", "text")).select("doc_id", F.array_join(T.hits(F.lower("text"), TERMS), ",").alias("hits"))


#: Terms searched for, and those of them that are whole words whatever their length; typed for the SQL.
STACK_TERMS = ("access", "api", "ci/cd", "es", "etl", "go", "in", "lead", "next", "node.js", "python", "r", "rest", "tion", "vault")
STACK_WHOLE = ("access", "api", "es", "etl", "go", "in", "lead", "next", "r", "rest", "vault")


@query("bounded_hits", "SELECT doc_id, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(t, '(^|[^a-z0-9]){x}([^a-z0-9]|$)') THEN '{x}' END" if x in STACK_WHOLE else f"CASE WHEN contains(t, '{x}') THEN '{x}' END" for x in STACK_TERMS) + "] IF x IS NOT NULL], ',') AS hits FROM (SELECT doc_id, lower(text) || ' rest, restore' || CASE WHEN doc_id % 2 = 0 THEN ' go-to next' ELSE ' ongoing leader vaults' END AS t FROM documents)")
def bounded_hits(spark, read):
    """Terms as whole words where they are short or known to be parts of other words; two endings by the id add some of either."""
    t = F.concat(F.lower("text"), F.lit(" rest, restore"), F.when(F.col("doc_id") % 2 == 0, " go-to next").otherwise(" ongoing leader vaults"))
    return read("documents").select("doc_id", F.array_join(T.hits(t, STACK_TERMS, bounded=T.BOUNDED), ",").alias("hits"))


YEARS_SQL = r"""
WITH t AS (SELECT doc_id, lower(text) || CASE doc_id % 5 WHEN 0 THEN ' (2015-2020) and 3+ years' WHEN 1 THEN ' (2019 – present)' WHEN 2 THEN ' 12 years of experience' WHEN 3 THEN ' 4+ years experience, (2001-2003)' ELSE '' END AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '\(([0-9]{4}) *[-–—] *([0-9]{4}|present)\)', 1) AS a, regexp_extract_all(t, '\(([0-9]{4}) *[-–—] *([0-9]{4}|present)\)', 2) AS b, regexp_extract_all(t, '([0-9]{1,3})[+]? *years', 1) AS y, regexp_extract_all(t, '([0-9]{1,3})[+]? *years? *(of +)?experience', 1) AS e FROM t)
SELECT doc_id, coalesce(greatest(list_max([CASE b[i] WHEN 'present' THEN 2026 ELSE CAST(b[i] AS INT) END - CAST(a[i] AS INT) FOR i IN range(1, len(a) + 1)]), list_max([CAST(x AS INT) FOR x IN y])), 0) AS has, coalesce(list_max([CAST(x AS INT) FOR x IN e]), 0) AS asks FROM s
"""


@query("years_named", YEARS_SQL)
def years_named(spark, read):
    """The longest time that a text names and the years that it asks for; endings by the id name some."""
    k = F.col("doc_id") % 5
    end = F.when(k == 0, " (2015-2020) and 3+ years").when(k == 1, " (2019 – present)").when(k == 2, " 12 years of experience").when(k == 3, " 4+ years experience, (2001-2003)").otherwise("")
    t = F.concat(F.lower("text"), end)
    return read("documents").select("doc_id", T.max_years(t, 2026).alias("has"), T.required_years(t).alias("asks"))


SKILLS_SQL = """
WITH k AS (SELECT unnest(['Node.js', 'CI/CD', 'de la', 'Trust', 'well-known', 'React thing', 'that', 'o-f', 'zz.js']) AS skill),
s AS (SELECT doc_id, lower(text) AS t, lower(skill) AS s, string_split(lower(skill), ' ') AS w FROM documents, k),
v AS (SELECT *, [replace(s, '.', ''), replace(s, '.js', ''), replace(s, ' ', ''), replace(s, '-', ' '), replace(s, '/', '')] AS v, list_extract(list_filter(w, lambda x: length(x) = list_max([length(y) FOR y IN w])), 1) AS longest FROM s)
SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS skills FROM v
WHERE s NOT IN ('trust', 'safety', 'privacy', 'governance', 'compliance', 'strategy', 'leadership', 'communication', 'mentoring', 'collaboration', 'innovation', 'passion', 'creativity', 'accountability', 'transparency', 'integrity', 'diversity', 'inclusion', 'payments', 'fintech', 'crypto', 'web3')
  AND (contains(t, s) OR len(w) >= 2 AND length(longest) >= 3 AND contains(t, longest) OR len([x FOR x IN v IF length(x) >= 2 AND contains(t, x)]) > 0) GROUP BY 1
"""


@query("validated_skills", SKILLS_SQL)
def validated_skills(spark, read):
    """Of some skills those that each text bears out, also by their longest word or another spelling."""
    skills = F.array(*map(F.lit, ("Node.js", "CI/CD", "de la", "Trust", "well-known", "React thing", "that", "o-f", "zz.js")))
    docs = read("documents").select("doc_id", F.lower("text").alias("t"))
    kept = docs.select("doc_id", F.array_sort(F.transform(F.filter(skills, lambda s: T.skill_in_source(s, F.col("t"))), F.lower)).alias("k")).filter(F.size("k") > 0)
    return kept.select("doc_id", F.size("k").cast("long").alias("n"), F.array_join("k", ",").alias("skills"))


def _sum(parts: list[str]) -> str:
    return " + ".join(f"CAST({p} AS INT)" for p in parts)


SPECIFIC_SQL = "WITH s AS (SELECT doc_id, length(text) AS n, " + _sum([f"regexp_matches(lower(text), '{p}')" for p in SPECIFIC_PATTERNS]) + " AS sharp, " + _sum([f"contains(lower(text), '{p}')" for p in VAGUE_PHRASES]) + " AS vague FROM documents) SELECT doc_id, CASE WHEN n < 50 THEN 0.1 WHEN sharp + vague = 0 THEN 0.5 ELSE round(sharp / (sharp + vague), 2) END AS score FROM s"


@query("specificity_score", SPECIFIC_SQL)
def specificity_score(spark, read):
    return read("documents").select("doc_id", specificity(F.col("text")).cast("double").alias("score"))


HASH_SQL = r"left(sha256(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 16)"


@query("repost_groups", f"SELECT {HASH_SQL} AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def repost_groups(spark, read):
    return read("documents").groupBy(T.undated_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("content_keys", "SELECT doc_id, left(sha256('posting:' || text), 32) AS key, md5(source || '|' || lang) AS cache_key FROM documents")
def content_keys(spark, read):
    return read("documents").select("doc_id", T.content_key("posting", F.col("text")).alias("key"), F.md5(F.concat_ws("|", "source", "lang")).alias("cache_key"))


NGRAM_SQL = r"WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[ \n\t\r]+', ' ', 'g')), ' ') AS w FROM documents), b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[ \n\t\r]+', ' ', 'g')), ' ') AS w FROM benchmark), dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 6)), bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+5], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM b WHERE len(w) >= 6)) SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY 1, 2"


@query("ngram_overlap", NGRAM_SQL)
def ngram_overlap(spark, read):
    return shared_phrases(spread(read("documents").select("doc_id", "text")), read("benchmark"), "doc_id", "item_id")


@query("word_overlap_ratio", "WITH b AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) SELECT doc_id, round(len(list_intersect(d.w, b.w)) / len(b.w), 4) AS share FROM d, b")
def word_overlap_ratio(spark, read):
    one = read("benchmark").groupBy().agg(F.min_by("text", "item_id").alias("t")).select(T.words(F.col("t")).alias("want"))  # one row
    return read("documents").crossJoin(F.broadcast(one)).select("doc_id", F.round(T.overlap_share(T.words(F.col("text")), F.col("want")), 4).alias("share"))


@query("figures", "SELECT page_id, len(regexp_extract_all(html, '[$][0-9][0-9,.]*[KMBkmb]?')) AS dollars, len(regexp_extract_all(html, '[0-9]+([.][0-9]+)?%')) AS percents FROM pages")
def figures(spark, read):
    return read("pages").select("page_id", F.size(T.dollar_figures(F.col("html"))).cast("long").alias("dollars"), F.size(T.percentages(F.col("html"))).cast("long").alias("percents"))


@query("first_lines", r"SELECT doc_id, split_part(text, chr(10), 1) AS head, left(text, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS short FROM documents")
def first_lines(spark, read):
    return read("documents").select("doc_id", F.substring_index("text", "\n", 1).alias("head"), F.concat(F.left("text", F.lit(80)), F.when(F.length("text") > 80, "...").otherwise("")).alias("short"))


@query("min_length_filter", "SELECT doc_id FROM documents WHERE length(text) >= 200 AND source IS NOT NULL AND lang <> ''")
def min_length_filter(spark, read):
    return read("documents").filter((F.length("text") >= 200) & T.present(F.col("source")).isNotNull() & T.present(F.col("lang")).isNotNull()).select("doc_id")


@query("include_exclude", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(text), 'que')) AND NOT contains(lower(text), 'lorem') AND NOT contains(lower(text), 'the ')")
def include_exclude(spark, read):
    low = F.lower("text")
    return read("documents").filter(T.any_term(low, ("tion", "que")) & ~T.any_term(low, ("lorem", "the "))).select("doc_id")


@query("alias_projection", "SELECT CAST(page_id AS VARCHAR) AS id, url AS job_url, html AS description FROM pages")
def alias_projection(spark, read):
    raw = read("pages").select(F.col("page_id").alias("job_id"), F.col("url"), F.col("html").alias("job_description"), F.lit("").alias("summary"))
    return unified(raw).select("id", "job_url", "description")


@query("date_formats", "SELECT DISTINCT o_orderdate AS iso, o_orderdate AS slashed, o_orderdate AS epoch FROM orders")
def date_formats(spark, read):
    d = read("orders").select("o_orderdate").distinct()
    epoch = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")
    return d.select(parsed(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), parsed(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("slashed"), parsed(epoch).alias("epoch"))


NAMES_SQL = """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Trade ' || s_name || '|' || s_name || '|' || s_name || ', LLC|' || s_name || ', LLC, d/b/a Trade ' || s_name
  WHEN 1 THEN s_name || ' (US)|' || s_name || '|' || s_name || ' (US) Inc.' WHEN 2 THEN s_name ELSE s_name || '|' || s_name || ' GmbH' END AS candidates FROM supplier
"""


@query("company_names", NAMES_SQL)
def company_names(spark, read):
    """Suppliers under trading names, with suffixes and with parentheses."""
    s, k = F.col("s_name"), F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat(s, F.lit(", LLC, d/b/a Trade "), s)).when(k == 1, F.concat(s, F.lit(" (US) Inc."))).when(k == 2, s).otherwise(F.concat(s, F.lit(" GmbH")))
    return read("supplier").select("s_suppkey", F.array_join(T.company_candidates(name), "|").alias("candidates"))


@query("dedup_training_rows", "SELECT lower(source) AS s, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def dedup_training_rows(spark, read):
    return keep_first(read("documents").select(F.lower("source").alias("s"), "lang", "doc_id"), ["s", "lang"], "doc_id")


@query("phrase_in_source", "SELECT doc_id, count(*) AS n FROM documents JOIN benchmark b ON contains(documents.text, b.text) GROUP BY 1")
def phrase_in_source(spark, read):
    """Another name for item_in_source."""
    return item_in_source(spark, read)


@query("item_in_source", "SELECT doc_id, count(*) AS n FROM documents JOIN benchmark b ON contains(documents.text, b.text) GROUP BY 1")
def item_in_source(spark, read):
    """Documents that have a whole benchmark item, with how many; ngram_overlap finds every shared phrase of six words."""
    return _having(read("documents"), read("benchmark").select(F.col("text").alias("needle")))


def _having(docs, items):
    return containing(spread(docs.select("doc_id", "text")), items, "doc_id", "needle").groupBy("doc_id").agg(F.sum("times").alias("n"))
