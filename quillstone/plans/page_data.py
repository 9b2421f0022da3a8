"""Postings out of page data: nested objects, caches of entries, chains of parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.registry import query
from quillstone.sources import page_data as D

#: Page data by page_id: the tables' pages have none of their own. {id} and {t} stand for the page's id and title.
SHAPES = (
    '{"props":{"pageProps":{"jobs":[{"id":"{id}","title":"{t}","employer":"E{id}"},{"id":"b","title":"{t} b","company":null}]}},"buildId":"x"}',
    '{"props":{"pageProps":{"jobs":{"data":[{"title":"{t}","name_of_employer":"N"}],"title":"no list"}}}}',
    '{"props":{"pageProps":{"dehydratedState":{"queries":[{"state":{"data":{"pages":[[{"title":"{t} p"},{"x":1}],{"title":"{t} q","company":"c"}],"hits":[{"title":"h{id}"},{"no":2}]}}},{"state":{"data":[{"title":"{t} l"}]}}]}}}}',
    '{"props":{"pageProps":{"a":{"b":[{"c":{"title":"{t}","employer":"e","related":[{"title":"inner","company":"i"}]}},[[{"title":"{t} list","company":"l"}]]]},"title":"no employer"}}}',
    '{"props":{"pageProps":{"l1":{"l2":{"l3":{"l4":{"l5":{"l6":{"title":"six {id}","company":"c"},"m6":{"l7":{"title":"seven","company":"c"}}}}}}}}}}',
    '{"props":{"pageProps":{"title":"{t}","company":"whole","jobs":[],"x":{"title":"below","company":"b"}}}}',
    '{"props":{"pageProps":{"apolloState":{"data":{"Job:1":{"__typename":"JobListing","title":"{t}","company":{"__ref":"Co:1"}},"Co:1":{"__typename":"StartupResult","name":"First {id}","slug":"first","highlightedJobListings":[{"__ref":"Job:1"},{"__ref":"Job:9"},"odd"],"company":{"__ref":"Co:2"}},"Co:2":{"__typename":"StartupResult","name":"Second","slug":"second","highlightedJobListings":[{"__ref":"Job:1"},{"__ref":"Job:2"}],"company":{"__ref":"Co:1"}},"Job:2":{"title":"{t} two","slug":"two","Compensation":"10k","company":{"__ref":"Co:7"}},"Job:3":{"__typename":"JobListingSearchResult","title":null,"company":{"__ref":"Job:3"}},"Job:4":{"title":"{t}","slug":"no pay"},"n":5}}}}}',
    '{"props":{"pageProps": not json',
    "",
)


def pages_with_data(pages: DataFrame) -> DataFrame:
    """page_id and html of every page, with a script of page data that its id picks and its title fills in."""
    title = F.regexp_extract("html", r'<title>([^<"\\]*)', 1)
    shape = F.get(F.array(*map(F.lit, SHAPES)), (F.col("page_id") % len(SHAPES)).cast("int"))
    filled = F.replace(F.replace(shape, F.lit("{id}"), F.col("page_id").cast("string")), F.lit("{t}"), title)
    script = F.when(filled != "", F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), filled, F.lit("</script>"))).otherwise("")
    return pages.select("page_id", F.concat("html", script).alias("html"))


def _parsed(read) -> DataFrame:
    return pages_with_data(read("pages")).select("page_id", "html", D.page_json(F.col("html")).alias("json"))


_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SHAPES) + "]"
FILLED_SQL = f"""
WITH h AS (SELECT page_id, html, regexp_extract(html, '<title>([^<"\\\\]*)', 1) AS title FROM pages),
j AS (SELECT page_id, html, replace(replace(list_extract({_LIST}, CAST(page_id % {len(SHAPES)} + 1 AS INT)), '{{id}}', CAST(page_id AS VARCHAR)), '{{t}}', title) AS json FROM h),
d AS (SELECT page_id, CAST(json AS JSON) AS d FROM j WHERE json_valid(json))
"""
WALK_SQL = """
, n AS (SELECT page_id, t.value AS v, t.type, t.fullkey, len(regexp_extract_all(t.fullkey, '[.][A-Za-z0-9_]+|\\[[0-9]+\\]')) AS depth FROM d, json_tree(d.d -> '$.props.pageProps') t),
m AS (SELECT * FROM n WHERE type = 'OBJECT' AND list_contains(json_keys(v), 'title') AND len(list_intersect(json_keys(v), ['name_of_employer', 'employer', 'company'])) > 0),
w AS (SELECT * FROM m WHERE depth <= 6 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.page_id = m.page_id AND o.fullkey <> m.fullkey AND (starts_with(m.fullkey, o.fullkey || '.') OR starts_with(m.fullkey, o.fullkey || '['))))
"""


@query("page_data_walk", FILLED_SQL + WALK_SQL + "SELECT page_id, v ->> '$.title' AS title, coalesce(v ->> '$.name_of_employer', v ->> '$.employer', v ->> '$.company') AS employer FROM w")
def page_data_walk(spark, read):
    """Every object in a page's data that has a title and an employer, at any place down to six levels."""
    rows = _parsed(read).select("page_id", D.at(F.try_parse_json("json"), "$.props.pageProps").alias("root"))
    jobs = D.posting_objects(rows, "root").select("page_id", F.explode("found").alias("v"))
    return jobs.select("page_id", D.at(F.col("v"), "$.title", "string").alias("title"), F.coalesce(*(D.at(F.col("v"), f"$.{k}", "string") for k in D.EMPLOYERS)).alias("employer"))


CACHE_SQL = """
, e AS (SELECT page_id, t.key, t.value AS v FROM d, json_each(d.d -> '$.props.pageProps.apolloState.data') t WHERE t.type = 'OBJECT'),
c AS (SELECT page_id, key, v, unnest(json_extract_string(v, '$.highlightedJobListings[*].__ref')) AS target FROM e WHERE v ->> '$.__typename' = 'StartupResult'),
l AS (SELECT page_id, target, arg_max(v, key) AS v FROM c GROUP BY 1, 2),
p AS (SELECT page_id, key, v FROM e WHERE v ->> '$.__typename' IN ('JobListing', 'StartupJobPosting', 'JobListingSearchResult') OR list_contains(json_keys(v), 'title') AND list_contains(json_keys(v), 'slug') AND contains(lower(CAST(v AS VARCHAR)), 'compensation'))
"""


@query("cached_postings", FILLED_SQL + CACHE_SQL + "SELECT p.page_id, p.key, p.v ->> '$.title' AS title, l.v ->> '$.name' AS company, l.v ->> '$.slug' AS slug FROM p LEFT JOIN l ON l.page_id = p.page_id AND l.target = p.key")
def cached_postings(spark, read):
    """The postings among the entries of a page's cache, with the company whose entry points to them."""
    rows = _parsed(read).filter(F.get_json_object("json", "$.props.pageProps.apolloState.data").isNotNull()).select("page_id", D.cache_entries(F.col("json")).alias("entries"))
    jobs = D.cached_postings(rows, "entries")
    return jobs.select("page_id", "key", D.at(F.col("posting"), "$.title", "string").alias("title"), D.at(F.col("company"), "$.name", "string").alias("company"), D.at(F.col("company"), "$.slug", "string").alias("slug"))


CHAIN_SQL = """
, f AS (SELECT page_id, key, v ->> '$.company.__ref' AS target, v FROM e),
s AS (SELECT page_id, key, [key] AS chain, target FROM f WHERE starts_with(key, 'Job:')
      UNION ALL SELECT s.page_id, s.key, list_append(s.chain, s.target), f.target FROM s LEFT JOIN f ON f.page_id = s.page_id AND f.key = s.target
      WHERE s.target IS NOT NULL AND NOT list_contains(s.chain, s.target) AND len(s.chain) <= 3),
b AS (SELECT page_id, key, max_by(chain, len(chain)) AS chain FROM s GROUP BY 1, 2)
SELECT b.page_id, b.key, array_to_string(b.chain, ' > ') AS chain, f.v ->> '$.name' AS name FROM b LEFT JOIN f ON f.page_id = b.page_id AND f.key = b.chain[-1]
"""


@query("reference_chains", FILLED_SQL.replace("WITH h", "WITH RECURSIVE h", 1) + CACHE_SQL + CHAIN_SQL)
def reference_chains(spark, read):
    """Where the company of each posting of a cache leads, three references far, and the name at the end."""
    rows = _parsed(read).select("page_id", D.cache_entries(F.col("json")).alias("entries")).select("page_id", "entries", F.explode(F.filter(F.map_keys("entries"), lambda k: k.startswith("Job:"))).alias("key"))
    chains = rows.select("page_id", "entries", "key", D.followed(F.col("entries"), F.col("key"), "company", 3).alias("chain"))
    return chains.select("page_id", "key", F.array_join("chain", " > ").alias("chain"), D.at(F.try_element_at("entries", F.element_at("chain", -1)), "$.name", "string").alias("name"))


STAGES_SQL = FILLED_SQL + WALK_SQL + r"""
, q AS (SELECT page_id, json_extract(d, '$.props.pageProps.dehydratedState.queries[*].state.data') AS qs, json_extract(d, '$.props.pageProps.jobs') AS jobs FROM d),
a AS (SELECT page_id, CASE WHEN json_type(jobs) = 'ARRAY' THEN json_array_length(jobs) WHEN json_type(jobs -> '$.data') = 'ARRAY' THEN json_array_length(jobs -> '$.data') ELSE 0 END AS n FROM q),
b AS (SELECT page_id, list_sum([CASE WHEN json_type(x) = 'ARRAY' THEN json_array_length(x) ELSE list_sum([CASE WHEN json_type(y) = 'ARRAY' THEN json_array_length(y) WHEN list_contains(json_keys(y), 'title') THEN 1 ELSE 0 END
        FOR y IN list_concat(json_extract(x, '$.pages[*]'), json_extract(x, '$.hits[*]'))]) END FOR x IN qs]) AS n FROM q),
k AS (SELECT page_id, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT h.page_id, coalesce(nullif(a.n, 0), b.n, 0) AS listed, coalesce(k.n, 0) AS walked, len(regexp_extract_all(h.html, '<h1[^>]*>([^<]*)</h1>', 1)) AS headed
      FROM h LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id) LEFT JOIN k USING (page_id))
SELECT page_id, CASE WHEN listed > 0 THEN 'listed' WHEN walked > 0 THEN 'walked' WHEN headed > 0 THEN 'headings' END AS stage,
  CAST(CASE WHEN listed > 0 THEN listed WHEN walked > 0 THEN walked ELSE headed END AS INT) AS n FROM s
"""


@query("parser_stages", STAGES_SQL)
def parser_stages(spark, read):
    """How many titles each page gives, and which of three parsers found them: lists, a search of all objects, headings."""
    title = lambda v: F.coalesce(D.at(v, "$.title", "string"), F.lit(""))
    data = F.try_parse_json("json")

    def listed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("answer", F.transform(D.listed_postings(data), title))

    def walked(rows: DataFrame) -> DataFrame:
        found = D.posting_objects(rows.withColumn("root", D.at(data, "$.props.pageProps")), "root")
        return found.withColumn("answer", F.transform("found", title)).drop("found")

    def headings(rows: DataFrame) -> DataFrame:
        return rows.withColumn("answer", F.regexp_extract_all("html", F.lit("<h1[^>]*>([^<]*)</h1>"), F.lit(1)))

    answers = D.first_answers(_parsed(read), "page_id", (("listed", listed), ("walked", walked), ("headings", headings)))
    return answers.select("page_id", "stage", F.size("answer").alias("n"))
