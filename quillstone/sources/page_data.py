"""Postings in the data that pages carry for their own scripts: lists, nested objects of any shape, and caches of entries.

Page data is parsed once, to VARIANT. Nested objects are walked level by level over arrays of
values, so that a page stays one row until its postings are known, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.shelf import Shelf

# The script that holds a page's data, names of employers beside a title, lists in a cached query, types of entries.
SCRIPT = r'(?s)<script\s+id="__NEXT_DATA__"[^>]*>(.*?)</script>'
EMPLOYERS = ("name_of_employer", "employer", "company")
LISTS = ("pages", "data", "jobs", "hits", "items")
JOB_TYPES = ("JobListing", "StartupJobPosting", "JobListingSearchResult")
COMPANY_TYPE = "StartupResult"
#: Levels below the first that are searched.
DEPTH = 6


def page_json(html: Column) -> Column:
    """The text of the page's data; null if the page has none."""
    return F.nullif(F.regexp_extract(html, SCRIPT, 1), F.lit(""))


def at(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path; null if there is none or it isn't of that kind."""
    return F.try_variant_get(v, path, kind)


def _items(v: Column) -> Column:
    return F.coalesce(at(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _children(v: Column) -> Column:
    return F.coalesce(at(v, "$", "array<variant>"), F.map_values(at(v, "$", "map<string,variant>")), F.array().cast("array<variant>"))


def has_key(v: Column, *keys: str) -> Column:
    """Whether the value is an object with one of the keys, its value null or not."""
    own = at(v, "$", "map<string,variant>")
    found = F.lit(False)
    for k in keys:
        found = found | F.coalesce(F.map_contains_key(own, k), F.lit(False))
    return found


def is_posting(v: Column) -> Column:
    return has_key(v, "title") & has_key(v, *EMPLOYERS)


def posting_objects(rows: DataFrame, root: str, depth: int = DEPTH, matches: Callable[[Column], Column] = is_posting) -> DataFrame:
    """rows with found, all objects in the value root that match, down to depth levels below it.

    What lies inside a match isn't searched. Objects and lists count as a level each. A null
    root, or one without such objects, finds none; order within a level is that of keys.
    """
    others = [c for c in rows.columns if c != root]
    none = F.array().cast("array<variant>")
    rows = rows.select(*others, F.filter(F.array(root), lambda v: v.isNotNull()).alias("level"), none.alias("found"))
    for d in range(depth + 1):
        found = F.concat("found", F.filter("level", matches)).alias("found")
        below = F.flatten(F.transform(F.filter("level", lambda v: ~matches(v)), _children)) if d < depth else none
        # One projection for each level: what it reads twice is computed once.
        rows = rows.select(*others, F.filter(below, lambda v: v.isNotNull()).alias("level"), found)
    return rows.drop("level")


def listed_postings(data: Column) -> Column:
    """The postings that page data lists: plainly or under data, else those of cached queries; an empty array without any."""
    props = "$.props.pageProps"
    plain = F.coalesce(at(data, f"{props}.jobs", "array<variant>"), at(data, f"{props}.jobs.data", "array<variant>"), F.array().cast("array<variant>"))

    def of_query(q: Column) -> Column:
        held = at(q, "$.state.data")
        lists = F.flatten(F.array(*(_items(at(held, f"$.{k}")) for k in LISTS)))
        nested = F.flatten(F.transform(lists, lambda x: F.when(has_key(x, "title"), F.array(x)).otherwise(_items(x))))
        return F.when(at(held, "$", "array<variant>").isNotNull(), _items(held)).otherwise(nested)

    cached = F.flatten(F.transform(_items(at(data, f"{props}.dehydratedState.queries")), of_query))
    return F.when(F.size(plain) > 0, plain).otherwise(cached)


def cache_entries(json: Column) -> Column:
    """The entries of a page's cache by key, in the order of the text; the page's own values where it has no cache."""
    cache = F.coalesce(F.get_json_object(json, "$.props.pageProps.apolloState.data"), F.get_json_object(json, "$.props.pageProps"))
    return F.from_json(cache, "map<string,variant>")


def cached_postings(rows: DataFrame, entries: str) -> DataFrame:
    """rows with key, posting and company for each posting among the entries of a cache.

    A posting is an entry of a known type, or one with a title, a slug and something on pay.
    Companies point to their postings; of several, the last one's entry counts, and a posting
    that none points to has a null company. Pointers to no entry are passed over.
    """
    others = [c for c in rows.columns if c != entries]
    listed = F.filter(F.map_entries(entries), lambda e: at(e["value"], "$", "map<string,variant>").isNotNull())
    kind = lambda v: F.coalesce(at(v, "$.__typename", "string"), F.lit(""))
    rows = rows.select(*others, listed.alias("listed"))
    companies = F.filter("listed", lambda e: kind(e["value"]) == COMPANY_TYPE)
    pointers = F.flatten(F.transform(companies, lambda e: F.transform(_items(at(e["value"], "$.highlightedJobListings")), lambda r: F.named_struct(F.lit("to"), at(r, "$.__ref", "string"), F.lit("company"), e["value"]))))
    posting = lambda e: kind(e["value"]).isin(*JOB_TYPES) | has_key(e["value"], "title") & has_key(e["value"], "slug") & F.contains(F.lower(F.to_json(e["value"])), F.lit("compensation"))
    rows = rows.select(*others, pointers.alias("pointers"), F.explode(F.filter("listed", posting)).alias("e"))
    company = F.try_element_at(F.filter("pointers", lambda p: p["to"] == F.col("e.key")), F.lit(-1))["company"]
    return rows.select(*others, F.col("e.key").alias("key"), F.col("e.value").alias("posting"), company.alias("company"))


def followed(entries: Column, start: Column, field: str, depth: int) -> Column:
    """The keys that field's references lead through from start on: at most depth steps, none twice.

    A reference to no entry is the last key; one back to a key that is there already is left out.
    """
    following = lambda chain: at(F.try_element_at(entries, F.element_at(chain, -1)), f"$.{field}.__ref", "string")
    step = lambda chain, _: F.when(following(chain).isNotNull() & ~F.array_contains(chain, F.coalesce(following(chain), F.lit(""))), F.concat(chain, F.array(following(chain)))).otherwise(chain)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(start), step)


def first_answers(rows: DataFrame, key: str, parsers: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """key, stage and answer (an array) for every row: the first parser's that finds something.

    A parser gets the rows that all before it left open and adds the column answer. Each
    stage's rows are written, so that a dearer parser sees only those. Rows that none answers
    have a null stage and an empty answer.
    """
    shelf, done = Shelf(rows.sparkSession, "answers"), []
    for name, parse in parsers:
        table = shelf.put(parse(rows).withColumn("is_open", F.size(F.coalesce("answer", F.array())) == 0), name)
        done.append(table.filter("not is_open").select(key, F.lit(name).alias("stage"), "answer"))
        rows = table.filter("is_open").drop("answer", "is_open")
    kind = done[0].schema["answer"].dataType
    out = rows.select(key, F.lit(None).cast("string").alias("stage"), F.array().cast(kind).alias("answer"))
    for part in done:
        out = out.unionByName(part)
    return out
