"""Readers: fixture tables, landing zones, exports, and the postings view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import first_present
from quillstone.session import spread

#: One posting for each document, from the star schema; the same text in Spark and DuckDB.
POSTINGS_SQL = """
SELECT d.doc_id AS id,
       concat('https://jobs.example/', CAST(d.doc_id AS VARCHAR(20))) AS job_url,
       CASE d.doc_id % 8 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Account Executive - Enterprise'
            WHEN 2 THEN 'Data Analyst' WHEN 3 THEN 'Engineering Manager' WHEN 4 THEN 'Senior UX Designer'
            WHEN 5 THEN 'Backend Engineer' WHEN 6 THEN 'Product Manager' ELSE 'Site Reliability Engineer' END AS title,
       s.s_name AS company, n.n_name AS location, d.text AS description,
       CASE d.doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE 'on_site' END AS remote_type,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST(80000 + (d.doc_id * 37 % 120) * 1000 AS DOUBLE) END AS salary_min,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE CAST(110000 + (d.doc_id * 37 % 120) * 1000 AS DOUBLE) END AS salary_max,
       o.o_orderdate AS posted_date, d.source AS source_site,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(d.doc_id * 13 % 101 AS DOUBLE) END AS alignment_score,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE CAST(d.doc_id * 29 % 700 AS INT) END AS applicant_count,
       CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE CAST(25 + d.doc_id * 11 % 25 AS DOUBLE) / 10 END AS company_rating,
       d.n_chars
FROM documents d
JOIN supplier s ON s.s_suppkey = d.doc_id % 10
JOIN nation n ON n.n_nationkey = s.s_nationkey
JOIN orders o ON o.o_orderkey = d.doc_id
"""

POSTING = (
    "id long, job_url string, title string, company string, location string, description string, remote_type string, salary_min double, salary_max double, "
    "salary_period string, posted_date timestamp_ntz, scraped_date timestamp_ntz, source_site string, clearance_required string, alignment_score double, "
    "applicant_count int, company_rating double, extras map<string,string>"
)


def postings(spark: SparkSession, read) -> DataFrame:
    """The postings view over the fixture tables."""
    return spark.sql(
        POSTINGS_SQL.replace("FROM documents d", "FROM {documents} d").replace("JOIN supplier", "JOIN {supplier}").replace("JOIN nation", "JOIN {nation}").replace("JOIN orders", "JOIN {orders}"),
        documents=spread(read("documents")), supplier=read("supplier"), nation=read("nation"), orders=read("orders"),
    )


#: Names under which sources give a field, the preferred first.
ALIASES = {
    "id": ("id", "job_id", "opportunity_id"),
    "title": ("title", "job_title", "position"),
    "company": ("company", "company_name", "employer"),
    "location": ("location", "job_location"),
    "salary_range": ("salary_range", "salary"),
    "job_url": ("job_url", "url", "link"),
    "description": ("description", "job_description", "summary"),
    "posted_date": ("posted_date", "date_posted"),
}


def unified(raw: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Each field from the first of its names that has a value; fields of no known name go into the map extras."""
    known = {n for names in aliases.values() for n in names}
    fields = [first_present(*(F.col(n).cast("string") for n in names if n in raw.columns)).alias(field) if set(names) & set(raw.columns) else F.lit(None).cast("string").alias(field) for field, names in aliases.items()]
    rest = [x for c in raw.columns if c not in known for x in (F.lit(c), F.col(c).cast("string"))]
    return raw.select(*fields, (F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")).alias("extras"))


def json_landing(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A folder of JSON records; broken ones come with nulls instead of failing the read."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def board_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A job board's answer files, one row for each job in them."""
    job = "id: long, title: string, absolute_url: string, updated_at: string, location: struct<name: string>, content: string"
    raw = spark.read.schema(f"board string, jobs array<struct<{job}>>").option("multiLine", True).json(path)
    return raw.select("board", F.explode("jobs").alias("job")).select("board", "job.*")


def csv_export(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """A Markdown file as records: heading and body of each second-level section."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.slice(F.split("value", r"(?m)^## "), 2, 1_000_000)).alias("part"))
    return parts.select(F.trim(F.substring_index("part", "\n", 1)).alias("heading"), F.regexp_extract("part", r"(?s)^[^\n]*\n(.*?)\s*$", 1).alias("body"))


JOB_LD = "title: string, datePosted: string, employmentType: string, hiringOrganization: struct<name: string>, jobLocationType: string"


def job_postings_ld(html: DataFrame, column: str = "html") -> DataFrame:
    """JobPosting objects in the linked data of pages; pages without any give no row."""
    blocks = html.withColumn("__ld", F.explode(F.regexp_extract_all(column, F.lit(r'(?s)<script type="application/ld[+]json">(.*?)</script>'), F.lit(1))))
    one = blocks.withColumn("__job", F.from_json("__ld", f"struct<`@type`: string, {JOB_LD}>"))
    return one.filter(F.col("__job.`@type`") == "JobPosting").withColumn("job", F.col("__job")).drop("__ld", "__job", column)


def comment_header(c: str = "text") -> Column:
    """Fields of a hiring comment's first line, split at bars: company, role, place."""
    line = F.split(F.substring_index(c, "\n", 1), r"\|")
    return F.struct(F.trim(F.get(line, F.lit(0))).alias("company"), F.trim(F.get(line, F.lit(1))).alias("role"), F.trim(F.get(line, F.lit(2))).alias("place"))


PROFILE = "name string, green array<string>, yellow array<string>, red array<string>, yellow_threshold int"


def keyword_profile(spark: SparkSession, path: str) -> dict[str, object]:
    """A keyword profile from a JSON file; a file that is missing gives an empty profile.

    Lists that the file lacks are empty, and the threshold is 2. What comes to the driver
    is one profile, not data.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    row = spark.read.schema(PROFILE).option("multiLine", True).json(path).first() if there else None
    found = row.asDict() if row else {}
    return {"name": found.get("name") or "default", **{k: tuple(found.get(k) or ()) for k in ("green", "yellow", "red")}, "yellow_threshold": found.get("yellow_threshold") or 2}


def listed(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The entries of a list within one JSON document, a row each."""
    return spark.read.schema(f"`{field}` array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(field))
