"""Readers and writers, over files that the queries themselves write to the shared folder, and streams over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions.text import lenient_json, repaired
from quillstone.operators.relational import keep_last
from quillstone.operators.screening import traffic_light
from quillstone.registry import query
from quillstone.shelf import Shelf
from quillstone.sources import sinks, tables
from quillstone.streaming import ingest


@query("board_files", "SELECT p_brand AS board, p_partkey AS id, p_name AS title, 'Hall ' || (p_partkey % 5) AS place FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue')")
def board_files(spark, read):
    """One answer file for each board, read back with a filter of titles."""
    shelf = Shelf(spark, "boards")
    job = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.struct(F.concat(F.lit("Hall "), (F.col("p_partkey") % 5).cast("string")).alias("name")).alias("location"))
    boards = read("part").groupBy("p_brand").agg(F.collect_list(job).alias("jobs"))
    boards.withColumn("board", F.col("p_brand")).repartition("p_brand").write.partitionBy("p_brand").json(f"{shelf.path}/boards")
    jobs = tables.board_snapshot(spark, f"{shelf.path}/boards/*")
    return jobs.filter(F.lower("title").rlike("red|blue")).select("board", "id", "title", F.col("location.name").alias("place"))


@query("csv_round_trip", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def csv_round_trip(spark, read):
    """Texts with quotes and line breaks, exported as CSV and read back."""
    shelf = Shelf(spark, "csv")
    sinks.export_csv(read("documents").select("doc_id", "lang", "text"), f"{shelf.path}/export")
    return tables.csv_export(spark, f"{shelf.path}/export", "doc_id long, lang string, text string").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("json_round_trip", "SELECT doc_id, source, md5(text) AS digest FROM documents")
def json_round_trip(spark, read):
    shelf = Shelf(spark, "json")
    sinks.export_json(read("documents").select("doc_id", "source", "text"), f"{shelf.path}/export")
    return tables.json_landing(spark, f"{shelf.path}/export", "doc_id long, source string, text string").select("doc_id", "source", F.md5("text").alias("digest"))


@query("appended_log", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def appended_log(spark, read):
    """Two runs append to one log."""
    shelf = Shelf(spark, "log")
    for _ in range(2):
        sinks.append_log(read("events").select("event_id", "event_type"), f"{shelf.path}/log")
    return spark.read.parquet(f"{shelf.path}/log").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("markdown_sections", "SELECT r_name AS heading, 'Key ' || r_regionkey || chr(10) || 'second line' AS body FROM region")
def markdown_sections(spark, read):
    shelf = Shelf(spark, "notes")
    part = F.concat(F.lit("# Notes\n## "), "r_name", F.lit("\nKey "), F.col("r_regionkey").cast("string"), F.lit("\nsecond line\n"))
    read("region").select(part.alias("value"), "r_name").write.partitionBy("r_name").text(f"{shelf.path}/notes")
    return tables.sections(spark, f"{shelf.path}/notes/*")


@query("linked_data", "SELECT p_partkey, p_name AS title, p_brand AS company FROM part WHERE p_partkey % 3 <> 0")
def linked_data(spark, read):
    """Pages with a posting in their linked data, with other linked data, and with none."""
    ld = F.to_json(F.struct(F.when(F.col("p_partkey") % 3 == 1, "JobPosting").when(F.col("p_partkey") % 3 == 2, "JobPosting").otherwise("Product").alias("@type"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("name")).alias("hiringOrganization")))
    pages = read("part").select("p_partkey", F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit("</script><p>text</p></html>")).alias("html"))
    jobs = tables.job_postings_ld(pages)
    return jobs.select("p_partkey", F.col("job.title").alias("title"), F.col("job.hiringOrganization.name").alias("company"))


@query("chatty_json", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS name FROM part")
def chatty_json(spark, read):
    """Answers that are JSON, that hold some among other words, and that have none."""
    body = F.to_json(F.struct(F.col("p_name").alias("name")))
    k = F.col("p_partkey") % 3
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure! "), body, F.lit(" Anything else?"))).otherwise("no idea")
    return read("part").select("p_partkey", lenient_json(answer, "name string")["name"].alias("name"))


@query("repaired_texts", "SELECT doc_id, md5(text) AS digest FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\xFF]')")
def repaired_texts(spark, read):
    """Texts whose UTF-8 was read as Latin-1 come back as they were."""
    docs = read("documents").filter(~F.col("text").rlike("[^\\x00-\\xFF]"))
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", F.md5(repaired(broken)).alias("digest"))


@query("stream_unseen", "SELECT DISTINCT user_id FROM events")
def stream_unseen(spark, read):
    """The first row of each user from a file stream that is run until all input is read."""
    shelf = Shelf(spark, "unseen")
    rows = read("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    shelf.put(rows, "landing")
    first = ingest.unseen_urls(ingest.landing(spark, f"{shelf.path}/landing", rows.schema), "user_id", "ts", "3650 days")
    sink = first.writeStream.format("parquet").option("path", f"{shelf.path}/out").option("checkpointLocation", f"{shelf.path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{shelf.path}/out").select("user_id")


@query("stream_merged", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_merged(spark, read):
    """Events merged into a store by micro-batches: the last event of each user."""
    shelf = Shelf(spark, "merge")
    rows = read("events").select("user_id", "event_id", "event_type")
    shelf.put(rows.repartition(4, "event_id"), "landing")
    stream = ingest.landing(spark, f"{shelf.path}/landing", rows.schema, files_per_trigger=2)
    ingest.merge_batches(stream, f"{shelf.path}/store", "user_id", "event_id", [], f"{shelf.path}/checkpoint").awaitTermination()
    snapshots = spark.read.option("basePath", f"{shelf.path}/store").parquet(f"{shelf.path}/store/*").select("user_id", "event_id", "event_type")
    return keep_last(snapshots, ["user_id"], "event_id")


PROFILE_SQL = "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])idiot([^a-z0-9]|$)') THEN 'RED' WHEN regexp_matches(lower(text), '(^|[^a-z0-9])que([^a-z0-9]|$)') THEN 'GREEN' ELSE 'NEUTRAL' END AS light, 'NEUTRAL' AS without_profile FROM documents"


@query("profile_lights", PROFILE_SQL)
def profile_lights(spark, read):
    """Traffic lights by a profile that is read from a file, and by one whose file is missing."""
    shelf = Shelf(spark, "profile")
    one = spark.range(1).select(F.lit('{"name": "mine",\n "green": ["que"],\n "red": ["idiot"]}').alias("value"))
    one.write.text(f"{shelf.path}/mine")
    lights = []
    for name in ("mine", "none"):
        p = tables.keyword_profile(spark, f"{shelf.path}/{name}")
        lights.append(traffic_light(F.col("text"), p["green"], p["yellow"], p["red"], p["yellow_threshold"]))
    return read("documents").select("doc_id", lights[0].alias("light"), lights[1].alias("without_profile"))


@query("result_file", "SELECT p_partkey AS id, p_partkey % 3 = 0 AS passed FROM part WHERE p_partkey % 3 <> 0")
def result_file(spark, read):
    """The rejected entries of one JSON document that lists all results."""
    shelf = Shelf(spark, "results")
    entry = F.to_json(F.struct(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).alias("passed")))
    listing = read("part").groupBy().agg(F.concat(F.lit('{"generated": "now",\n"results": ['), F.array_join(F.collect_list(entry), ",\n"), F.lit("]}")).alias("value"))  # one document, as the tool writes it
    listing.write.text(f"{shelf.path}/results")
    return tables.listed(spark, f"{shelf.path}/results", "results", "id: long, passed: boolean").filter("not passed")
