"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of a fixed size. The distinct blocks of all texts are
sorted and named with integers; then adjacent names are paired, the distinct pairs
sorted and named again, and so on until one name is left of every text. Names come
from sorting the contents themselves, so that two texts have one identity only if they
are equal. Names cover the texts that may have copies: a digest that only one text has
proves that text unique, as equal texts have equal digests, so that its digest is its
identity; among texts that share a digest, names decide and the digest never does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.shelf import Shelf

#: Characters that don't count when texts are compared: [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BLOCK = 2048
#: A set of digests up to this many is broadcast (some 100 bytes each in memory); a larger one is joined by shuffle.
BROADCAST_DIGESTS = 250_000


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return reduce(lambda c, b: F.replace(c, F.lit(b), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def _named(parts: DataFrame, keys: list[str], shelf: Shelf, table: str) -> DataFrame:
    """The distinct values of keys, each with an integer that follows their sort order.

    The written table pins the integers: a recomputed range partitioning could choose others.
    """
    distinct = parts.select(*keys).distinct()
    ranged = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return shelf.put(ranged.withColumn("name", F.monotonically_increasing_id()), table)


def identities(texts: DataFrame, shelf: Shelf, block: int = BLOCK) -> DataFrame:
    """One identity (level, name) for each row of texts (key columns k and sha, text norm).

    Rows with equal norm, and only they, get equal (level, name). Empty texts get level -1.
    The rows that stand for one text never meet in one task: blocks and pairs are
    aggregated before they are shuffled, and the joins that bring names back are plain
    equi-joins, whose hot keys adaptive execution splits.
    """
    cut = texts.withColumn("part", F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    parts = shelf.put(
        cut.filter("norm <> ''").select("k", "sha", F.size("part").alias("n"), F.posexplode("part").alias("pos", "content")),
        "parts",
    )
    done = [texts.filter("norm = ''").select("k", "sha", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))]
    names = _named(parts, ["content"], shelf, "names_0")
    active = shelf.put(parts.join(names, "content").select("k", "sha", "n", "pos", "name"), "active_0")
    shelf.drop("parts", "names_0")
    longest = active.agg(F.max("n")).first()[0] or 0
    level = 0
    while True:
        done.append(active.filter("n = 1").select("k", "sha", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            return reduce(DataFrame.unionByName, done).distinct()
        pairs = shelf.put(
            active.filter("n > 1")
            .groupBy("k", "sha", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.expr("(n + 1) div 2")).cast("int").alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            ),
            f"pairs_{level}",
        )
        level += 1
        names = _named(pairs, ["left", "right"], shelf, f"names_{level}")
        active = shelf.put(pairs.join(names, ["left", "right"]).select("k", "sha", "n", "pos", "name"), f"active_{level}")
        shelf.drop(f"pairs_{level - 1}", f"names_{level}")
        longest = (longest + 1) // 2


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs.

    Of equal normalised texts the row with the most code points, then the smallest doc_id
    stays. Null texts count as empty, and empty texts equal each other. A null doc_id
    comes after all others; rows that repeat a doc_id count each, and all those with the
    doc_id that stays are kept. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "exact")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        normalised(F.col(text)).alias("norm"),
    ).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    prints = shelf.put(rows.drop("norm"), "prints")
    shared = shelf.put(prints.groupBy("sha").count().filter("count > 1").select("sha"), "shared")
    few = shared.count() <= BROADCAST_DIGESTS
    texts = rows.select("k", "sha", "norm").join(F.broadcast(shared) if few else shared, "sha", "left_semi")
    named = shelf.put(identities(texts, shelf, block), "named")

    best = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("order")))
    marked = prints.join(named, ["k", "sha"], "left")
    grouped = marked.filter("name is not null").groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    # Written first, so that the join has two plain shuffles below it, of which hot groups are split.
    copies = marked.filter("name is not null").join(shelf.put(grouped, "grouped"), ["level", "name"])
    single = marked.filter("name is null")
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    out = copies.withColumn("keep_id", F.bitwise_not("best.order")).unionByName(
        single.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")), allowMissingColumns=True
    )
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("text_sha256", F.lower(F.hex("sha"))).select(*columns)
    out = shelf.put(out, "result")
    shelf.keep("result")
    return out
