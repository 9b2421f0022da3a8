"""From raw documents to packed sequences: toxicity, exact, near and passage deduplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.decisions import drop_exact, drop_near, drop_toxic
from quillstone.llm.nnls_packing import pack
from quillstone.llm.queries import labels, tokenizer_path
from quillstone.llm.suffix_dedup import without_repeats
from quillstone.llm.toxicity_zstd import Toxicity, train
from quillstone.shelf import Shelf

FOLDS, HELD = 5, 0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside the held-out fold.

    A null text counts as an empty one. Each row is judged by itself, so that repeated rows go
    or stay together; texts are read whole; an empty table stays one. Columns stay as they are.
    """
    model = train(docs, labels(spark, sf_dir), FOLDS, HELD)
    return drop_toxic(docs, model if isinstance(model, Toxicity) else float(model))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest text, ties by the smallest doc_id.

    Null texts count as empty ones and equal each other; a null doc_id comes last. Rows that
    repeat the doc_id and the text that stay all stay. An empty table stays one.
    """
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8 or more) stays, that of the smallest doc_id.

    Null and empty texts and rows without doc_id link with nothing and stay; repeated rows
    stay or go together; texts are taken whole; an empty table stays one.
    """
    return drop_near(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 50 bytes that a smaller document has are cut out; every document stays, and n_chars is that of what is left.

    Null texts stay null; rows of one doc_id don't cut each other; an empty table stays one.
    """
    return without_repeats(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    A null or empty text has one token, its end. Long texts are cut at multiples of the
    sequence's length; repeated rows are packed each; an empty table gives no rows.
    """
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: Compression distances, MinHash and tokens are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each but the last is written, so that the next reads it as often as it needs."""
    shelf = Shelf(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
        shelf.keep(name)
    return STAGES[-1][1](spark, docs, sf_dir)
