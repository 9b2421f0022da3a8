"""Bounded, repeatable samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id has fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % folds


def first_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest hashes of key, the same ones in every run."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)


def one_label(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id and label without nulls, each doc_id once: the greatest of its labels."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    return known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
