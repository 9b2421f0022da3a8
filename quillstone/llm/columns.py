"""Names of columns that clash with no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fresh(df: DataFrame, *labels: str) -> list[str]:
    """A name for each label that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for label in labels:
        name, k = label, 0
        while name.lower() in taken:
            k += 1
            name = f"{label}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that may grow with the input: it is joined by shuffle.

    Spark estimates a table by its compressed files. Numbers in order shrink to a small part of
    what they take in memory, so that a table too large for the driver would be broadcast.
    """
    return df.hint("merge")


def mapped(df: DataFrame, f: Callable, like: DataFrame) -> DataFrame:
    """df through f, batch by batch, as rows with like's columns.

    Columns have plain names on the way, since names with dots or backticks are no good there.
    """
    schema = T.StructType([T.StructField(f"c{i}", x.dataType, True) for i, x in enumerate(like.schema.fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(f, schema).toDF(*like.columns)
