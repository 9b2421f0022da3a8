"""Applying decisions about rows to the rows themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.block_naming import exact_duplicates, normalised
from quillstone.llm.columns import fresh, mapped, own_columns, shuffled
from quillstone.llm.minhash_tensor import near_rows
from quillstone.llm.toxicity_zstd import Distance, Toxicity
from quillstone.llm.worker import release
from quillstone.shelf import Shelf

#: So many keys of dropped rows are broadcast at most (some 100 bytes each in memory); more are joined by shuffle.
BROADCAST_KEYS = 250_000
#: Similarity from which a near duplicate is dropped, in percent.
NEAR_PERCENT = 80
#: Stands for a null doc_id, which an equi-join wouldn't match.
NO_ID = -(2**63)


def _without(docs: DataFrame, digest: Column, dropped: DataFrame, doc_id: str, label: str) -> DataFrame:
    """docs less the rows whose doc_id and digest are among dropped (doc_id, sha), with docs' own columns."""
    ident, sha = fresh(docs, "id_key", "sha_key")
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias(ident)
    gone = Shelf(docs.sparkSession, label).put(dropped.select(key("doc_id"), F.col("sha").alias(sha)).distinct(), "dropped")
    few = gone.count() <= BROADCAST_KEYS
    keyed = docs.select("*", key(doc_id), digest.alias(sha))
    return keyed.join(F.broadcast(gone) if few else shuffled(gone), [ident, sha], "left_anti").select(*own_columns(docs))


def drop_toxic(docs: DataFrame, model: Toxicity | float, text: str = "text") -> DataFrame:
    """The rows of docs whose whole text scores under one half, with all their columns.

    Null texts score as empty ones. Each row is scored by itself, so that repeated rows stay
    or go together, long texts are read whole, and an empty table stays one.
    """
    place = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        distance = None if isinstance(model, float) else Distance(model.ordinary, model.toxic)
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            if distance is None:
                keep = np.full(len(texts), model < 0.5)
            else:
                keep = model.score(np.array([distance.features(t) for t in texts])) < 0.5 if texts else np.zeros(0, bool)
            yield b.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, clean, docs)


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal normalised texts: the longest text, then the smallest doc_id.

    Null texts count as empty ones and equal each other. Rows that repeat both the doc_id
    and the normalised text that stay all stay; a doc_id's rows with other texts are judged
    on their own. An empty table stays one, and other columns may have any names.
    """
    gone = exact_duplicates(docs, text, doc_id).filter("not kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    return _without(docs, F.unhex(F.sha2(normalised(F.col(text)), 256)), gone, doc_id, "exact-drop")


def drop_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each component of near duplicates, whose texts are similar to NEAR_PERCENT or more.

    The smallest doc_id stays. Texts without words and rows with a null doc_id stay. Rows
    go by their doc_id and text, so that another text under the same doc_id is judged on
    its own. An empty table stays one, and other columns may have any names.
    """
    gone = near_rows(docs, text, doc_id, NEAR_PERCENT).filter("not kept").select("doc_id", "sha")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    return _without(docs, digest, gone, doc_id, "near-drop")
