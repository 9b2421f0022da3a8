"""The stages one after the other, and queries of the subpackage that SQL can express."""

import duckdb
import pytest

import corpus_pipeline
from quillstone.llm import queries

WHERE = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left.count()
        left = spark.createDataFrame(stage(spark, left, WHERE).collect(), docs.schema)
        assert left.columns == columns and left.count() <= before, name
    assert 0.5 * docs.count() < left.count() < docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, left, WHERE)
    assert packed.select("doc_id").distinct().count() == left.count()


def test_stages_of_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        left = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = spark.createDataFrame(stage(spark, left, WHERE).collect(), docs.schema)
            assert left.columns == docs.columns
        assert left.filter("doc_id = 6 or doc_id = 7").count() == (1 if docs is odd_documents else 0)
        corpus_pipeline.STAGES[-1][1](spark, left, WHERE).count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(name, spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    got, want = queries.queries()[name](spark, WHERE).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted("|".join(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)
